"""Tables written between the steps of an operator.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors share, so that a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}
_STEPS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only in local mode, where the session names none.

    On a cluster that names none it is an error: executors don't share a machine's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    key = id(spark._jsparkSession)
    if key not in _OWN:
        own = tempfile.TemporaryDirectory(prefix="quernstone-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        _OWN[key] = own.name
    return _OWN[key]


def step_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``remove_steps`` knows of."""
    _STEPS.append(f"{shared_dir(spark)}/step-{uuid.uuid4().hex}")
    return _STEPS[-1]


#: Whether shuffle files go with the query that wrote them, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage ends here, and so do the shuffle files behind it."""
    spark = df.sparkSession
    path, before = step_path(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned, once all that reads them is itself written."""
    for table in tables:
        _STEPS.remove(table._step_path)
        _delete(table.sparkSession, table._step_path)


def remove_steps(spark: SparkSession) -> int:
    """Deletes the tables written so far, once no result that reads them is needed; how many there were."""
    n = len(_STEPS)
    while _STEPS:
        _delete(spark, _STEPS.pop())
    return n


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster runs at once.

    A file of one row group is one task however large; only then is a shuffle added.  For scans and
    what follows them without a shuffle: of other plans, asking for partitions would run the first stages.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > want else df.repartition(want)
