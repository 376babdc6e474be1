"""The sharded corpus: plan, splits, caps, character budget, batches.

A corpus has ``shard_id``, ``rg_id`` and ``pos``, which together give its order, and ``text``.  A null
text can't be used by any of these and is left out, which each result's counts show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import shard_name
from quernstone.plans.durable import written

VAL_SHARD = 6542
DOC_CAP = 10_000


def plan_shards(present: DataFrame, num_shards: int, val_shard: int = VAL_SHARD) -> DataFrame:
    """The first ``num_shards`` shards (at most all) and the validation shard in order, with whether each is there.

    ``present`` has a ``shard_id``.  A negative number means all.
    """
    n = val_shard if num_shards < 0 else min(num_shards, val_shard)
    ids = present.sparkSession.range(n).select(F.col("id").cast("int").alias("shard_id"))
    want = ids.union(present.sparkSession.range(1).select(F.lit(val_shard).cast("int")))
    have = present.select("shard_id").distinct().withColumn("_there", F.lit(True))
    joined = want.join(have, "shard_id", "left")
    return joined.select("shard_id", shard_name(F.col("shard_id")).alias("file_name"), F.coalesce("_there", F.lit(False)).alias("is_present")).orderBy("shard_id")


def train(corpus: DataFrame, val_shard: int = VAL_SHARD) -> DataFrame:
    return corpus.where(F.col("shard_id") != val_shard)


def of_split(corpus: DataFrame, split: str, val_shard: int = VAL_SHARD) -> DataFrame:
    """The named split; any other name than ``train`` and ``val`` is an error."""
    if split not in ("train", "val"):
        raise ValueError(f"no split {split!r}")
    return train(corpus, val_shard) if split == "train" else corpus.where(F.col("shard_id") == val_shard)


def split_counts(corpus: DataFrame, val_shard: int = VAL_SHARD) -> DataFrame:
    split = F.when(F.col("shard_id") == val_shard, "val").otherwise("train")
    return corpus.groupBy(split.alias("split")).agg(
        F.countDistinct("shard_id").alias("n_shards"), F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_docs"), F.sum(F.length("text")).alias("n_chars")
    )


def capped(corpus: DataFrame, cap: int = DOC_CAP) -> DataFrame:
    """``corpus`` with texts cut to ``cap`` characters (code points)."""
    return corpus.withColumn("text", F.left("text", F.lit(cap)))


def char_budget(corpus: DataFrame, max_chars: int, cap: int = DOC_CAP, at_once: int = 8) -> DataFrame:
    """The documents that a reader takes in corpus order until it has ``max_chars`` characters.

    The document that crosses the budget is still taken, so is the first of all.  Shards are
    measured in order, ``at_once`` at first and then twice as many each time, and those behind the
    budget are never read; totals of row groups are kept in written tables, and only they pass one window.
    The ids of the shards, of which there are a few thousand at most, come to the driver.
    """
    docs = corpus.where("text is not null").withColumn("n_chars", F.length(F.left("text", F.lit(cap))))
    shards = sorted(r["shard_id"] for r in corpus.select("shard_id").where("shard_id is not null").distinct().collect())
    totals, seen, at = None, 0, 0
    while at < len(shards) and (totals is None or seen < max_chars):
        part = docs.where(F.col("shard_id").between(shards[at], shards[min(at + at_once, len(shards)) - 1]))
        own = written(part.groupBy("shard_id", "rg_id").agg(F.sum("n_chars").alias("total")))
        seen += own.agg(F.sum("total")).first()[0] or 0
        totals = own if totals is None else totals.unionByName(own)
        at, at_once = at + at_once, at_once * 2
    if totals is None:
        return docs.where("false").withColumn("before", F.lit(0).cast("long")).drop("text")
    order = Window.orderBy("shard_id", "rg_id")
    groups = totals.withColumn("prior", F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("is_first", F.row_number().over(order) == 1)
    groups = groups.where((F.col("prior") < max_chars) | F.col("is_first"))
    near = docs.where(F.col("shard_id") <= shards[min(at, len(shards)) - 1]).join(groups, ["shard_id", "rg_id"])
    nth = Window.partitionBy("shard_id", "rg_id").orderBy("pos")
    near = near.drop("text").withColumn("before", F.col("prior") + F.coalesce(F.sum("n_chars").over(nth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = near.withColumn("very_first", (F.row_number().over(nth) == 1) & F.col("is_first"))
    return near.where((F.col("before") < max_chars) | F.col("very_first")).drop("prior", "is_first", "very_first", "total")


def batches(corpus: DataFrame, epochs: int, size: int = 128) -> DataFrame:
    """Documents in batches of ``size`` that don't cross row groups, for each epoch from 1.

    A row for each batch: its number in the row group, its documents' row ids in order.
    """
    place = Window.partitionBy("shard_id", "rg_id").orderBy("pos")
    numbered = corpus.where("text is not null").select("shard_id", "rg_id", "pos", "row_id", F.floor((F.row_number().over(place) - 1) / size).alias("batch_no"))
    docs = F.transform(F.sort_array(F.collect_list(F.struct("pos", "row_id"))), lambda x: x["row_id"])
    one = numbered.groupBy("shard_id", "rg_id", "batch_no").agg(F.count(F.lit(1)).alias("n_docs"), docs.alias("row_ids"))
    return one.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
