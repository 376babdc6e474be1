"""Shards and telemetry as they arrive: an extension, the batch operators' counterparts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SHARD = "row_id long, shard_id int, rg_id int, pos long, split string, source string, lang string, text string"
TELEMETRY = (
    "run_tag string, exp_no long, step long, loss double, lrm double, dt double, tok_per_sec long, mfu double, epoch int, remaining double, logged_at timestamp, loaded_at timestamp"
)


def shard_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """New shard files of a folder, a bounded number at a time."""
    return spark.readStream.schema(SHARD).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def telemetry_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(steps: DataFrame, late: str = "3 days") -> DataFrame:
    """Each step once, as it first arrives; what arrives later than ``late`` is dropped."""
    return steps.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_tag", "exp_no", "step"])


def windowed_throughput(steps: DataFrame, every: str = "10 minutes", late: str = "3 days") -> DataFrame:
    """Steps, seconds and failed losses of each run in windows of event time."""
    bad = F.isnan("loss") | (F.col("loss") > 100)
    by = steps.withWatermark("logged_at", late).groupBy(F.window("logged_at", every), "run_tag", "exp_no")
    return by.agg(F.count(F.lit(1)).alias("n_steps"), F.sum("dt").alias("seconds"), F.count_if(bad).alias("n_failed"))


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes all that has arrived and ends."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
