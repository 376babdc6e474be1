"""Files as tables: corpus shards, TSV ledgers, logs; and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITTEN = {"sep": "\t", "header": True, "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
LEDGER_SCHEMA = "commit string, val_bpb string, memory_gb string, status string, description string"


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``shard_*.parquet`` of a folder: ``shard_id`` by name and ``text``; other columns aren't read."""
    files = spark.read.option("pathGlobFilter", "shard_*.parquet").parquet(folder)
    name = F.regexp_extract(F.input_file_name(), r"shard_(\d+)\.parquet", 1)
    return files.select(name.cast("int").alias("shard_id"), "text")


def require_shards(spark: SparkSession, folder: str, least: int = 2) -> int:
    """How many shards the folder has; fewer than ``least``, one to train on and one to validate with, are an error."""
    n = len({f.rsplit("/", 1)[1] for f in spark.read.option("pathGlobFilter", "shard_*.parquet").schema("text string").parquet(folder).inputFiles()})
    if n < least:
        raise ValueError(f"{folder} has {n} shards, {least} are needed")
    return n


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated ledger with its header; quotation marks and blanks are text like any other, an empty field is null."""
    return spark.read.options(sep="\t", header=True, quote="").schema(LEDGER_SCHEMA).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Rows of a ledger's five columns, appended to a folder of tab-separated files."""
    rows.select("commit", "val_bpb", "memory_gb", "status", "description").write.mode("append").options(**WRITTEN).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log's lines as ``value``; steps that overwrite each other on a terminal are lines of their own."""
    return spark.read.text(path)


def save_tokenizer(merges: DataFrame, token_bytes: DataFrame, folder: str) -> None:
    """Both tables of a tokenizer; what is there already stays."""
    merges.write.mode("ignore").parquet(f"{folder}/merges.parquet")
    token_bytes.write.mode("ignore").parquet(f"{folder}/token_bytes.parquet")


def load_tokenizer(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/merges.parquet"), spark.read.parquet(f"{folder}/token_bytes.parquet")
