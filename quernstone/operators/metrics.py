"""Bits per byte from the losses of target tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of losses in bits by sum of bytes.  ``losses`` has ``keys``, ``token_id`` and ``nats``.

    Special tokens (no bytes) are masked by a factor of 0, so a NaN among them makes the result
    NaN: ``bpb`` is then null and ``is_nan`` true, while ``bpb_masked`` leaves such tokens out.  Null
    losses are left out with their bytes.  No bytes at all give null.  Both tables are joined on
    the id; ``token_bytes`` is as large as a vocabulary.
    """
    j = losses.where("nats is not null").join(token_bytes, "token_id")
    mask = (F.col("n_bytes") > 0).cast("double")
    sums = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("n_bytes").cast("long")).alias("n_bytes"),
        F.sum(F.col("nats") * mask).alias("nats"), F.sum(F.when(F.col("n_bytes") > 0, F.col("nats"))).alias("real_nats"),
    )
    bits = lambda c: F.try_divide(F.col(c), F.log(F.lit(2.0)) * F.col("n_bytes"))
    nan = F.isnan("nats")
    return sums.select(
        *keys, "n_tokens", "n_bytes", nan.alias("is_nan"), F.round(F.when(~nan, bits("nats")), 6).alias("bpb"), F.round(bits("real_nats"), 6).alias("bpb_masked")
    )


def unigram_nats(tokens: DataFrame) -> DataFrame:
    """A stand-in for a model's losses: ``nats`` of a token by its share of all tokens."""
    counts = tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("nats", -F.log(F.col("n") / tokens.agg(F.count(F.lit(1))).scalar()))
