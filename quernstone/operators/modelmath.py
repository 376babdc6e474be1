"""Closed forms of a model's size: configuration, parameters, FLOPs, attention windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the model family.
ASPECT, HEAD, VOCAB, LENGTH, PATTERN, GATE_CHANNELS = 64, 128, 8192, 2048, "SSSL", 32


def configs(spark: SparkSession, depths: range) -> DataFrame:
    """``depth``, ``n_embd`` (depth times the aspect, rounded up to whole heads) and ``n_head``."""
    d = spark.range(depths.start, depths.stop, depths.step).select(F.col("id").cast("int").alias("depth"))
    heads = F.ceil(F.col("depth") * ASPECT / HEAD).cast("int")
    return d.select("depth", (heads * HEAD).alias("n_embd"), heads.alias("n_head"))


def has_value_embedding(layer: Column, depth: Column) -> Column:
    """Every second layer, the last among them."""
    return F.pmod(layer, F.lit(2)) == F.pmod(depth - 1, F.lit(2))


def layers(configs: DataFrame, pattern: str = PATTERN, length: int = LENGTH) -> DataFrame:
    """A row for each layer: its window and whether it has a value embedding.

    Windows go round the pattern, ``S`` half and ``L`` the whole length; the last layer has the
    whole.
    """
    if set(pattern) - set("SL") or not pattern:
        raise ValueError("a pattern is made of S and L")
    each = configs.select("*", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("layer"))
    mark = F.substring(F.lit(pattern), F.pmod(F.col("layer"), F.lit(len(pattern))) + 1, F.lit(1))
    window = F.when(F.col("layer") == F.col("depth") - 1, F.lit(length)).when(mark == "L", F.lit(length)).otherwise(F.lit(length // 2))
    return each.select("depth", "n_embd", "n_head", "layer", window.alias("window"), has_value_embedding(F.col("layer"), F.col("depth")).alias("has_ve"))


def matrices(layers: DataFrame, vocab: int = VOCAB) -> DataFrame:
    """Every parameter tensor: ``component``, ``n_rows``, ``n_cols``; scalars are one row of one column each."""
    e, kv = F.col("n_embd"), F.col("n_head") * HEAD
    m = lambda name, r, c: F.struct(F.lit(name).alias("component"), r.cast("int").alias("n_rows"), c.cast("int").alias("n_cols"))
    one = F.lit(1)
    block = [m("transformer_matrices", kv, e)] * 3 + [m("transformer_matrices", e, e), m("transformer_matrices", 4 * e, e), m("transformer_matrices", e, 4 * e), m("scalars", one, one), m("scalars", one, one)]
    value = [m("value_embeds", F.lit(vocab), kv), m("transformer_matrices", F.col("n_head"), F.lit(GATE_CHANNELS))]
    none = F.array().cast("array<struct<component:string,n_rows:int,n_cols:int>>")
    ends = F.when(F.col("layer") == 0, F.array(m("wte", F.lit(vocab), e), m("lm_head", F.lit(vocab), e))).otherwise(none)
    tensors = F.concat(F.array(*block), F.when(F.col("has_ve"), F.array(*value)).otherwise(none), ends)
    return layers.select("depth", "layer", F.explode(tensors).alias("t")).select("depth", "layer", "t.*")


def parameters(matrices: DataFrame) -> DataFrame:
    """Parameters by component and, as ``total``, of each depth."""
    by = matrices.groupBy("depth", "component").agg(F.sum(F.col("n_rows").cast("long") * F.col("n_cols")).alias("n_params"))
    return by.unionByName(by.groupBy("depth").agg(F.sum("n_params").alias("n_params")).withColumn("component", F.lit("total")).select("depth", "component", "n_params"))


def shapes(matrices: DataFrame) -> DataFrame:
    """Matrices of the blocks by shape: those of one shape are trained together."""
    return matrices.where("component = 'transformer_matrices'").groupBy("depth", "n_rows", "n_cols").agg(F.count(F.lit(1)).alias("n_matrices"))


def flops(layers: DataFrame, params: DataFrame) -> DataFrame:
    """Training FLOPs a token: six for each parameter that is multiplied, and attention by window."""
    attention = layers.groupBy("depth").agg(F.sum(F.lit(12).cast("long") * F.col("n_head") * HEAD * F.least(F.col("window"), F.lit(LENGTH))).alias("attention"))
    used = params.where("component in ('lm_head', 'transformer_matrices')").groupBy("depth").agg(F.sum("n_params").alias("n_used"))
    return used.join(attention, "depth").select("depth", (6 * F.col("n_used") + F.col("attention")).alias("flops_per_token"))
