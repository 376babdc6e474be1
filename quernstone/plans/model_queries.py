"""Queries on model arithmetic and vector primitives, with SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import vectors as vec
from quernstone.operators import modelmath as mm
from quernstone.sources.tables import table

DEPTHS = range(2, 27, 2)


def _layers(spark: SparkSession) -> DataFrame:
    return mm.layers(mm.configs(spark, DEPTHS))


def model_config(spark: SparkSession, d: str) -> DataFrame:
    return mm.configs(spark, DEPTHS)


def model_windows(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark).select("depth", "layer", "window", "has_ve")


def model_params(spark: SparkSession, d: str) -> DataFrame:
    return mm.parameters(mm.matrices(_layers(spark)))


def model_shapes(spark: SparkSession, d: str) -> DataFrame:
    return mm.shapes(mm.matrices(_layers(spark)))


def model_flops(spark: SparkSession, d: str) -> DataFrame:
    ls = _layers(spark)
    return mm.flops(ls, mm.parameters(mm.matrices(ls)))


def _vectors(spark: SparkSession, d: str, f: Callable[[Column], Column]) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", vec.doubles(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.posexplode(f(F.col("v"))).alias("i", "y")).withColumn("y", F.round("y", 6) + F.lit(0.0))


def vec_rms_norm(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, vec.rms_norm)


def vec_rotary(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, lambda v: vec.rotary(v, F.pmod(F.col("vec_id"), F.lit(2048))))


def vec_relu2(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, vec.relu2)


def vec_gate(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, vec.gate)


def vec_softcap(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, vec.softcap)


def vec_residual(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, lambda v: vec.residual(vec.relu2(v), v, 0.9, 0.1))


def vec_gather(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of a table of ids: one for each token of ``token_loss``, by the id's remainder by the number of vectors."""
    wanted = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    n = table(spark, d, "embeddings", "vec_id").agg(F.count(F.lit(1))).scalar()
    tokens = table(spark, d, "token_loss", "run_tag", "exp_no", "row_idx", "pos", "token_id").withColumn("vec_id", F.col("token_id") % n)
    return tokens.join(wanted, "vec_id").select("run_tag", "exp_no", "row_idx", "pos", "vec_id", "label", F.size("embedding").alias("n"))


def vec_linear(spark: SparkSession, d: str) -> DataFrame:
    """A fixed matrix of four rows: w = cos(row + col)."""
    w = [[math.cos(row + col) for col in range(64)] for row in range(4)]
    v = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", vec.doubles(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.posexplode(vec.linear(F.col("v"), w)).alias("row", "y")).withColumn("y", F.round("y", 5) + F.lit(0.0))


QUERIES = (model_config, model_windows, model_params, model_shapes, model_flops, vec_rms_norm, vec_rotary, vec_relu2, vec_gate, vec_softcap, vec_residual, vec_gather, vec_linear)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


LAYERS = f"""
WITH c AS (SELECT CAST(d AS INTEGER) AS depth, CAST((d * 64 + 127) // 128 AS INTEGER) AS n_head FROM (SELECT unnest(range({DEPTHS.start}, {DEPTHS.stop}, {DEPTHS.step})) AS d)),
conf AS (SELECT depth, n_head * 128 AS n_embd, n_head FROM c),
lay AS (SELECT depth, n_embd, n_head, CAST(l AS INTEGER) AS layer, CASE WHEN l = depth - 1 OR l % 4 = 3 THEN 2048 ELSE 1024 END AS "window", l % 2 = (depth - 1) % 2 AS has_ve
  FROM (SELECT *, unnest(range(depth)) AS l FROM conf)),
mat AS (
  SELECT depth, 'transformer_matrices' AS component, n_embd AS r, k * n_embd AS c FROM lay, (SELECT unnest([1, 1, 1, 1, 4, 4]) AS k)
  UNION ALL SELECT depth, 'transformer_matrices', n_head, 32 FROM lay WHERE has_ve
  UNION ALL SELECT depth, 'value_embeds', 8192, n_embd FROM lay WHERE has_ve
  UNION ALL SELECT depth, 'scalars', 1, 2 FROM lay
  UNION ALL SELECT depth, unnest(['wte', 'lm_head']), 8192, n_embd FROM conf),
par AS (SELECT depth, component, CAST(sum(CAST(r AS BIGINT) * c) AS BIGINT) AS n_params FROM mat GROUP BY depth, component)
"""
VEC = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n FROM embeddings), e AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(n)) AS i FROM v) "


def _each(expression: str, source: str = "e") -> str:
    return VEC + f"SELECT vec_id, CAST(i AS INTEGER) AS i, round({expression}, 6) + 0.0e0 AS y FROM {source}"


def oracle_sql() -> dict[str, str]:
    angle = "((vec_id % 2048) / pow(1e4, 2 * (i % (n // 2)) / CAST(n AS DOUBLE)))"
    pair = "(SELECT e.*, v.v[CAST(CASE WHEN i < v.n // 2 THEN i + v.n // 2 ELSE i - v.n // 2 END AS BIGINT) + 1] AS z FROM e JOIN v USING (vec_id))"
    return {
        "model_config": LAYERS + "SELECT depth, CAST(n_embd AS INTEGER) AS n_embd, n_head FROM conf",
        "model_windows": LAYERS + 'SELECT depth, layer, "window", has_ve FROM lay',
        "model_params": LAYERS + "SELECT * FROM par UNION ALL SELECT depth, 'total', CAST(sum(n_params) AS BIGINT) FROM par GROUP BY depth",
        "model_shapes": LAYERS + """SELECT depth, CAST(r AS INTEGER) AS n_rows, CAST(c AS INTEGER) AS n_cols, count(*) AS n_matrices FROM (
            SELECT depth, n_embd * unnest([1, 1, 1, 1, 4, 1]) AS r, n_embd * unnest([1, 1, 1, 1, 1, 4]) AS c FROM lay UNION ALL SELECT depth, n_head, 32 FROM lay WHERE has_ve) GROUP BY ALL""",
        "model_flops": LAYERS + """SELECT depth, CAST(6 * n + a AS BIGINT) AS flops_per_token FROM (SELECT depth, sum(n_params) AS n FROM par WHERE component IN ('lm_head', 'transformer_matrices') GROUP BY depth)
            JOIN (SELECT depth, sum(12 * n_head * 128 * least("window", 2048)) AS a FROM lay GROUP BY depth) USING (depth)""",
        "vec_rms_norm": _each("x / sqrt(q / n + 1.1920929e-07)", "(SELECT *, sum(x * x) OVER (PARTITION BY vec_id) AS q FROM e)"),
        "vec_rotary": _each(f"CASE WHEN i < n // 2 THEN x * cos{angle} + z * sin{angle} ELSE x * cos{angle} - z * sin{angle} END", pair),
        "vec_relu2": _each("pow(greatest(x, 0), 2)"),
        "vec_gate": _each("2 / (1 + exp(-x))"),
        "vec_softcap": _each("15 * tanh(x / 15)"),
        "vec_residual": _each("0.9e0 * pow(greatest(x, 0), 2) + 0.1e0 * x"),
        "vec_gather": "SELECT run_tag, exp_no, row_idx, pos, vec_id, label, CAST(len(embedding) AS INTEGER) AS n FROM token_loss JOIN embeddings ON vec_id = token_id % (SELECT count(*) FROM embeddings)",
        "vec_linear": VEC + "SELECT vec_id, CAST(r AS INTEGER) AS row, round(sum(x * cos(r + i)), 5) + 0.0e0 AS y FROM e, (SELECT unnest(range(4)) AS r) WHERE i < 64 GROUP BY vec_id, r",
    }
