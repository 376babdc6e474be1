"""The queries on training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, encoding, leaks, neardup, overlap, packing, pieces, quality, residue
from quernstone.plans.durable import written
from quernstone.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_ids(table(spark, d, "shard", "row_id", "text"), "row_id", "text")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(table(spark, d, "shard", "row_id", "text"), "row_id", "text")


def p2_types(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "shard", "row_id", "text"), "row_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_types(spark, d).where("text_type in ('list', 'table', 'junk')").select("row_id")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "shard", "row_id", "split", "text"), "row_id", "split", "text")


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """What packing must keep, which SQL can follow: every record in its split once, its pieces one after the other, in rows that hold them."""
    rows = p3_rows(spark, d).withColumn("fits", (F.col("used") <= 2049) & (F.col("used") + F.col("unused") == 2049) & (F.col("n_records") == F.size("records")))
    placed = rows.select("split", "fits", F.inline("records"))
    whole = placed.groupBy("split", "row_id").agg(F.min("fits").alias("fits"), F.max(F.col("start") + F.col("length")).alias("until"), F.sum("length").alias("tokens"), F.min("start").alias("since"))
    kept = F.min(F.col("fits") & (F.col("until") == F.col("tokens")) & (F.col("since") == 0))
    return whole.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"), kept.alias("is_whole"))


def _garbled(spark: SparkSession, d: str, ends: DataFrame) -> DataFrame:
    """The cases of problem 1 among the records of ``ends`` (``row_id``)."""
    return written(encoding.garbled_ids(table(spark, d, "shard", "row_id", "text"), "row_id", "text", among=ends).distinct())


def _without_garbled(spark: SparkSession, d: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs of which neither record is a case of problem 1."""
    pairs = written(pairs)
    bad = _garbled(spark, d, pairs.select(F.col(a).alias("row_id")).union(pairs.select(b)).distinct())
    for c in (a, b):
        pairs = pairs.join(bad.withColumnRenamed("row_id", c), c, "left_anti")
    return pairs


def p4_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """All overlaps, garbled records among them, which SQL can follow."""
    return overlap.overlaps(table(spark, d, "shard", "row_id", "split", "text"), "row_id", "split", "text")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _without_garbled(spark, d, p4_overlaps(spark, d), "held_id", "train_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _overlaps(spark, d)
    return pairs.select(F.least("held_id", "train_id").alias("row_id_a"), F.greatest("held_id", "train_id").alias("row_id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_overlaps(spark, d), table(spark, d, "shard"), "row_id", "split", "source")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.linked(table(spark, d, "shard", "row_id", "text"), "row_id", "text", similarity=0.6, size=3, min_words=60)


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, garbled records among them, which SQL can follow."""
    return neardup.all_pairs(*_near(spark, d)).toDF("row_id_a", "row_id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """``p5_pairs`` without garbled records, which go before pairs are listed: of many copies there are far more pairs than records."""
    members, links = _near(spark, d)
    bad = _garbled(spark, d, neardup.paired(members, links).withColumnRenamed("id", "row_id"))
    return neardup.all_pairs(members.join(bad.withColumnRenamed("row_id", "id"), "id", "left_anti"), links).toDF("row_id_a", "row_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups that the pairs of ``p5_found`` make up, with garbled records."""
    return neardup.groups(*_near(spark, d)).withColumnRenamed("id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 0").select("row_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "shard", "row_id", "text"), "row_id", "text")


def p6_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the pieces make up without their overlaps, which SQL can follow."""
    new = F.struct("piece_no", F.substring("piece", F.col("n_overlap") + 1, F.length("piece")).alias("new"))
    whole = p6_pieces(spark, d).groupBy("row_id").agg(F.sort_array(F.collect_list(new)).alias("p"), F.max(F.length("piece")).alias("longest"), F.max("n_overlap").alias("overlap"))
    text = F.array_join("p.new", "")
    return whole.select("row_id", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("md5"), ((F.col("longest") <= 10_000) & (F.col("overlap") <= 200)).alias("is_within"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids spell, which SQL can follow."""
    return bpe.decoded(p7_ids(spark, d), "doc_id", "ids").select("doc_id", F.octet_length("raw").alias("n_bytes"), F.md5("raw").alias("md5"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")
    found = leaks.leaks(docs, "doc_id", "text", items, "item_id", "text")
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("n_words >= 13").select("doc_id", "item_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("is_residue").select("doc_id")


QUERIES = (p1_found, p1_restored, p2_found, p2_types, p3_rows, p3_totals, p4_found, p4_overlaps, p4_report, p5_found, p5_groups, p5_pairs, p6_found, p6_pieces, p6_rebuilt, p7_ids, p7_decoded, p8_found, p8_leaks, p9_found, p9_scores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    runs = """SELECT DISTINCT {id}, array_to_string(w[i : i + 12], ' ') AS run FROM (
        SELECT {id}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"""
    docs, items = runs.format(id="doc_id", table="documents"), runs.format(id="item_id", table="eval_items")
    shingles = """WITH w AS (SELECT row_id, split, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM shard WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT row_id, split, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 60)),
        n AS (SELECT row_id, count(*) AS n FROM s GROUP BY row_id) """
    return {
        "p3_totals": "SELECT split, count(*) AS n_records, true AS is_whole FROM shard WHERE text IS NOT NULL GROUP BY split",
        "p6_rebuilt": "SELECT row_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS md5, true AS is_within FROM shard WHERE length(text) > 10000",
        "p7_decoded": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS INTEGER) AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents",
        "p4_overlaps": shingles + """SELECT a.row_id AS held_id, b.row_id AS train_id, CAST(n AS INTEGER) AS n_held, CAST(count(*) AS INTEGER) AS n_common
            FROM s a JOIN s b ON a.s = b.s AND a.split = 'val' AND b.split = 'train' JOIN n ON n.row_id = a.row_id GROUP BY a.row_id, b.row_id, n HAVING count(*) * 5 >= n * 3""",
        "p5_pairs": shingles + """SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM s a JOIN s b ON a.s = b.s AND a.row_id < b.row_id
            JOIN n x ON x.row_id = a.row_id JOIN n y ON y.row_id = b.row_id GROUP BY a.row_id, b.row_id, x.n, y.n HAVING count(*) * 5 >= (x.n + y.n - count(*)) * 3""",
        "p6_found": "SELECT row_id FROM shard WHERE length(text) > 10000",
        "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({docs}) JOIN ({items}) USING (run)",
    }
