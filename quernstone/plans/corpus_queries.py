"""Queries on the corpus, tokens, packed rows and their metric, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import tokenizer as tok
from quernstone.operators import corpus, metrics, packing
from quernstone.plans.durable import spread
from quernstone.sources.tables import table

PLANNED, BUDGET, EPOCHS = 64, 1_000_000_000, 2


def shard_plan(spark: SparkSession, d: str) -> DataFrame:
    return corpus.plan_shards(table(spark, d, "shard", "shard_id"), PLANNED)


def corpus_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split_counts(table(spark, d, "shard", "shard_id", "text"))


def corpus_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.capped(table(spark, d, "documents", "doc_id", "text").withColumn("n_chars", F.length("text")))
    return docs.select("doc_id", "n_chars", F.length("text").alias("n_capped"), F.octet_length("text").alias("n_bytes"))


def corpus_char_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "shard", "row_id", "shard_id", "rg_id", "pos", "text")
    return corpus.char_budget(corpus.train(docs), BUDGET).select("row_id", "shard_id", "n_chars", "before")


def corpus_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.batches(table(spark, d, "shard", "shard_id", "rg_id", "pos", "row_id", "text"), EPOCHS)
    return rows.select("epoch", "shard_id", "rg_id", "batch_no", "n_docs", F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ",").alias("rows"))


def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    return tok.pretoken_counts(spread(table(spark, d, "documents", "text")), "text")


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return tok.pair_counts(pretoken_counts(spark, d))


def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    return docs.select("doc_id", tok.bpe_encode(F.col("text"), tok.BOS).alias("ids"))


def bpe_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again, and whether it is the same."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    back = docs.withColumn("back", tok.bpe_decode(tok.bpe_encode(F.col("text"))))
    return back.select("doc_id", F.length("back").alias("n_chars"), F.col("text").eqNullSafe(F.col("back")).alias("is_same"))


def special_ids(spark: SparkSession, d: str) -> DataFrame:
    """Special tokens' ids behind the merges of the ``token_bytes`` table."""
    return tok.special_ids(table(spark, d, "token_bytes").where("n_bytes > 0"))


def token_bytes(spark: SparkSession, d: str) -> DataFrame:
    return tok.token_bytes(tok.merge_table(spark))


def pack_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "shard", "row_id", "shard_id", "rg_id", "pos", "text").where("text is not null"))
    group = F.concat_ws("-", "shard_id", "rg_id").alias("pack_group")
    sized = docs.select(group, "pos", F.col("row_id").alias("doc"), F.size(tok.bpe_encode(F.col("text"), tok.BOS)).alias("n_tokens"))
    return packing.pack_rows(sized)


def pack_byte_rows(spark: SparkSession, d: str) -> DataFrame:
    """Packed as if every byte were a token, which SQL can follow."""
    docs = table(spark, d, "shard", "row_id", "shard_id", "rg_id", "pos", "text").where("text is not null")
    sized = docs.select(F.concat_ws("-", "shard_id", "rg_id").alias("pack_group"), "pos", F.col("row_id").alias("doc"), (F.octet_length("text") + 1).alias("n_tokens"))
    return packing.pack_rows(sized)


ROW = ["run_tag", "exp_no", "row_idx"]


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def shift_targets(spark: SparkSession, d: str) -> DataFrame:
    return packing.shift_targets(table(spark, d, "token_loss"), ROW).select(*ROW, _joined("inputs"), _joined("targets"))


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = packing.eval_rows(packing.shift_targets(table(spark, d, "token_loss"), ROW), steps=80, batch=4)
    return rows.select(*ROW, "step", F.size("targets").alias("n_targets"))


def bpb_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bits_per_byte(table(spark, d, "token_loss"), table(spark, d, "token_bytes"), ["run_tag", "exp_no"])


def bpb_unigram(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "token_loss", "run_tag", "exp_no", "token_id")
    scored = tokens.join(metrics.unigram_nats(tokens).select("token_id", "nats"), "token_id")
    return metrics.bits_per_byte(scored, table(spark, d, "token_bytes"), ["run_tag", "exp_no"])


QUERIES = (
    shard_plan, corpus_split_counts, corpus_doc_cap, corpus_char_budget, corpus_batches, pretoken_counts, pair_counts, bpe_encode, bpe_decode, special_ids,
    token_bytes, pack_rows, pack_byte_rows, shift_targets, eval_rows, bpb_runs, bpb_unigram,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_BPB = """SELECT run_tag, exp_no, count(*) AS n_tokens, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, isnan(sum(nats * CASE WHEN n_bytes > 0 THEN 1 ELSE 0 END)) AS is_nan,
  round(CASE WHEN NOT isnan(sum(nats * CASE WHEN n_bytes > 0 THEN 1 ELSE 0 END)) AND sum(n_bytes) > 0
    THEN sum(nats * CASE WHEN n_bytes > 0 THEN 1 ELSE 0 END) / (ln(2) * sum(n_bytes)) END, 6) AS bpb,
  round(CASE WHEN sum(n_bytes) > 0 THEN sum(nats) FILTER (n_bytes > 0) / (ln(2) * sum(n_bytes)) END, 6) AS bpb_masked
  FROM {losses} JOIN token_bytes USING (token_id) WHERE nats IS NOT NULL GROUP BY run_tag, exp_no"""


def oracle_sql() -> dict[str, str]:
    return {
        "shard_plan": f"""SELECT CAST(i AS INTEGER) AS shard_id, printf('shard_%05d.parquet', i) AS file_name, i IN (SELECT shard_id FROM shard) AS is_present
            FROM (SELECT unnest(range({PLANNED})) AS i UNION SELECT 6542)""",
        "corpus_split_counts": """SELECT CASE WHEN shard_id = 6542 THEN 'val' ELSE 'train' END AS split, count(DISTINCT shard_id) AS n_shards, count(*) AS n_rows,
            count(text) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM shard GROUP BY ALL""",
        "corpus_doc_cap": """SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(length(substr(text, 1, 10000)) AS INTEGER) AS n_capped,
            CAST(strlen(substr(text, 1, 10000)) AS INTEGER) AS n_bytes FROM documents""",
        "corpus_char_budget": f"""SELECT row_id, shard_id, n_chars, before FROM (
            SELECT row_id, shard_id, CAST(n AS INTEGER) AS n_chars, CAST(coalesce(sum(n) OVER (ORDER BY shard_id, rg_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
              row_number() OVER (ORDER BY shard_id, rg_id, pos) AS nth
            FROM (SELECT *, length(substr(text, 1, 10000)) AS n FROM shard WHERE shard_id <> 6542 AND text IS NOT NULL)) WHERE before < {BUDGET} OR nth = 1""",
        "corpus_batches": f"""SELECT CAST(e AS INTEGER) AS epoch, shard_id, rg_id, batch_no, count(*) AS n_docs, string_agg(row_id, ',' ORDER BY pos) AS rows
            FROM (SELECT *, (row_number() OVER (PARTITION BY shard_id, rg_id ORDER BY pos) - 1) // 128 AS batch_no FROM shard WHERE text IS NOT NULL),
              (SELECT unnest(range(1, {EPOCHS + 1})) AS e) GROUP BY ALL""",
        "bpe_decode": """SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, true AS is_same FROM documents""",
        "special_ids": """SELECT '<|reserved_' || k || '|>' AS token, CAST(n + k AS INTEGER) AS token_id FROM (SELECT count(*) AS n FROM token_bytes WHERE n_bytes > 0), (SELECT unnest(range(4)) AS k)""",
        # the longest document that fits, else the shortest, of equals the first; groups of fewer than 1,000 documents, whose pool holds all from the start
        "pack_byte_rows": """WITH RECURSIVE pool AS (
              SELECT shard_id || '-' || rg_id AS pack_group, list({'n': CAST(strlen(text) + 1 AS INTEGER), 'pos': pos, 'doc': row_id}) AS l FROM shard WHERE text IS NOT NULL GROUP BY ALL),
            placed AS (
              SELECT pack_group, l, 2049 AS room, 0 AS row_idx, -1 AS slot, CAST(NULL AS STRUCT(n INTEGER, pos BIGINT, doc BIGINT)) AS p, 0 AS n_taken FROM pool
              UNION ALL
              SELECT pack_group, list_filter(l, lambda x: x.pos <> c.pos), CASE WHEN room = least(c.n, room) THEN 2049 ELSE room - c.n END,
                CASE WHEN full_ THEN row_idx + 1 ELSE row_idx END, CASE WHEN full_ THEN 0 ELSE slot + 1 END, c, least(c.n, room)
              FROM (SELECT *, slot >= 0 AND room = 2049 AS full_, coalesce(
                  list_sort(list_transform(list_filter(l, lambda x: x.n <= room), lambda x: {'m': -x.n, 'pos': x.pos, 'c': x}))[1].c,
                  list_sort(list_transform(l, lambda x: {'m': x.n, 'pos': x.pos, 'c': x}))[1].c) AS c FROM placed WHERE len(l) > 0))
            SELECT pack_group, row_idx, 1 AS epoch, slot, p.doc AS doc, n_taken, p.n AS n_tokens FROM placed WHERE slot >= 0
            QUALIFY sum(n_taken) OVER (PARTITION BY pack_group, row_idx) = 2049""",
        "shift_targets": """SELECT run_tag, exp_no, row_idx, string_agg(token_id, ',' ORDER BY pos) FILTER (nxt IS NOT NULL) AS inputs, string_agg(nxt, ',' ORDER BY pos) AS targets
            FROM (SELECT *, lead(token_id) OVER (PARTITION BY run_tag, exp_no, row_idx ORDER BY pos) AS nxt FROM token_loss) GROUP BY ALL""",
        "eval_rows": """SELECT run_tag, exp_no, row_idx, CAST(row_idx // 4 AS INTEGER) AS step, CAST(count(*) - 1 AS INTEGER) AS n_targets FROM token_loss WHERE row_idx < 320 GROUP BY ALL""",
        "bpb_runs": _BPB.format(losses="token_loss"),
        "bpb_unigram": _BPB.format(
            losses="(SELECT run_tag, exp_no, token_id, -ln(c / t) AS nats FROM token_loss JOIN (SELECT token_id, count(*) AS c, sum(count(*)) OVER () AS t FROM token_loss GROUP BY token_id) USING (token_id))"
        ),
    }
