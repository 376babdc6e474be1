"""Queries on experiment ledgers, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators import ledger
from quernstone.plans.durable import step_path
from quernstone.sources import files
from quernstone.sources.tables import table

OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ledger_normalize": lambda led: led,
    "ledger_preview": ledger.preview,
    "ledger_outcomes": ledger.outcomes,
    "ledger_keep_rate": ledger.keep_rate,
    "ledger_kept": ledger.kept,
    "ledger_frontier": ledger.frontier,
    "ledger_axis_limits": ledger.axis_limits,
    "ledger_summary": ledger.summary,
    "ledger_effort": ledger.effort,
    "ledger_top_hits": ledger.top_hits,
    "ledger_hits_total": ledger.hits_total,
    "ledger_keep_rule": ledger.keep_rule,
    "ledger_branch_tip": ledger.branch_tip,
}


def ledger_tsv(spark: SparkSession, d: str) -> DataFrame:
    """All rows written as a tab-separated ledger and read from it again."""
    folder = step_path(spark)
    files.append_ledger(table(spark, d, "ledger").withColumnRenamed("commit_hash", "commit"), folder)
    return files.read_ledger(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"ledger_tsv": ledger_tsv} | {name: lambda spark, d, f=f: f(ledger.normalize(table(spark, d, "ledger"))) for name, f in OPERATORS.items()}


def _number(c: str) -> str:
    s = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({s} AS DOUBLE) END"


LED = f"""
WITH one AS (
  SELECT *, row_number() OVER (PARTITION BY run_tag, exp_no ORDER BY logged_at DESC NULLS LAST, status NULLS LAST, val_bpb NULLS LAST,
    memory_gb NULLS LAST, commit_hash NULLS LAST, description NULLS LAST) AS rn FROM ledger),
led AS (
  SELECT run_tag, exp_no, commit_hash, {_number("val_bpb")} AS val_bpb, {_number("memory_gb")} AS memory_gb,
    upper(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) AS status, description FROM one WHERE rn = 1),
kept AS (SELECT * FROM led WHERE status = 'KEEP'),
valid AS (SELECT * FROM led WHERE status IS DISTINCT FROM 'CRASH'),
base AS (
  SELECT b.run_tag, b.val_bpb AS baseline, v.val_bpb AS valid_baseline
  FROM (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY run_tag ORDER BY exp_no) = 1) b
  LEFT JOIN (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY run_tag ORDER BY exp_no) = 1) v USING (run_tag)),
hit AS (
  SELECT run_tag, exp_no, val_bpb, lag(val_bpb) OVER w - val_bpb AS delta, description, row_number() OVER w AS n
  FROM kept WINDOW w AS (PARTITION BY run_tag ORDER BY exp_no))
"""
STRIP = "regexp_replace(coalesce(description, 'nan'), '^\\s+|\\s+$', '', 'g')"

_SQL = {
    "ledger_tsv": """SELECT commit_hash AS commit, nullif(val_bpb, '') AS val_bpb, nullif(memory_gb, '') AS memory_gb, nullif(status, '') AS status, nullif(description, '') AS description FROM ledger""",
    "ledger_normalize": "SELECT * FROM led",
    "ledger_preview": "SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY run_tag ORDER BY exp_no) <= 10",
    "ledger_outcomes": "SELECT run_tag, status, count(*) AS n FROM led WHERE status IS NOT NULL GROUP BY ALL",
    "ledger_keep_rate": """SELECT run_tag, count(*) AS n_total, count(*) FILTER (status = 'KEEP') AS n_keep, count(*) FILTER (status = 'DISCARD') AS n_discard,
        count(*) FILTER (status = 'CRASH') AS n_crash,
        round(CASE WHEN count(*) FILTER (status IN ('KEEP', 'DISCARD')) > 0
          THEN count(*) FILTER (status = 'KEEP') / count(*) FILTER (status IN ('KEEP', 'DISCARD')) END, 6) AS keep_rate FROM led GROUP BY run_tag""",
    "ledger_kept": "SELECT * FROM kept",
    "ledger_frontier": f"""SELECT run_tag, exp_no, row_number() OVER w - 1 AS idx, status, val_bpb,
        coalesce(val_bpb <= valid_baseline + 0.0005e0, false) AS is_below,
        CASE WHEN status = 'KEEP' AND val_bpb IS NOT NULL THEN min(CASE WHEN status = 'KEEP' THEN val_bpb END) OVER w END AS running_best,
        min(CASE WHEN status = 'KEEP' THEN val_bpb END) OVER w AS frontier,
        CASE WHEN status = 'KEEP' THEN CASE WHEN length({STRIP}) > 45 THEN left({STRIP}, 42) || '...' ELSE {STRIP} END END AS label
        FROM valid JOIN base USING (run_tag) WINDOW w AS (PARTITION BY run_tag ORDER BY exp_no ROWS UNBOUNDED PRECEDING)""",
    "ledger_axis_limits": """SELECT run_tag, round(best - (valid_baseline - best) * 0.15e0, 6) AS y_low, round(valid_baseline + (valid_baseline - best) * 0.15e0, 6) AS y_high
        FROM base JOIN (SELECT run_tag, min(val_bpb) AS best FROM kept GROUP BY run_tag) USING (run_tag)""",
    "ledger_summary": """SELECT run_tag, baseline, val_bpb AS best, exp_no AS best_exp_no, round(baseline - val_bpb, 6) AS improvement,
        round(CASE WHEN baseline <> 0 THEN (baseline - val_bpb) / baseline END * 100, 4) AS improvement_pct, description AS best_description
        FROM base LEFT JOIN (SELECT * FROM kept WHERE val_bpb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_tag ORDER BY val_bpb, exp_no) = 1) USING (run_tag)""",
    "ledger_effort": f"""SELECT run_tag, exp_no, row_number() OVER w AS nth, exp_no - coalesce(lag(exp_no) OVER w, -1) AS n_tried,
        round(val_bpb, 6) AS val_bpb, {STRIP} AS description FROM kept WINDOW w AS (PARTITION BY run_tag ORDER BY exp_no)""",
    "ledger_top_hits": """SELECT run_tag, CAST(row_number() OVER (PARTITION BY run_tag ORDER BY round(delta, 6) DESC NULLS LAST, exp_no) AS INTEGER) AS rank, exp_no,
        round(delta, 6) AS delta, round(val_bpb, 6) AS val_bpb, description FROM hit WHERE n > 1""",
    "ledger_hits_total": """SELECT run_tag, count(*) FILTER (n > 1) AS n_hits, round(coalesce(sum(delta) FILTER (n > 1), 0), 6) AS total_delta FROM hit GROUP BY run_tag""",
    "ledger_keep_rule": """SELECT run_tag, exp_no, status, CASE WHEN status IS NOT DISTINCT FROM 'CRASH' THEN 'CRASH'
        WHEN v IS NOT NULL AND (best IS NULL OR v < best) THEN 'KEEP' ELSE 'DISCARD' END AS decided
        FROM (SELECT *, min(v) OVER (PARTITION BY run_tag ORDER BY exp_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
          FROM (SELECT *, CASE WHEN status IS DISTINCT FROM 'CRASH' THEN val_bpb END AS v FROM led))""",
    "ledger_branch_tip": """SELECT run_tag, exp_no, last_value(CASE WHEN status = 'KEEP' THEN commit_hash END IGNORE NULLS)
        OVER (PARTITION BY run_tag ORDER BY exp_no ROWS UNBOUNDED PRECEDING) AS tip FROM led""",
}


def oracle_sql() -> dict[str, str]:
    return {name: LED + sql for name, sql in _SQL.items()}
