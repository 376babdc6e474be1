"""Queries on telemetry and run summaries, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators import ledger, telemetry
from quernstone.sources.tables import table

# The parameter groups and their rates.
GROUPS = [("embedding", 0.6), ("unembedding", 0.004), ("scalar", 0.5), ("muon", 0.04)]


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.normalize(table(spark, d, "telemetry"))


def telemetry_schedules(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.schedules(_steps(spark, d), GROUPS)


def telemetry_ema(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.smoothed_loss(_steps(spark, d))


def telemetry_budget_stop(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.budget_stop(_steps(spark, d))


def telemetry_throughput(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.throughput(_steps(spark, d))


def telemetry_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.run_totals(_steps(spark, d))


def telemetry_fail_fast(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.fail_fast(_steps(spark, d))


def run_timeout(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.timeouts(table(spark, d, "run_summary"))


def log_summary_parse(spark: SparkSession, d: str) -> DataFrame:
    """Summaries written out as log lines and read from them again."""
    written = telemetry.summary_lines(telemetry.summaries(table(spark, d, "run_summary")))
    return telemetry.summaries(telemetry.parse_summary(written))


def log_progress_parse(spark: SparkSession, d: str) -> DataFrame:
    """Steps written out as log lines and read from them again."""
    return telemetry.parse_progress(telemetry.progress_lines(_steps(spark, d))).drop("pct_done")


def ledger_from_logs(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.ledger_rows(ledger.normalize(table(spark, d, "ledger")), table(spark, d, "run_summary"))


QUERIES = (
    telemetry_schedules, telemetry_ema, telemetry_budget_stop, telemetry_throughput, telemetry_run_totals, telemetry_fail_fast, run_timeout,
    log_summary_parse, log_progress_parse, ledger_from_logs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


STEPS = """
WITH t AS (
  SELECT run_tag, exp_no, step, loss, CASE WHEN NOT isnan(dt) THEN dt END AS dt FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY run_tag, exp_no, step ORDER BY loaded_at DESC NULLS LAST, loss DESC NULLS LAST, dt DESC NULLS LAST, mfu DESC NULLS LAST) = 1),
timed AS (
  SELECT *, coalesce(sum(CASE WHEN step > 10 THEN dt END) OVER (PARTITION BY run_tag, exp_no ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
    coalesce(sum(CASE WHEN step > 10 THEN dt END) OVER (PARTITION BY run_tag, exp_no ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS s FROM t),
live AS (
  SELECT *, least(sb / 300e0, 1e0) AS p FROM (SELECT *, coalesce(max(CASE WHEN step >= 10 AND s >= 300 THEN 1 ELSE 0 END)
    OVER (PARTITION BY run_tag, exp_no ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM timed) WHERE over = 0),
sched AS (SELECT *, CASE WHEN p < 0.5e0 THEN 1e0 ELSE (1e0 - p) / 0.5e0 END AS lrm FROM live)
"""
_NUM = "CASE WHEN regexp_full_match(trim(metric_value), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(metric_value) AS DOUBLE) END"
_SUMMARY = "SELECT run_tag, exp_no, " + ", ".join(f"max(CASE WHEN metric_name = '{k}' THEN {_NUM} END) AS {k}" for k in telemetry.SUMMARY_KEYS) + " FROM run_summary GROUP BY run_tag, exp_no"


def oracle_sql() -> dict[str, str]:
    groups = ", ".join(f"('{k}', {x}e0)" for k, x in GROUPS)
    return {
        "telemetry_schedules": STEPS + f"""SELECT run_tag, exp_no, step, kind, round(lrm, 6) AS lrm,
            round(initial_lr * CASE WHEN kind = 'muon' THEN 1e0 ELSE pow(512e0 / 768e0, -0.5e0) END * lrm, 8) AS lr,
            round(CASE WHEN kind = 'muon' THEN (1 - least(step / 300e0, 1e0)) * 0.85e0 + least(step / 300e0, 1e0) * 0.95e0 END, 6) AS momentum,
            round(CASE WHEN kind = 'muon' THEN 0.2e0 * (1e0 - p) END, 6) AS weight_decay FROM sched, (VALUES {groups}) g(kind, initial_lr)""",
        "telemetry_ema": STEPS + """SELECT run_tag, exp_no, step, round(sum(0.1e0 * loss * pow(0.9e0, -n)) OVER w * pow(0.9e0, n) / (1 - pow(0.9e0, n + 1)), 6) AS loss_ema
            FROM (SELECT *, row_number() OVER (PARTITION BY run_tag, exp_no ORDER BY step) - 1 AS n FROM t WHERE loss IS NOT NULL AND NOT isnan(loss))
            WINDOW w AS (PARTITION BY run_tag, exp_no ORDER BY step ROWS UNBOUNDED PRECEDING)""",
        "telemetry_budget_stop": STEPS + """SELECT run_tag, exp_no, step, round(p, 6) AS progress, round(100 * p, 4) AS pct_done, round(greatest(0, 300 - s), 4) AS remaining FROM live""",
        "telemetry_throughput": STEPS + f"""SELECT run_tag, exp_no, step, CAST(floor(524288e0 / dt) AS BIGINT) AS tok_per_sec,
            round(100 * {telemetry.FLOPS_PER_TOKEN}e0 * (524288e0 / dt) / 989.5e12, 4) AS mfu FROM t WHERE dt > 0""",
        "telemetry_run_totals": STEPS + f"""SELECT run_tag, exp_no, count(*) AS n_steps, count(*) * 524288 AS total_tokens,
            round(coalesce(sum(dt) FILTER (step > 10), 0), 4) AS training_seconds,
            round(100 * {telemetry.FLOPS_PER_TOKEN}e0 * 524288 * (CASE WHEN sum(dt) FILTER (step > 10) <> 0 THEN (count(*) - 10) / sum(dt) FILTER (step > 10) END) / 989.5e12, 4) AS steady_mfu,
            arg_max_null(CASE WHEN NOT isnan(loss) THEN loss END, step) AS last_loss FROM t GROUP BY run_tag, exp_no""",
        "telemetry_fail_fast": STEPS + """SELECT run_tag, exp_no, min(bad) AS fail_step, count(*) FILTER (bad IS NULL OR step < bad) AS n_steps, min(bad) IS NOT NULL AS failed
            FROM t LEFT JOIN (SELECT run_tag, exp_no, min(step) AS bad FROM t WHERE isnan(loss) OR loss > 100 GROUP BY ALL) USING (run_tag, exp_no) GROUP BY run_tag, exp_no""",
        "run_timeout": f"SELECT run_tag, exp_no, total_seconds, round(total_seconds - training_seconds, 4) AS other_seconds, total_seconds > 600 AS timed_out FROM ({_SUMMARY})",
        "log_summary_parse": f"SELECT * FROM ({_SUMMARY})",
        "log_progress_parse": """SELECT run_tag, exp_no, CAST(step AS INTEGER) AS step, round(loss, 6) AS loss, round(lrm, 2) AS lrm, round(dt * 1000) / 1000 AS dt, tok_per_sec, round(mfu, 1) AS mfu,
            epoch, CAST(round(remaining) AS INTEGER) AS remaining FROM (SELECT * FROM telemetry
              QUALIFY row_number() OVER (PARTITION BY run_tag, exp_no, step ORDER BY loaded_at DESC NULLS LAST, loss DESC NULLS LAST, dt DESC NULLS LAST, mfu DESC NULLS LAST) = 1)
            WHERE NOT isnan(dt) AND NOT isnan(mfu)""",
        "ledger_from_logs": f"""WITH one AS (SELECT run_tag, exp_no, commit_hash FROM ledger
              QUALIFY row_number() OVER (PARTITION BY run_tag, exp_no ORDER BY logged_at DESC NULLS LAST, status NULLS LAST, val_bpb NULLS LAST, memory_gb NULLS LAST, commit_hash NULLS LAST, description NULLS LAST) = 1),
            s AS ({_SUMMARY}), ok AS (SELECT DISTINCT run_tag, exp_no, true AS has FROM run_summary WHERE metric_name = 'val_bpb')
            SELECT run_tag, exp_no, left(commit_hash, 7) AS commit, CASE WHEN has THEN val_bpb ELSE 0 END AS val_bpb,
              CASE WHEN has THEN round(peak_vram_mb / 1024, 1) ELSE 0 END AS memory_gb, has IS NULL AS crashed
            FROM one LEFT JOIN s USING (run_tag, exp_no) LEFT JOIN ok USING (run_tag, exp_no)""",
    }
