"""Training telemetry: schedules, smoothed loss, time budget, throughput, failures, log lines.

Telemetry is one row for each step of a run; a run is (``run_tag``, ``exp_no``) and has a bounded
number of steps, so windows over a run are bounded too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import finite, number

RUN = ["run_tag", "exp_no"]
# Fixed values of the training setup.
BUDGET_SECONDS, WARMUP_STEPS, BATCH_TOKENS, PEAK_FLOPS = 300.0, 10, 524_288, 989.5e12
FLOPS_PER_TOKEN = 239_078_400
LOSS_LIMIT, TIMEOUT_SECONDS = 100.0, 600.0
SUMMARY_KEYS = ("val_bpb", "training_seconds", "total_seconds", "peak_vram_mb", "mfu_percent", "total_tokens_M", "num_steps", "num_params_M", "depth")


def normalize(steps: DataFrame) -> DataFrame:
    """One row for each step, the one that arrived last; NaN as null but for ``loss``, which keeps it."""
    last = Window.partitionBy(*RUN, "step").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("loss"), F.desc_nulls_last("dt"), F.desc_nulls_last("mfu"))
    one = steps.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return one.withColumns({"dt": finite(F.col("dt")), "mfu": finite(F.col("mfu"))})


def _order(inclusive: bool = True):
    return Window.partitionBy(*RUN).orderBy("step").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def timed(steps: DataFrame) -> DataFrame:
    """Training time with and without each step; steps up to ``WARMUP_STEPS`` don't count."""
    counted = F.when(F.col("step") > WARMUP_STEPS, F.col("dt"))
    total = lambda inclusive: F.coalesce(F.sum(counted).over(_order(inclusive)), F.lit(0.0))
    return steps.withColumns({"seconds_before": total(False), "seconds": total(True)})


def _live(steps: DataFrame, budget: float) -> DataFrame:
    """Steps up to the one at which the time budget is spent, with ``progress`` before each."""
    t = timed(steps)
    over = F.coalesce(F.max(((F.col("step") >= WARMUP_STEPS) & (F.col("seconds") >= budget)).cast("int")).over(_order(False)), F.lit(0))
    return t.withColumn("_over", over).where("_over = 0").withColumn("progress", F.least(F.col("seconds_before") / budget, F.lit(1.0)))


def budget_stop(steps: DataFrame, budget: float = BUDGET_SECONDS) -> DataFrame:
    """Steps up to the one at which the time budget is spent: progress before it, time left after it."""
    return _live(steps, budget).select(
        *RUN, "step", F.round("progress", 6).alias("progress"), F.round(100 * F.col("progress"), 4).alias("pct_done"),
        F.round(F.greatest(F.lit(0.0), budget - F.col("seconds")), 4).alias("remaining"),
    )


def lr_multiplier(progress: Column, warmup: float = 0.0, warmdown: float = 0.5, final: float = 0.0) -> Column:
    """Rises over ``warmup``, is 1, and falls linearly over the last ``warmdown`` to ``final``."""
    cooled = (1.0 - progress) / warmdown
    flat = F.when(progress < 1.0 - warmdown, F.lit(1.0)).otherwise(cooled + (1.0 - cooled) * final)
    return F.when(progress < warmup, progress / warmup).otherwise(flat) if warmup > 0 else flat


def momentum(step: Column) -> Column:
    f = F.least(step / F.lit(300.0), F.lit(1.0))
    return (1.0 - f) * 0.85 + f * 0.95


def weight_decay(progress: Column, initial: float = 0.2) -> Column:
    return initial * (1.0 - progress)


def schedules(steps: DataFrame, groups: list[tuple[str, float]], width: int = 512, budget: float = BUDGET_SECONDS) -> DataFrame:
    """What each parameter group is trained with at each step.

    ``groups`` are kinds and initial rates, a few; only the kind ``muon`` has momentum and
    decay, the others' rates are scaled by the model's width.
    """
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(float(lr)).alias("initial_lr")) for kind, lr in groups))
    each = _live(steps, budget).select(*RUN, "step", "progress", F.inline(kinds))
    muon = F.col("kind") == "muon"
    lr = F.col("initial_lr") * F.when(muon, F.lit(1.0)).otherwise(F.pow(F.lit(width / 768.0), F.lit(-0.5)))
    lrm = lr_multiplier(F.col("progress"))
    return each.select(
        *RUN, "step", "kind", F.round(lrm, 6).alias("lrm"), F.round(lr * lrm, 8).alias("lr"),
        F.round(F.when(muon, momentum(F.col("step"))), 6).alias("momentum"), F.round(F.when(muon, weight_decay(F.col("progress"))), 6).alias("weight_decay"),
    )


#: Steps over which a weighted sum is carried on before it starts afresh; its weights stay far from overflow.
EMA_BLOCK = 1024


def smoothed_loss(steps: DataFrame, decay: float = 0.9) -> DataFrame:
    """Bias-corrected exponential average of the loss; steps without a loss, or with NaN, are passed over.

    Within a block of steps the average is a running sum of losses weighted by rising powers, scaled
    back; the block before carries over, what lies before that is smaller than rounding.  Two windows
    on one partitioning, linear in the length of a run.
    """
    usable = steps.where(F.col("loss").isNotNull() & ~F.isnan("loss")).select(*RUN, "step", "loss")
    run = Window.partitionBy(*RUN).orderBy("step")
    size = min(EMA_BLOCK, max(1, int(300 / -math.log10(decay))))
    t = usable.withColumn("t", F.row_number().over(run) - 1).withColumns({"block": F.floor(F.col("t") / size), "k": F.col("t") % size})
    power = lambda n: F.pow(F.lit(decay), n)
    within = Window.partitionBy(*RUN, "block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    own = t.withColumn("own", F.sum((1 - decay) * F.col("loss") * power(-F.col("k"))).over(within) * power(F.col("k")))
    before = F.last(F.when(F.col("k") == size - 1, F.col("own")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    average = F.col("own") + power(F.col("k") + 1) * F.coalesce("before", F.lit(0.0))
    return own.withColumn("before", before).select(*RUN, "step", F.round(average / (1 - power(F.col("t") + 1)), 6).alias("loss_ema"))


def throughput(steps: DataFrame) -> DataFrame:
    """Tokens a second and utilization of each timed step."""
    rate = F.try_divide(F.lit(float(BATCH_TOKENS)), F.col("dt"))
    known = steps.where("dt > 0")
    return known.select(*RUN, "step", F.floor(rate).cast("long").alias("tok_per_sec"), F.round(100 * FLOPS_PER_TOKEN * rate / PEAK_FLOPS, 4).alias("mfu"))


def run_totals(steps: DataFrame) -> DataFrame:
    """Of each run: steps, tokens, training time, and steady utilization.

    The last divides the tokens of all steps but ``WARMUP_STEPS`` by a time that leaves out one
    step more; it is kept so.
    """
    n = F.count(F.lit(1))
    time = F.sum(F.when(F.col("step") > WARMUP_STEPS, F.col("dt")))
    steady = 100 * FLOPS_PER_TOKEN * BATCH_TOKENS * F.try_divide(n - WARMUP_STEPS, time) / PEAK_FLOPS
    return steps.groupBy(*RUN).agg(
        n.alias("n_steps"), (n * BATCH_TOKENS).alias("total_tokens"), F.round(F.coalesce(time, F.lit(0.0)), 4).alias("training_seconds"),
        F.round(steady, 4).alias("steady_mfu"), F.max_by(F.when(~F.isnan("loss"), F.col("loss")), "step").alias("last_loss"),
    )


def fail_fast(steps: DataFrame, limit: float = LOSS_LIMIT) -> DataFrame:
    """Of each run the first step with a NaN or exploding loss (null if there is none) and ``n_steps``, the steps before it or all."""
    bad = F.isnan("loss") | (F.col("loss") > limit)
    marked = steps.select(*RUN, "step", F.min(F.when(bad, F.col("step"))).over(Window.partitionBy(*RUN)).alias("fail_step"))
    done = F.count_if(F.col("fail_step").isNull() | (F.col("step") < F.col("fail_step")))
    return marked.groupBy(*RUN).agg(F.min("fail_step").alias("fail_step"), done.alias("n_steps")).withColumn("failed", F.col("fail_step").isNotNull())


def summaries(lines: DataFrame) -> DataFrame:
    """Closing summaries, one row a run: ``lines`` has the run, ``metric_name`` and ``metric_value``.

    A repeated metric counts once, by its greatest number; what is no number is null.
    """
    values = lines.withColumn("v", number(F.col("metric_value")))
    return values.groupBy(*RUN).agg(*(F.max(F.when(F.col("metric_name") == k, F.col("v"))).alias(k) for k in SUMMARY_KEYS))


def crashes(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Runs without a line that gives their value."""
    return runs.select(*RUN).distinct().join(lines.where("metric_name = 'val_bpb'").select(*RUN).distinct(), RUN, "left_anti")


def ledger_rows(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """What the ledger records of each run: value and memory in GB, zeros for a crash."""
    s = summaries(lines).select(*RUN, "val_bpb", F.round(F.col("peak_vram_mb") / 1024, 1).alias("memory_gb"))
    j = runs.select(*RUN, F.left("commit_hash", F.lit(7)).alias("commit")).distinct().join(s, RUN, "left").join(
        crashes(runs, lines).withColumn("crashed", F.lit(True)), RUN, "left"
    )
    crashed = F.coalesce("crashed", F.lit(False))
    zero = lambda c: F.when(crashed, F.lit(0.0)).otherwise(F.col(c))
    return j.select(*RUN, "commit", zero("val_bpb").alias("val_bpb"), zero("memory_gb").alias("memory_gb"), crashed.alias("crashed"))


def timeouts(lines: DataFrame, limit: float = TIMEOUT_SECONDS) -> DataFrame:
    """Whole time of each run and whether it went beyond the limit; start-up and evaluation are the rest."""
    s = summaries(lines)
    return s.select(*RUN, "total_seconds", F.round(F.col("total_seconds") - F.col("training_seconds"), 4).alias("other_seconds"), (F.col("total_seconds") > limit).alias("timed_out"))


def accumulation(total: int, device: int, length: int) -> int:
    """Micro-batches in a step; the batch must divide."""
    if total % (device * length):
        raise ValueError("the batch isn't a multiple of a micro-batch")
    return total // (device * length)


def parse_summary(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key: value`` lines of a log as ``metric_name`` and ``metric_value``; other lines are left out."""
    pattern = r"^(\w+):\s+(\S+)\s*$"
    got = lines.select("*", F.regexp_extract(line, pattern, 1).alias("metric_name"), F.regexp_extract(line, pattern, 2).alias("metric_value"))
    return got.where(F.col("metric_name").isin(*SUMMARY_KEYS)).drop(line)


def parse_progress(lines: DataFrame, line: str = "value") -> DataFrame:
    """Progress lines of a log as columns, behind those that come with them; other lines are left out."""
    number = r"(-?[\d.,]+|-?Infinity|NaN|null)"
    pattern = (
        rf"step (-?\d+|null) \({number}%\) \| loss: (\S+) \| lrm: {number} \| dt: {number}ms \| tok/sec: {number}"
        rf"(?: \| mfu: {number}%)?(?: \| epoch: {number})?(?: \| remaining: {number}s)?"
    )
    part = lambda k: F.regexp_extract(line, pattern, k)
    return lines.where(F.col(line).rlike(pattern)).select(
        *(c for c in lines.columns if c != line), part(1).try_cast("int").alias("step"), part(2).try_cast("double").alias("pct_done"), part(3).try_cast("double").alias("loss"), part(4).try_cast("double").alias("lrm"),
        (part(5).try_cast("double") / 1000).alias("dt"), F.replace(part(6), F.lit(","), F.lit("")).try_cast("long").alias("tok_per_sec"),
        part(7).try_cast("double").alias("mfu"), part(8).try_cast("int").alias("epoch"), part(9).try_cast("int").alias("remaining"),
    )


def progress_lines(steps: DataFrame) -> DataFrame:
    """The line that a run logs for each step; a step without a time or utilization has none."""
    known = steps.where("dt is not null and mfu is not null")
    done = 100 * (1 - F.col("remaining") / BUDGET_SECONDS)
    # rounded as numbers, not as their decimal digits, of which the formatter would round 1.005 up
    rounded = lambda c, n: F.round(F.col(c) * 10.0**n) / 10.0**n
    # a precision would cut the word null, too
    shown = lambda f, c: F.when(c.isNull(), F.lit("null")).otherwise(F.format_string(f, c))
    line = F.format_string(
        "step %s (%s%%) | loss: %s | lrm: %s | dt: %.0fms | tok/sec: %s | mfu: %.1f%% | epoch: %s | remaining: %ss    ",
        shown("%05d", F.col("step")), shown("%.1f", done), shown("%.6f", rounded("loss", 6)), shown("%.2f", rounded("lrm", 2)), F.col("dt") * 1000, shown("%,d", F.col("tok_per_sec")),
        rounded("mfu", 1), shown("%d", F.col("epoch")), shown("%.0f", F.col("remaining")),
    )
    return known.select(*RUN, line.alias("value"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """The summary of a run as the lines that its log ends with."""
    shown = {"val_bpb": "%.6f", "training_seconds": "%.1f", "total_seconds": "%.1f", "peak_vram_mb": "%.1f", "mfu_percent": "%.2f", "total_tokens_M": "%.1f", "num_steps": "%.0f", "num_params_M": "%.1f", "depth": "%.0f"}
    line = lambda k, f: F.format_string("%-18s" + f, F.lit(k + ":"), F.col(k).cast("double"))
    return summary.select(*RUN, F.posexplode(F.array(F.lit("---"), *(line(k, f) for k, f in shown.items()))).alias("line_no", "value"))
