"""Experiment ledgers: normal form, outcomes, frontiers, improvements, the keep rule.

All ledgers are in one table by ``run_tag``; a row's place in its ledger is ``exp_no``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import label, number, stripped
from quernstone.plans.running import ranked, running

COLUMNS = ("run_tag", "exp_no", "commit_hash", "val_bpb", "memory_gb", "status", "description")


def normalize(ledger: DataFrame) -> DataFrame:
    """One row for each experiment: numbers as numbers (null where they are none), status in capitals.

    Of an experiment written more than once the row logged last counts; of rows logged at
    the same time the one that sorts first.  Descriptions keep their quotation marks.
    """
    raw = ["logged_at", "status", "val_bpb", "memory_gb", "commit_hash", "description"]
    first = Window.partitionBy("run_tag", "exp_no").orderBy(F.desc_nulls_last("logged_at"), *(F.asc_nulls_last(c) for c in raw[1:]))
    one = ledger.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select(
        "run_tag", "exp_no", "commit_hash", number(F.col("val_bpb")).alias("val_bpb"), number(F.col("memory_gb")).alias("memory_gb"),
        F.upper(stripped(F.col("status"))).alias("status"), "description",
    )


def kept(led: DataFrame) -> DataFrame:
    """Kept experiments with their place in the ledger."""
    return led.where("status = 'KEEP'")


def valid(led: DataFrame) -> DataFrame:
    """All but crashes; an unknown status (null) stays."""
    return led.where(~F.col("status").eqNullSafe("CRASH"))


def outcomes(led: DataFrame) -> DataFrame:
    """Experiments by status and tag, without those of null status."""
    return led.where("status is not null").groupBy("run_tag", "status").agg(F.count(F.lit(1)).alias("n"))


def keep_rate(led: DataFrame) -> DataFrame:
    """Kept, discarded and crashed experiments of each ledger, and the share kept of those decided."""
    count = lambda s: F.count_if(F.col("status") == s)
    counts = led.groupBy("run_tag").agg(F.count(F.lit(1)).alias("n_total"), count("KEEP").alias("n_keep"), count("DISCARD").alias("n_discard"), count("CRASH").alias("n_crash"))
    decided = F.col("n_keep") + F.col("n_discard")
    return counts.withColumn("keep_rate", F.round(F.when(decided > 0, F.col("n_keep") / decided), 6))


def preview(led: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each ledger, whatever their numbers."""
    first = Window.partitionBy("run_tag").orderBy("exp_no")
    return led.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def effort(led: DataFrame) -> DataFrame:
    """Each kept experiment with its number among the kept and the experiments it took since the one before."""
    k = running(kept(led), ["run_tag"], "exp_no", {"nth": ("sum", F.lit(1), True), "before": ("last", F.col("exp_no"), False)})
    took = F.col("exp_no") - F.coalesce("before", F.lit(-1))
    return k.select("run_tag", "exp_no", F.col("nth").cast("long").alias("nth"), took.alias("n_tried"), F.round("val_bpb", 6).alias("val_bpb"), stripped(F.coalesce("description", F.lit("nan"))).alias("description"))


def baselines(led: DataFrame) -> DataFrame:
    """The first value of each ledger, of any status (``baseline``) and of those that didn't crash (``valid_baseline``)."""
    ran = ~F.col("status").eqNullSafe("CRASH")
    first = lambda on: F.min_by(F.struct("val_bpb"), F.when(on, F.col("exp_no")))["val_bpb"]
    return led.groupBy("run_tag").agg(first(F.lit(True)).alias("baseline"), first(ran).alias("valid_baseline"))


def frontier(led: DataFrame, slack: float = 0.0005) -> DataFrame:
    """What a plot of progress shows: a row for each experiment that didn't crash.

    ``idx`` numbers them from 0; ``running_best`` is the least kept value so far, at kept rows that
    have a value; ``frontier`` carries it forward; ``is_below`` marks values up to the baseline and
    ``slack``; ``label`` is the short description of kept ones.
    """
    v = valid(led)
    keep = F.col("status") == "KEEP"
    best = F.when(keep, F.col("val_bpb"))
    r = running(v, ["run_tag"], "exp_no", {"n_before": ("sum", F.lit(1), False), "best": ("min", best, True)})
    r = r.join(baselines(led).select("run_tag", "valid_baseline"), "run_tag")
    below = F.coalesce(F.col("val_bpb") <= F.col("valid_baseline") + slack, F.lit(False))
    return r.select(
        "run_tag", "exp_no", F.coalesce("n_before", F.lit(0)).cast("long").alias("idx"), "status", "val_bpb", below.alias("is_below"),
        F.when(best.isNotNull(), F.col("best")).alias("running_best"), F.col("best").alias("frontier"), F.when(keep, label(F.col("description"))).alias("label"),
    )


def axis_limits(led: DataFrame) -> DataFrame:
    best = kept(led).groupBy("run_tag").agg(F.min("val_bpb").alias("best"))
    j = baselines(led).join(best, "run_tag")
    margin = (F.col("valid_baseline") - F.col("best")) * 0.15
    return j.select("run_tag", F.round(F.col("best") - margin, 6).alias("y_low"), F.round(F.col("valid_baseline") + margin, 6).alias("y_high"))


def summary(led: DataFrame) -> DataFrame:
    """Baseline, best kept value and its experiment (the earliest of equals), and the improvement."""
    best = kept(led).where("val_bpb is not null").groupBy("run_tag").agg(F.min(F.struct("val_bpb", "exp_no", "description")).alias("b"))
    j = baselines(led).join(best, "run_tag", "left")
    gain = F.col("baseline") - F.col("b.val_bpb")
    return j.select(
        "run_tag", "baseline", F.col("b.val_bpb").alias("best"), F.col("b.exp_no").alias("best_exp_no"), F.round(gain, 6).alias("improvement"),
        F.round(F.try_divide(gain, F.col("baseline")) * 100, 4).alias("improvement_pct"), F.col("b.description").alias("best_description"),
    )


def hits(led: DataFrame) -> DataFrame:
    """Kept experiments but the first of each ledger, with what each improved on the one before."""
    before = {"any_before": ("sum", F.lit(1), False), "prev": ("last", F.struct("val_bpb"), False)}
    k = running(kept(led), ["run_tag"], "exp_no", before).where("any_before is not null")
    return k.select("run_tag", "exp_no", "val_bpb", F.col("prev.val_bpb").alias("prev_bpb"), (F.col("prev.val_bpb") - F.col("val_bpb")).alias("delta"), "description")


def top_hits(led: DataFrame) -> DataFrame:
    """Hits ranked by improvement within their ledger, unknown improvements last, then by place."""
    order = [F.desc_nulls_last("delta"), F.asc("exp_no")]
    by_place = ranked(hits(led).withColumn("delta", F.round("delta", 6)), ["run_tag"], "delta", order, "rank")
    return by_place.select("run_tag", F.col("rank").cast("int").alias("rank"), "exp_no", "delta", F.round("val_bpb", 6).alias("val_bpb"), "description")


def hits_total(led: DataFrame) -> DataFrame:
    """Sum of all improvements of each ledger with a kept row; of none it is 0."""
    total = hits(led).groupBy("run_tag").agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n"))
    tags = kept(led).select("run_tag").distinct()
    return tags.join(total, "run_tag", "left").select("run_tag", F.coalesce("n", F.lit(0)).alias("n_hits"), F.round(F.coalesce("d", F.lit(0.0)), 6).alias("total_delta"))


def keep_rule(led: DataFrame) -> DataFrame:
    """What the rule decides: keep what is below all earlier values that didn't crash, or is the first."""
    value = F.when(~F.col("status").eqNullSafe("CRASH"), F.col("val_bpb"))
    r = running(led, ["run_tag"], "exp_no", {"best": ("min", value, False)})
    decided = (
        F.when(F.col("status").eqNullSafe("CRASH"), "CRASH")
        .when(value.isNotNull() & (F.col("best").isNull() | (value < F.col("best"))), "KEEP")
        .otherwise("DISCARD")
    )
    return r.select("run_tag", "exp_no", "status", decided.alias("decided"))


def branch_tip(led: DataFrame) -> DataFrame:
    """The commit that the branch stands at after each experiment: the last one kept."""
    tip = F.when(F.col("status") == "KEEP", F.col("commit_hash"))
    return running(led, ["run_tag"], "exp_no", {"tip": ("last", tip, True)}).select("run_tag", "exp_no", "tip")
