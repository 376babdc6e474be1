import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.operators import ledger
from quernstone.plans.running import ranked, running

SCHEMA = "run_tag string, exp_no long, commit_hash string, val_bpb string, memory_gb string, status string, description string, logged_at timestamp"


def make(spark, rows):
    full = [(t, n, c, v, m, s, d, datetime(2026, 1, 1) + timedelta(minutes=n or 0)) for t, n, c, v, m, s, d in rows]
    return spark.createDataFrame(full, SCHEMA)


GOLDEN = [
    ("t", 0, "a1b2c3d", "0.997900", "44.0", "keep", "baseline"),
    ("t", 1, "b2c3d4e", "0.993200", "44.2", "keep", "increase LR to 0.04"),
    ("t", 2, "c3d4e5f", "1.005000", "44.0", "discard", "switch to GeLU activation"),
    ("t", 3, "d4e5f6a", "0.000000", "0.0", "crash", "double model width (OOM)"),
]


@pytest.fixture(scope="module")
def golden(spark):
    return ledger.normalize(make(spark, GOLDEN)).cache()


def test_golden_counts_and_rate(golden):
    r = ledger.keep_rate(golden).first()
    assert (r.n_total, r.n_keep, r.n_discard, r.n_crash, r.keep_rate) == (4, 2, 1, 1, round(2 / 3, 6))


def test_golden_summary_and_hits(golden):
    s = ledger.summary(golden).first()
    assert (s.baseline, s.best, s.best_exp_no, s.best_description) == (0.9979, 0.9932, 1, "increase LR to 0.04")
    assert s.improvement == pytest.approx(0.0047) and s.improvement_pct == pytest.approx(0.471, abs=1e-3)
    hits = ledger.top_hits(golden).collect()
    assert [(h.rank, h.exp_no, h.delta) for h in hits] == [(1, 1, 0.0047)]
    assert ledger.hits_total(golden).first().total_delta == pytest.approx(0.0047)


def test_golden_frontier_axis_and_rule(golden):
    f = {r.exp_no: r for r in ledger.frontier(golden).collect()}
    assert [n for n in sorted(f) if f[n].is_below] == [0, 1] and f[2].frontier == 0.9932 and f[2].running_best is None
    a = ledger.axis_limits(golden).first()
    assert (a.y_low, a.y_high) == (0.992495, 0.998605)
    assert [r.decided for r in ledger.keep_rule(golden).orderBy("exp_no").collect()] == ["KEEP", "KEEP", "DISCARD", "CRASH"]
    assert [r.tip for r in ledger.branch_tip(golden).orderBy("exp_no").collect()] == ["a1b2c3d", "b2c3d4e", "b2c3d4e", "b2c3d4e"]


def test_normalization_of_dirt(spark):
    led = ledger.normalize(make(spark, [
        ("t", 0, None, " 1.5 ", "44,1", "\t Keep ", None), ("t", 1, "c", "oops", "NaN", None, '"quoted" d'), ("t", 2, "c", "NaN", "inf", "", ""), ("t", 3, "c", None, None, "?", "x"),
    ]))
    r = led.orderBy("exp_no").collect()
    assert [x.val_bpb for x in r] == [1.5, None, None, None] and [x.memory_gb for x in r] == [None] * 4
    assert r[0].status == "KEEP" and r[1].status is None and r[1].description == '"quoted" d'
    assert {x.exp_no for x in ledger.valid(led).collect()} == {0, 1, 2, 3}  # an unknown status isn't a crash
    assert {x.status for x in ledger.outcomes(led).collect()} == {"KEEP", "", "?"}


def test_rows_written_twice_count_by_the_last(spark):
    rows = [("t", 0, "c", "1.0", "1", s, "d", datetime.fromisoformat(w)) for s, w in (("keep", "2026-01-01"), ("crash", "2026-01-02"), ("keep", "2026-01-01"))]
    led = ledger.normalize(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.status for r in led] == ["CRASH"]


def test_first_row_crashed_and_ties(spark):
    led = ledger.normalize(make(spark, [
        ("t", 0, "c0", "0.0", "0", "crash", "x"), ("t", 1, "c1", "1.0", "1", "keep", "first"), ("t", 2, "c2", "0.9", "1", "keep", "a"), ("t", 3, "c3", "0.9", "1", "keep", "b" * 46),
    ]))
    s = ledger.summary(led).first()
    assert s.baseline == 0.0 and s.improvement_pct is None and s.best_exp_no == 2
    f = ledger.frontier(led).orderBy("exp_no").collect()
    assert [r.idx for r in f] == [0, 1, 2] and f[-1].label == "b" * 42 + "..."
    assert [r.decided for r in ledger.keep_rule(led).orderBy("exp_no").collect()] == ["CRASH", "KEEP", "KEEP", "DISCARD"]


@pytest.mark.parametrize("rows", [[], [("t", 0, "c", "0.0", "0", "crash", "x")]])
def test_empty_and_all_crashed(spark, rows):
    led = ledger.normalize(make(spark, rows))
    for f in (ledger.outcomes, ledger.keep_rate, ledger.frontier, ledger.axis_limits, ledger.summary, ledger.effort, ledger.top_hits, ledger.hits_total, ledger.keep_rule, ledger.branch_tip):
        f(led).collect()
    if rows:
        assert ledger.keep_rate(led).first().keep_rate is None


def test_keep_rule_is_the_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for t in range(30):
        best = None
        for n in range(rng.randint(1, 12)):
            status = rng.choice(["keep", "discard", "crash", None])
            v = rng.choice([None, *(round(rng.random(), 2) for _ in range(4))])
            rows.append((f"t{t}", n, "c", None if v is None else str(v), "1", status, "d"))
            if status == "crash":
                want[f"t{t}", n] = "CRASH"
            else:
                want[f"t{t}", n] = "KEEP" if v is not None and (best is None or v < best) else "DISCARD"
                best = v if v is not None and (best is None or v < best) else best
    got = {(r.run_tag, r.exp_no): r.decided for r in ledger.keep_rule(ledger.normalize(make(spark, rows))).collect()}
    assert got == want


def test_running_over_blocks_is_a_plain_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(k, n, rng.choice([None, rng.randint(0, 50)])) for k in ("a", None, "b") for n in range(40)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    kinds = {"mn": ("min", F.col("v"), True), "sm": ("sum", F.col("v"), False), "la": ("last", F.col("v"), True)}
    got = running(df, ["k"], "n", kinds, block=F.floor(F.col("n") / 7))
    w = Window.partitionBy("k").orderBy("n")
    to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.min("v").over(to).alias("mn"), F.sum("v").over(before).alias("sm"), F.last("v", True).over(to).alias("la"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_preview_takes_the_first_rows_whatever_their_numbers(spark):
    rows = [("t", 3 * n, "c", "1", "1", "keep", "d") for n in range(15)]
    assert sorted(r.exp_no for r in ledger.preview(ledger.normalize(make(spark, rows))).collect()) == [3 * n for n in range(10)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ranks_are_those_of_one_window(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "b", None]), n, rng.choice([None, 0.0, 1.0, float(n % 7), rng.random()])) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, v double").repartition(3)
    order = [F.desc_nulls_last("v"), F.asc("n")]
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    got = ranked(df, ["k"], "v", order, "r", parts)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert ranked(df.where("false"), ["k"], "v", order, "r", parts).collect() == []
