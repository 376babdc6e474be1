import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.functions import vectors as vec
from quernstone.operators import modelmath as mm
from quernstone.operators import telemetry as tel
from quernstone.plans import telemetry_queries
from quernstone.sources import files
from quernstone.streaming import ingest

RUN = "run_tag string, exp_no long, step long, loss double, dt double"


def test_schedule_points(spark):
    p = spark.createDataFrame([(x,) for x in (0.0, 0.49, 0.5, 0.75, 1.0)], "p double")
    assert [r[0] for r in p.select(tel.lr_multiplier(F.col("p"))).collect()] == [1.0, 1.0, 1.0, 0.5, 0.0]
    assert p.select(tel.lr_multiplier(F.col("p"), warmup=0.5)).collect()[1][0] == pytest.approx(0.98)
    s = spark.createDataFrame([(0,), (150,), (900,)], "s int").select(tel.momentum(F.col("s"))).collect()
    assert [round(r[0], 6) for r in s] == [0.85, 0.9, 0.95]
    assert tel.accumulation(524288, 128, 2048) == 2
    with pytest.raises(ValueError):
        tel.accumulation(100, 3, 7)


def test_budget_stop_is_the_loop(spark):
    dts = [7.0] * 11 + [30.0] * 20
    df = spark.createDataFrame([("r", 0, i, 1.0, d) for i, d in enumerate(dts)], RUN)
    total, want = 0.0, []
    for i, d in enumerate(dts):
        before = total
        total += d if i > 10 else 0
        want.append((i, round(min(before / 300, 1), 6), max(0.0, 300 - total)))
        if i + 1 > 10 and total >= 300:
            break
    assert [(r.step, r.progress, r.remaining) for r in tel.budget_stop(df).orderBy("step").collect()] == want


def test_smoothed_loss_is_the_fold(spark):
    xs = [3.0, 2.0, None, float("nan"), 1.0, 0.5]
    got = [r.loss_ema for r in tel.smoothed_loss(spark.createDataFrame([("r", 0, i, x, 1.0) for i, x in enumerate(xs)], RUN)).orderBy("step").collect()]
    s, want = 0.0, []
    for t, x in enumerate([3.0, 2.0, 1.0, 0.5]):
        s = 0.9 * s + 0.1 * x
        want.append(round(s / (1 - 0.9 ** (t + 1)), 6))
    assert got == pytest.approx(want)


def test_progress_lines_are_read_again(spark):
    rows = [("r", 0, 0, float("nan"), 1.0, 0.318, 1_646_000, 39.8, 1, 299.6), ("r", 0, 1, None, 0.5, 32.934, 15_919, 39.0, 2, 0.0), ("r", 0, 2, 1.0, 1.0, None, 1, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, RUN.replace(", dt double", "") + ", lrm double, dt double, tok_per_sec long, mfu double, epoch int, remaining double")
    lines = tel.progress_lines(df)
    assert lines.first().value == "step 00000 (0.1%) | loss: NaN | lrm: 1.00 | dt: 318ms | tok/sec: 1,646,000 | mfu: 39.8% | epoch: 1 | remaining: 300s    "
    got = {r.step: r for r in tel.parse_progress(lines).collect()}
    assert set(got) == {0, 1} and math.isnan(got[0].loss) and got[1].loss is None and got[1].dt == 32.934 and got[0].run_tag == "r" and got[1].epoch == 2


def test_progress_lines_of_odd_steps_agree_with_sql(spark):
    """Nulls, numbers below zero, more time left than there is, and ties of which the nearest double lies below."""
    kinds = "run_tag string, exp_no long, step long, loss double, lrm double, dt double, tok_per_sec long, mfu double, epoch int, remaining double, loaded_at int"
    rows = [
        ("r", 0, 0, 1.0000005, 1.005, 0.3, 1_000, 8.25, 1, 310.0, 0), ("r", 0, 1, 2.0, None, 0.3, None, 0.35, None, -4.6, 0), ("r", 0, 2, -0.5, -0.145, -0.0015, -1_234, -1.05, 1, None, 0),
        ("r", 0, 3, float("nan"), 0.285, 0.3, 1_000, 1.15, 1, 0.5, 0), ("r", 0, 4, float("inf"), 1.255, 0.3, 1_000, float("inf"), 1, 2.5, 0), ("r", 0, 5, None, 1.0, 0.3, 1, 1.0, 2, 1.0, 0),
    ]
    df = spark.createDataFrame(rows, kinds)
    got = {r.step: tuple(map(str, r)) for r in tel.parse_progress(tel.progress_lines(tel.normalize(df))).drop("pct_done").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE telemetry (run_tag VARCHAR, exp_no BIGINT, step BIGINT, loss DOUBLE, lrm DOUBLE, dt DOUBLE, tok_per_sec BIGINT, mfu DOUBLE, epoch INTEGER, remaining DOUBLE, loaded_at INTEGER)")
    con.executemany("INSERT INTO telemetry VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    want = {r[2]: tuple(map(str, r)) for r in con.execute(telemetry_queries.oracle_sql()["log_progress_parse"]).fetchall()}
    assert got == want


def test_smoothed_loss_over_blocks_of_a_long_run(spark, monkeypatch):
    monkeypatch.setattr(tel, "EMA_BLOCK", 400)
    xs = [1.0 + (7 * i % 13) / 5 for i in range(1700)]
    got = [r.loss_ema for r in tel.smoothed_loss(spark.createDataFrame([("r", 0, i, x, 1.0) for i, x in enumerate(xs)], RUN)).orderBy("step").collect()]
    s, want = 0.0, []
    for t, x in enumerate(xs):
        s = 0.9 * s + 0.1 * x
        want.append(s / (1 - 0.9 ** (t + 1)))
    assert got == pytest.approx(want, abs=1e-6)


def test_schedules_round_last(spark):
    df = spark.createDataFrame([("r", 0, i, 1.0, 7.1234567) for i in range(40)], RUN)
    got = {r.step: r for r in tel.schedules(df, [("muon", 0.04)]).collect()}
    p = 7.1234567 * 24 / 300
    assert got[35].lrm == round((1 - p) / 0.5, 6) and got[35].lr == round(0.04 * (1 - p) / 0.5, 8) and got[35].weight_decay == round(0.2 * (1 - p), 6)


def test_fail_fast_counts_the_steps_before(spark):
    df = spark.createDataFrame([("a", 0, i, 1.0 if i < 7 else 500.0, 1.0) for i in range(12)] + [("b", 0, i, 1.0, 1.0) for i in range(4)], RUN)
    assert {r.run_tag: (r.fail_step, r.n_steps, r.failed) for r in tel.fail_fast(df).collect()} == {"a": (7, 7, True), "b": (None, 4, False)}


def test_fail_fast_and_totals(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0, 1.0), ("a", 0, 1, float("nan"), 1.0), ("b", 0, 0, 101.0, None), ("c", 0, 0, None, 1.0)], RUN)
    assert {r.run_tag: r.fail_step for r in tel.fail_fast(df).collect()} == {"a": 1, "b": 0, "c": None}
    full = spark.createDataFrame([("r", 0, i, 1.0, 300.1 / 942) for i in range(953)], RUN)
    assert tel.run_totals(full).first().total_tokens == 499_646_464
    assert tel.run_totals(full).first().steady_mfu == pytest.approx(39.805, abs=2e-3)  # the numerator counts one step more than the clock


def test_golden_summary_and_logs(spark, tmp_path):
    text = "---\nval_bpb:          0.997900\ntraining_seconds: 300.1\ntotal_seconds:    325.9\npeak_vram_mb:     45060.2\nmfu_percent:      39.80\ntotal_tokens_M:   499.6\nnum_steps:        953\nnum_params_M:     50.3\ndepth:            8\nnote: x\n"
    steps = "step 00001 (0.1%) | loss: 5.100000 | lrm: 1.00 | dt: 318ms | tok/sec: 1,646,000 | mfu: 39.8% | epoch: 1 | remaining: 299s    \rstep 00002 (0.2%) | loss: nan | lrm: 1.00 | dt: 310ms | tok/sec: 1,600,000\r\n"
    (tmp_path / "run.log").write_bytes((steps + text).encode())
    lines = files.read_log(spark, str(tmp_path / "run.log"))
    p = tel.parse_progress(lines).orderBy("step").collect()
    assert [r.step for r in p] == [1, 2] and p[0].tok_per_sec == 1646000 and p[0].remaining == 299 and math.isnan(p[1].loss)
    s = tel.summaries(tel.parse_summary(lines.select(F.lit("r").alias("run_tag"), F.lit(0).alias("exp_no"), "value")))
    r = s.first()
    assert (r.val_bpb, r.peak_vram_mb, r.depth) == (0.9979, 45060.2, 8.0)
    runs = spark.createDataFrame([("r", 0, "abcdef0123"), ("gone", 0, "1")], "run_tag string, exp_no int, commit_hash string")
    led = {x.run_tag: x for x in tel.ledger_rows(runs, tel.parse_summary(lines.select(F.lit("r").alias("run_tag"), F.lit(0).alias("exp_no"), "value"))).collect()}
    assert (led["r"].memory_gb, led["r"].commit, led["gone"].crashed, led["gone"].val_bpb) == (44.0, "abcdef0", True, 0.0)


def test_model_golden(spark):
    ls = mm.layers(mm.configs(spark, range(8, 9)))
    params = mm.parameters(mm.matrices(ls))
    got = {r.component: r.n_params for r in params.collect()}
    assert got == {"wte": 4194304, "lm_head": 4194304, "value_embeds": 16777216, "transformer_matrices": 25166336, "scalars": 16, "total": 50332176}
    assert mm.flops(ls, params).first().flops_per_token == 239_078_400
    assert [r.window for r in ls.orderBy("layer").collect()] == [1024, 1024, 1024, 2048, 1024, 1024, 1024, 2048]
    with pytest.raises(ValueError):
        mm.layers(mm.configs(spark, range(2, 3)), pattern="SX")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 0.5],)], "v array<double>")
    one = lambda f: df.select(f(F.col("v"))).first()[0]
    v = [1.0, -2.0, 3.0, 0.5]
    rms = math.sqrt(sum(x * x for x in v) / 4 + vec.EPS)
    assert one(vec.rms_norm) == pytest.approx([x / rms for x in v])
    assert one(vec.relu2) == [1.0, 0.0, 9.0, 0.25]
    assert one(vec.softcap)[2] == pytest.approx(15 * math.tanh(0.2))
    assert sum(x * x for x in one(lambda c: vec.rotary(c, F.lit(5)))) == pytest.approx(sum(x * x for x in v))
    assert one(lambda c: vec.rotary(c, F.lit(0))) == pytest.approx(v)


def test_streaming_takes_each_step_once(spark, tmp_path):
    columns = ["'r' run_tag", "0L exp_no", "id step", "1D loss", "1D lrm", "1D dt", "1L tok_per_sec", "1D mfu", "1 epoch", "1D remaining"]
    times = ["timestamp'2026-01-01 00:00:00' logged_at", "timestamp'2026-01-02 00:00:00' loaded_at"]
    for _ in range(2):
        spark.range(5).selectExpr(*columns, *times).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.append_to(ingest.once(ingest.telemetry_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
