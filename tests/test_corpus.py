import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import tokenizer as tok
from quernstone.operators import corpus, metrics, packing
from quernstone.sources import files

SHARD = "row_id long, shard_id int, rg_id int, pos long, text string"
TEXTS = ["Don't stop 12345  now\n\n", "你好,世界 99", "<|reserved_0|> is text", "naïve ☃ \U0001f6b2", "", " ", "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, 6542 if i % 10 == 9 else i // 10, i % 2, i, None if i == 5 else "ab" * (i + 1)) for i in range(60)]
    return spark.createDataFrame(rows, SHARD).repartition(3).cache()


def test_plan_names_and_limits(spark):
    have = spark.createDataFrame([(1,), (6542,)], "shard_id int")
    rows = {r.shard_id: r for r in corpus.plan_shards(have, 3).collect()}
    assert sorted(rows) == [0, 1, 2, 6542] and rows[1].file_name == "shard_00001.parquet" and rows[6542].is_present and not rows[0].is_present
    assert corpus.plan_shards(have, -1).count() == corpus.plan_shards(have, 10**6).count() == 6543


def test_unknown_split_is_an_error(docs):
    with pytest.raises(ValueError):
        corpus.of_split(docs, "test")
    assert corpus.of_split(docs, "val").count() == 6


@pytest.mark.parametrize("budget", [-1, 0, 1, 5, 100, 777, 10**9])
def test_char_budget_is_the_reader(docs, budget):
    taken, total = [], 0
    for r in sorted(docs.where("text is not null").collect(), key=lambda r: (r.shard_id, r.rg_id, r.pos)):
        taken.append(r.row_id)
        total += len(r.text[:50])
        if total >= budget:
            break
    assert sorted(r.row_id for r in corpus.char_budget(docs, budget, cap=50).collect()) == sorted(taken)


def test_shards_behind_the_budget_are_not_read(docs, monkeypatch):
    seen, write = [], corpus.written

    def watching(df):
        out = write(df)
        seen.append({r.shard_id for r in out.collect()})
        return out

    monkeypatch.setattr(corpus, "written", watching)
    taken = corpus.char_budget(docs, 30, cap=50, at_once=1)
    assert seen == [{0}] and {r.shard_id for r in taken.collect()} == {0}
    assert corpus.char_budget(docs.where("false"), 30).collect() == []


def test_batches_stay_in_row_groups(docs):
    got = corpus.batches(docs, epochs=2, size=2).collect()
    assert {r.epoch for r in got} == {1, 2} and sum(r.n_docs for r in got) == 2 * 59 and max(r.n_docs for r in got) == 2


def test_pretokens_of_whole_texts_are_counted(spark):
    df = spark.createDataFrame([("a b" * 5_000 + " end",), ("end",), (None,)], "t string")
    counts = {r.pretoken: r.n for r in tok.pretoken_counts(df, "t").collect()}
    assert counts[" end"] == 1 and sum(len(p) * n for p, n in counts.items()) == 15_007
    cut = {r.pretoken: r.n for r in tok.pretoken_counts(df, "t", cap=10_000).collect()}
    assert sum(len(p) * n for p, n in cut.items()) == 10_003


def test_pairs_within_pieces_are_counted(spark):
    counts = spark.createDataFrame([("aab", 3), ("ab", 2), ("x", 9), ("\u00e9", 1), ("", 4)], "pretoken string, n long")
    assert {(r.left, r.right): r.n for r in tok.pair_counts(counts).collect()} == {("61", "61"): 3, ("61", "62"): 5, ("c3", "a9"): 1}


def test_only_text_is_encoded(spark):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="only text"):
        spark.createDataFrame([(1,)], "t int").select(tok.bpe_encode(F.col("t"))).collect()


def test_pretokens_lose_nothing_and_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    pattern = regex.compile(tok.SPLIT_PATTERN)
    for r in df.select("t", tok.pretokens(F.col("t")).alias("p")).collect():
        assert "".join(r.p) == r.t and r.p == pattern.findall(r.t)


def test_encode_decode(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    rows = df.select("t", tok.bpe_encode(F.col("t"), tok.BOS).alias("ids"), tok.bpe_decode(tok.bpe_encode(F.col("t"))).alias("back")).collect()
    bos = tok.encoding().encode_single_token(tok.BOS)
    for r in rows:
        assert r.back == r.t and (r.t is None or r.ids[0] == bos and bos not in r.ids[1:])
    with pytest.raises(ValueError):
        tok.bpe_encode(F.col("t"), prepend=(1,))


def test_token_bytes_counts_replacement_characters(spark):
    merges = spark.createDataFrame([(0, bytearray(b"\x80")), (1, bytearray(b"ab")), (2, bytearray("é".encode()))], "token_id int, bytes binary")
    assert {r.token_id: r.n_bytes for r in tok.token_bytes(merges).collect()} == {0: 3, 1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}


def test_tokenizer_tables_are_kept(spark, tmp_path):
    merges = spark.createDataFrame([(0, bytearray(b"a"))], "token_id int, bytes binary")
    for _ in range(2):
        files.save_tokenizer(merges, tok.token_bytes(merges), str(tmp_path / "t"))
    a, b = files.load_tokenizer(spark, str(tmp_path / "t"))
    assert a.count() == 1 and b.count() == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(1, 30), st.integers(1, 12))
def test_best_fit_contract(sizes, row, buffer):
    items = list(enumerate(sizes))
    rows = list(packing.best_fit([items[k : k + 3] for k in range(0, len(items), 3)], row, buffer))
    seen = [k for r in rows for k, _, _ in r]
    assert len(seen) == len(set(seen))
    for r in rows:
        assert sum(t for _, t, _ in r) == row
        assert all(t == n for _, t, n in r[:-1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 30), st.integers(1, 12))
def test_each_placement_is_the_best_of_the_pool(sizes, row, buffer):
    items = [(k, n) for k, n in enumerate(sizes)]
    batches = [items[k : k + 3] for k in range(0, len(items), 3)]
    placed = [p for r in packing.best_fit(batches, row, buffer) for p in r]
    waiting, room = {}, row
    for key, taken, n in placed:
        while len(waiting) < buffer and batches:
            waiting |= dict(batches.pop(0))
        fitting = [(x, -k) for k, x in waiting.items() if x <= room]
        want = -max(fitting)[1] if fitting else min((x, k) for k, x in waiting.items())[1]
        assert key == want and n == waiting.pop(key) and taken == min(n, room)
        room = room - taken or row


def test_best_fit_ties_and_crops():
    assert list(packing.best_fit([[("a", 3), ("b", 5), ("c", 5), ("d", 2)]], 8, 4))[0] == [("b", 5, 5), ("a", 3, 3)]
    assert list(packing.best_fit([[("a", 9), ("b", 9)]], 4, 2)) == [[("a", 4, 9)], [("b", 4, 9)]]


def test_one_group_is_one_pool(spark):
    sizes = [7, 3, 12, 5, 5, 9, 2, 8, 1, 4, 6, 11, 3, 2, 10, 5]
    docs = spark.createDataFrame([("all", i, i, n) for i, n in enumerate(sizes)], "pack_group string, pos int, doc long, n_tokens int").repartition(4)
    got = sorted((r.row_idx, r.slot, r.doc, r.n_taken) for r in packing.pack_rows(docs, row_tokens=12).collect())
    # worked out by hand: 12 | 11 + 1 | 10 + 2 | 9 + 3 | 8 + 4 | 7 + 5 | 6 + 5 and one of the 2 left over | 5 + 3, then nothing
    assert got == [
        (0, 0, 2, 12), (1, 0, 11, 11), (1, 1, 8, 1), (2, 0, 14, 10), (2, 1, 6, 2), (3, 0, 5, 9), (3, 1, 1, 3), (4, 0, 7, 8), (4, 1, 9, 4),
        (5, 0, 0, 7), (5, 1, 3, 5), (6, 0, 10, 6), (6, 1, 4, 5), (6, 2, 13, 1),
    ]


def test_packed_rows_tell_the_epoch_of_the_last_refill(spark):
    docs = spark.createDataFrame([("g", i, f"d{i}", 5) for i in range(4)], "pack_group string, pos int, doc string, n_tokens int")
    rows = packing.pack_rows(docs, row_tokens=10, buffer_size=2, epochs=2).collect()
    assert sorted({(r.row_idx, r.epoch) for r in rows}) == [(0, 1), (1, 2), (2, 2), (3, 2)]
    assert all(n == 2 for n in __import__("collections").Counter(r.doc for r in rows).values())


def test_shift_and_eval_rows(spark):
    t = spark.createDataFrame([(r, p, 10 * r + p) for r in range(3) for p in (2, 0, 1)], "row_idx int, pos int, token_id int")
    rows = packing.shift_targets(t, ["row_idx"])
    got = {r.row_idx: (r.inputs, r.targets) for r in rows.collect()}
    assert got[2] == ([20, 21], [21, 22])
    assert [r.step for r in packing.eval_rows(rows, 2, 1).orderBy("row_idx").collect()] == [0, 1]


def test_bits_per_byte_masks_by_factor(spark):
    tb = spark.createDataFrame([(0, 2), (1, 0)], "token_id int, n_bytes int")
    rows = [("ok", 0, 1.0), ("ok", 1, 5.0), ("nan", 0, 1.0), ("nan", 1, float("nan")), ("null", 0, None), ("none", 1, 1.0)]
    got = {r.k: r for r in metrics.bits_per_byte(spark.createDataFrame(rows, "k string, token_id int, nats double"), tb, ["k"]).collect()}
    assert got["ok"].bpb == pytest.approx(1 / (0.693147 * 2), abs=1e-5) and got["nan"].is_nan and got["nan"].bpb is None
    assert got["nan"].bpb_masked == got["ok"].bpb and "null" not in got and got["none"].bpb is None


def test_shards_and_ledger_files(spark, tmp_path):
    spark.createDataFrame([("t", 1)], "text string, extra int").coalesce(1).write.parquet(str(tmp_path / "w"))
    (tmp_path / "c").mkdir()
    next((tmp_path / "w").glob("part*")).rename(tmp_path / "c" / "shard_00042.parquet")
    assert [tuple(r) for r in files.read_shards(spark, str(tmp_path / "c")).collect()] == [(42, "t")]
    assert files.require_shards(spark, str(tmp_path / "c"), least=1) == 1
    with pytest.raises(ValueError):
        files.require_shards(spark, str(tmp_path / "c"))
    rows = spark.createDataFrame([("abc", "1.0", "2", "keep", 'say "hi"')], files.LEDGER_SCHEMA)
    files.append_ledger(rows, str(tmp_path / "l"))
    files.append_ledger(rows, str(tmp_path / "l"))
    assert [r.description for r in files.read_ledger(spark, str(tmp_path / "l")).collect()] == ['say "hi"'] * 2
    files.append_ledger(spark.createDataFrame([("a", " 1 ", "", None, "  padded ")], files.LEDGER_SCHEMA), str(tmp_path / "p"))
    assert tuple(files.read_ledger(spark, str(tmp_path / "p")).first()) == ("a", " 1 ", None, None, "  padded ")
