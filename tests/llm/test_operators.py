import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import bpe, encoding, encoding_core, leaks, neardup, overlap, packing, pieces, quality, queries, residue, residue_core, shingles
from quernstone.plans import durable

SMALL = "/root/testdata/sf0.001"
RNG = random.Random(7)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def triples(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


# 1: encodings
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aéèüßñçãłżКожыйé ", min_size=1), st.sampled_from(["latin_1", "cp1252", "cp1251", "cp437", "mac_roman"]))
def test_undo_reverses_a_wrong_decoding(text, wrong):
    garbled = "".join(encoding_core._encoder(wrong) and {v: k for k, v in reversed(encoding_core._encoder(wrong).items())}[b] for b in text.encode())
    back = encoding_core.undo(garbled, wrong, "utf_8")
    assert back == text or garbled == text


def test_alignment_names_the_codecs():
    runs = encoding_core.align("pÃªche", "pêche")
    assert runs == [("Ãª", "ê")] and encoding_core.PAIRS.index(("latin_1", "utf_8")) in encoding_core.explained_by(runs)
    assert encoding_core.align("abc", "abd") is None
    latin = encoding_core.PAIRS.index(("latin_1", "utf_8"))
    assert (latin, "Ãª", "ê") in encoding_core.mappings("pÃªche", "pêche")
    koi = encoding_core.PAIRS.index(("cp1251", "koi8_r"))
    assert {(x, y) for k, x, y in encoding_core.mappings("НПМПЛП", "молоко") if k == koi} == {("Н", "м"), ("П", "о"), ("М", "л"), ("Л", "к")}
    gb = encoding_core.PAIRS.index(("latin_1", "gb18030"))
    assert encoding_core.mappings("ÈË", "人") and (gb, "ÈË", "人") in encoding_core.mappings("ÈË", "人")


def test_units_of_unspaced_script_stand_at_words_and_numbers():
    got = set(encoding_core.units("每天有391个人在Elorwenny的市场 pêche молоко"))
    assert {("a0", "个"), ("a0", "个人"), ("b0", "有"), ("aElorwenny", "的"), ("bElorwenny", "在"), ("tpche", "pêche")} <= got
    assert any(k.startswith("s") and u == "молоко" for k, u in got)


def test_sequences_are_undone_beside_lost_bytes():
    text = "夕日が古い".encode().decode("latin_1")
    assert encoding_core.undo_sequences(text, "latin_1")[0] == "夕日が古い"
    assert encoding_core.undo_sequences(text[:7] + text[8:], "latin_1")[0].startswith("夕日") and encoding_core.undo_sequences("é à Ñ©ïîìíê", "latin_1")[1] == ""


def test_nothing_is_tried_that_no_twins_have_shown(spark):
    clean = "La pêche dorée près de la forêt où le théâtre célèbre une fenêtre brûlée. "
    other = "Molto bene qui, e così però più là. "
    rows = [(i, f"{other}{i}") for i in range(60)] + [(100, clean.encode().decode("cp437"))]
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert encoding.restored(df, "row_id", "text").collect() == []
    rows += [(200 + i, f"{clean}{i}") for i in range(60)]
    got = encoding.restored(spark.createDataFrame(rows, "row_id long, text string"), "row_id", "text").collect()
    assert [(r.row_id, r.restored) for r in got] == [(100, clean)]


def test_dots_behind_right_words_are_no_garbling(spark):
    words = "кувшин дорога монета молоко город берег ветер".split()
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(words) for _ in range(12))
    rows = [(i, line() + ".") for i in range(80)] + [(100 + i, line().encode("koi8_r").decode("cp1251")) for i in range(1)]
    rows += [(300, "… ".join(words) + "…")]
    got = {r.row_id: r.restored for r in encoding.restored(spark.createDataFrame(rows, "row_id long, text string"), "row_id", "text").collect()}
    assert set(got) == {100} and all(w in words for t in got.values() for w in t.split())


def test_garbled_records_come_out_restored(spark):
    clean = "La pêche dorée près de la forêt où le théâtre célèbre une fenêtre brûlée. "
    rows = [(i, clean * 2 + str(i)) for i in range(60)]
    rows += [(100, clean.encode().decode("latin_1")), (101, clean.encode().decode("cp437")), (102, 'When a page shows "Ã©" the reader guessed wrong.'), (103, "Þórsnæs is right, so is ½ and 20 °C"), (104, "Voil�")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {r.row_id: r.restored for r in encoding.restored(df, "row_id", "text").collect()}
    assert set(got) == {100, 101, 104} and got[100] == clean and got[101] == clean
    assert {r.row_id for r in encoding.garbled_ids(df, "row_id", "text").collect()} == {100, 101, 104}


def test_twins_teach_however_many_units_are_more_frequent(spark):
    rows = [(100 * k + i, f"the recept{chr(0x100 + k)} stands here {i}") for k in range(60) for i in range(3)]
    rows += [(9000, "a receptÃ© there"), (9001, "a recepté there")]
    judge, _ = encoding.learn(spark.createDataFrame(rows, "row_id long, text string"), "text")
    k = encoding_core.PAIRS.index(("latin_1", "utf_8"))
    assert judge.learned[k]["Ã©", "é"] == 1


def test_lost_bytes_are_filled_from_twins(spark):
    clean = "La région près de la forêt reçoit więc ktoś ‘jamais’."
    rows = [(i, f"{clean} {i}") for i in range(30)] + [(100, "La r\ufffdgion pr\ufffds (de la for\ufffdt), po\ufffd"), (101, "Lui r\xc3\xa9gion for\xc3\xaat wi\xc4c kto\xc5!"), (None, "La for\ufffd\ufffdt"), (None, "La for\ufffd\ufffdt")]
    got = sorted(map(tuple, encoding.restored(spark.createDataFrame(rows, "row_id long, text string"), "row_id", "text").collect()), key=str)
    assert got == [(100, "La région près (de la forêt), po\ufffd"), (101, "Lui région forêt więc ktoś!"), (None, "La forêt"), (None, "La forêt")]
    assert encoding_core.may_be("wi\xc4c", "więc") and not encoding_core.may_be("wi\xc3c", "więc") and not encoding_core.may_be("więc", "więc")


def test_frequent_garbling_is_found(spark):
    clean = "Le marché du café fermé malgré la fête. "
    garbled = lambda t: t.encode().decode("latin_1")
    rows = [(i, f"{clean}{VOCAB[i]}") for i in range(100)] + [(200 + i, f"Le marché {VOCAB[i]} de la fête {garbled('malgré')}.") for i in range(100)]
    rows += [(400 + i, f"Le {garbled('marché')} du {garbled('café')}.") for i in range(300)]
    got = {r.row_id: r.restored for r in encoding.restored(spark.createDataFrame(rows, "row_id long, text string"), "row_id", "text").collect()}
    assert set(got) == {*range(200, 300), *range(400, 700)}
    assert got[200] == f"Le marché {VOCAB[0]} de la fête malgré." and got[400] == "Le marché du café."


# 2: text types
def test_text_types(spark):
    sentence = "However, the old {0} near the river was quiet, and nobody in the village had seen the {1} before the storm. "
    rows = [(i, "".join(sentence.format(RNG.choice(VOCAB), RNG.choice(VOCAB)) for _ in range(6))) for i in range(80)]
    rows += [(200 + i, "\n".join(f"{RNG.choice(VOCAB)};{RNG.randint(1, 999)};{RNG.random():.2f};{RNG.choice(VOCAB)}" for _ in range(20))) for i in range(15)]
    rows += [(300 + i, "\n".join(f"- {RNG.choice(VOCAB)} {RNG.randint(1, 99)}" for _ in range(25))) for i in range(15)]
    rows += [(400 + i, "".join(RNG.choice("~!@#$%^&*|<>=+") for _ in range(400))) for i in range(10)]
    got = {r.row_id: r for r in quality.text_types(spark.createDataFrame(rows, "row_id long, text string"), "row_id", "text").collect()}
    assert {i for i, r in got.items() if r.text_type == "prose"} == set(range(80))
    assert got[0].ended_lines == 1.0 and got[200].symbol_ratio > got[0].symbol_ratio
    kinds = {lo: Counter(got[i].text_type for i in got if lo <= i < lo + 100).most_common(1)[0][0] for lo in (200, 300, 400)}
    assert kinds == {200: "table", 300: "list", 400: "junk"}
    assert all(r.as_table + r.as_list + r.as_junk == pytest.approx(r.listed) for r in got.values())


def test_what_is_said_over_is_judged_on_whole_texts(monkeypatch):
    monkeypatch.setattr(quality, "BATCH_CHARS", 400)
    over, rng = "say it again and again now " * 60, random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    varied = "".join(f"{word()} {word()} {word()} " * 20 for _ in range(40))  # each piece repeats, the whole doesn't
    for own, b in quality._batches(["short text", over, varied]):
        assert all(bool(r) == (k == 1) for k, r in zip(own.tolist(), b.repeats))


# 3: packing
@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    chosen = packing.fullest(counts, room)
    assert sum(x * n for x, n in chosen.items()) == max(sums) and all(n <= counts[x] for x, n in chosen.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_plan_places_each_once_within_capacity(lengths):
    counts = Counter(lengths)
    rows: Counter = Counter()
    placed = Counter()
    for x, lo, hi, n, first in packing.plan(dict(counts), 50):
        placed[x] += hi - lo
        for rank in range(lo, hi):
            rows[first + (rank - lo) // n] += x
    assert placed == counts and max(rows.values()) <= 50 and sorted(rows) == list(range(len(rows)))
    assert len(rows) <= max(-(-sum(lengths) // 50), 1) * 1.3 + 2


def test_one_length_may_hold_nearly_all_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    monkeypatch.setattr(packing, "BLOCK", 16)
    rng = random.Random(11)
    rows = [(i, "train", "a") for i in range(900)] + [(1000 + i, rng.choice(["train", "val", None]), " a" * rng.randint(0, 70)) for i in range(100)]
    got = packing.packed(spark.createDataFrame(rows, "row_id long, split string, text string").repartition(3), "row_id", "split", "text", capacity=10).collect()
    assert all(r.used <= 10 and r.used + r.unused == 10 and r.used == sum(x.length for x in r.records) and r.n_records == len(r.records) for r in got)
    pieces_of = Counter((x.row_id, x.piece) for r in got for x in r.records)
    assert set(pieces_of.values()) == {1} and {i for i, _ in pieces_of} == {i for i, _, _ in rows}
    for split in ("train", "val", None):
        own = [r for r in got if r.split == split]
        assert sorted(r.row_no for r in own) == list(range(len(own))) and len(own) <= -(-sum(r.used for r in own) // 10) + 2


# 4 and 5: overlaps and near-duplicates against brute force
@pytest.fixture(scope="module")
def similar(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = prose(90, rng).split()
        for k in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 2, 6, 12])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            if rng.random() < 0.3:
                w = prose(rng.randint(0, 60), rng).split() + w
            rows.append((len(rows), rng.choice(["train", "train", "val"]), " ".join(w)))
    rows += [(1000 + i, "train", "same text " * 40 + str(i % 2)) for i in range(6)]
    return rows, spark.createDataFrame(rows, "row_id long, split string, text string").repartition(3)


def test_copies_on_both_sides_are_all_listed(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COPIES", 7)
    text = prose(70)
    rows = [(i, "val" if i % 4 == 0 else "train", text) for i in range(60)] + [(100, "train", text + " more words"), (101, "val", None)]
    got = [(r.held_id, r.train_id) for r in overlap.overlaps(spark.createDataFrame(rows, "row_id long, split string, text string"), "row_id", "split", "text").collect()]
    assert sorted(got) == sorted((a, b) for a in range(0, 60, 4) for b in [*(i for i in range(60) if i % 4), 100])


def test_overlaps_are_all_there(similar):
    rows, df = similar
    sets = {i: (s, triples(t)) for i, s, t in rows}
    want = {(a, b) for a, (sa, x) in sets.items() for b, (sb, y) in sets.items() if sa == "val" and sb == "train" and len(x & y) * 5 >= len(x) * 3}
    got = overlap.overlaps(df, "row_id", "split", "text").collect()
    assert {(r.held_id, r.train_id) for r in got} == want and want
    assert all(r.n_common == len(sets[r.held_id][1] & sets[r.train_id][1]) for r in got)


def test_near_duplicates_are_all_there(similar):
    rows, df = similar
    sets = {i: triples(t) for i, _, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 3}
    members, links = neardup.linked(df, "row_id", "text", similarity=0.6, size=3, min_words=60)
    got = {(r.a, r.b) for r in neardup.all_pairs(members, links).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    groups = {r.id: r for r in neardup.groups(members, links).collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in got) and groups[1000].rep == groups[1002].rep == 1000


def test_long_lists_go_the_exact_way(similar):
    rows, df = similar
    sets = {i: triples(t) for i, _, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 3}
    got = neardup.all_pairs(*neardup.linked(df, "row_id", "text", similarity=0.6, size=3, min_words=60, longest_list=1))
    assert {(r.a, r.b) for r in got.collect()} == want
    share = neardup._by_prefix(spark_sets(df), 0.6).collect()
    assert len(share) == len(set(share)) and {(r.rep_a, r.rep_b) for r in share} >= {(a, b) for a, b in want if sets[a] != sets[b]}


def spark_sets(df):
    return shingles.text_sets(df.select(F.col("row_id").alias("id"), "text"), df.select(F.col("row_id").alias("id")), 3)


def candidates(spark, n, seen):
    """How many pairs ``n`` texts of 45 % shared passage are compared on, none of which are similar."""
    rng = random.Random(n)
    passage = prose(90, rng)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(55)) + " " + passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(55))) for i in range(n)]
    seen.clear()
    links = neardup.linked(spark.createDataFrame(rows, "row_id long, text string"), "row_id", "text", similarity=0.6, size=3, min_words=60)[1]
    assert links.count() == 0
    return sum(seen)


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    seen, write = [], neardup.written

    def counting(df):
        out = write(df)
        if out.columns == ["rep_a", "rep_b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counting)
    few, many = candidates(spark, 750, seen), candidates(spark, 3000, seen)
    assert many <= 8 * max(few, 750), (few, many)


def test_copies_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 7)
    members = spark.createDataFrame([(i, 0) for i in range(50)] + [(100, 100), (101, 100), (200, 200)], "id long, rep long")
    got = [(r.a, r.b) for r in neardup.all_pairs(members, spark.createDataFrame([], "rep_a long, rep_b long")).collect()]
    assert sorted(got) == sorted([*combinations(range(50), 2), (100, 101)])


def test_overlaps_of_words_that_lower_case_changes_agree_with_sql(spark):
    """A dotted capital I breaks no word, and a capital sigma is the same letter wherever it stands."""
    w = [f"w{i}" for i in range(70)]
    rows = []
    for k, (x, y) in enumerate([("İstanbul", "istanbul"), ("ΟΔΟΣ", "οδοσ"), ("İİ", "ii")]):
        marked = [y if i % 3 == 0 else f"{z}x{k}" for i, z in enumerate(w)]
        rows += [(2 * k, "val", " ".join(x if z == y else z for z in marked)), (2 * k + 1, "train", " ".join(marked))]
    got = {tuple(r) for r in overlap.overlaps(spark.createDataFrame(rows, "row_id long, split string, text string"), "row_id", "split", "text").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE shard (row_id BIGINT, split VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO shard VALUES (?, ?, ?)", rows)
    assert got == set(con.execute(queries.oracle_sql()["p4_overlaps"]).fetchall()) and len(got) == 3


def test_overlaps_where_an_id_has_several_texts(spark):
    """The least id of a class stands for it with the text of the class, not with another of its texts."""
    t, u = prose(80), prose(80)
    rows = [(1, "train", t), (1, "train", u), (2, "val", t + " more"), (3, "val", u + " more")]
    df = spark.createDataFrame(rows, "row_id long, split string, text string")
    assert {(r.held_id, r.train_id) for r in overlap.overlaps(df, "row_id", "split", "text").collect()} == {(2, 1), (3, 1)}


def test_near_duplicates_of_many_copies_leave_no_list_of_pairs_on_disk(spark, tmp_path, monkeypatch):
    """Garbled records go before pairs are listed, and what led to the links is removed: no step has more rows than there are records."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words)] * 60 + [" ".join([*words[:79], "other"])] * 40
    d, steps = str(tmp_path / "in"), tmp_path / "steps"
    spark.createDataFrame([(i, "train", "s", x) for i, x in enumerate(texts)], "row_id long, split string, source string, text string").write.parquet(f"{d}/shard.parquet")
    monkeypatch.setattr(durable, "shared_dir", lambda s: f"file://{steps}")
    got = queries.p5_found(spark, d)
    left = [spark.read.parquet(str(p)).count() for p in steps.glob("step-*") if list(p.glob("*.parquet"))]
    assert got.count() == 100 * 99 // 2 and left and max(left) <= 100
    assert not any("shingles" in spark.read.parquet(str(p)).columns for p in steps.glob("step-*") if list(p.glob("*.parquet")))


def test_shares_are_exact():
    assert [shingles.at_least(0.6, n) for n in (5, 10, 11, 0)] == [3, 6, 7, 0]


# 6: pieces
@pytest.mark.parametrize("unit", ["word ", "One sentence here. ", "line\n", "p\n\n", "字", "\U0001f6b2", "x"])
def test_pieces_make_up_the_text(spark, unit):
    text = (unit * 3000)[:2500] + "end"
    rows = pieces.pieces(spark.createDataFrame([(1, text), (2, "short"), (3, "y" * 500)], "row_id long, text string"), "row_id", "text", limit=500, overlap=40)
    got = rows.where("row_id = 1").orderBy("piece_no").collect()
    assert "".join(r.piece[r.n_overlap :] for r in got) == text and max(len(r.piece) for r in got) <= 500
    assert all(b.piece[: b.n_overlap] and a.piece.endswith(b.piece[: b.n_overlap]) and b.n_overlap <= 40 for a, b in zip(got, got[1:]))
    assert {r.row_id for r in rows.collect()} == {1}


def test_starts_of_very_many_pieces(spark):
    text = "word " * 3000
    rows = pieces.pieces(spark.createDataFrame([(1, text)], "row_id long, text string"), "row_id", "text", limit=20, overlap=3).orderBy("piece_no").collect()
    assert len(rows) > 4 * pieces.GROUP and all(text[r.start :].startswith(r.piece[r.n_overlap :]) for r in rows)
    assert all(b.start == a.start + len(a.piece) - a.n_overlap for a, b in zip(rows, rows[1:]))


def test_pieces_prefer_strong_boundaries(spark):
    text = ("a" * 50 + " ") * 6 + "b" * 20 + "\n\n" + "c " * 300
    first = pieces.pieces(spark.createDataFrame([(1, text)], "row_id long, text string"), "row_id", "text", limit=500, overlap=40).orderBy("piece_no").first()
    assert first.piece.endswith("\n\n")


# 7: ids
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_prefix_encoder_is_exact(text):
    e = bpe.encoder(bpe.VOCABULARY)
    want = tiktoken.Encoding("t", pat_str=bpe.SPLIT, mergeable_ranks=e.ranks, special_tokens={})
    text = text.encode("utf-8", "replace").decode()
    assert e.encode(text) == want.encode_ordinary(text)


def test_prefix_encoder_on_long_unbroken_pieces():
    e = bpe.encoder(bpe.VOCABULARY)
    want = tiktoken.Encoding("t", pat_str=bpe.SPLIT, mergeable_ranks=e.ranks, special_tokens={})
    for text in ("ab" * 3000, "<|endoftext|> is text", "".join(chr(97 + (i * i) % 26) for i in range(5000)), "字" * 500):
        assert e.encode(text) == want.encode_ordinary(text)


# 8: leaks
def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(40, rng)) for i in range(12)] + [(50, "too short")]
    docs = []
    for d in range(60):
        w = prose(80, rng).split()
        if d % 2:
            k, n = rng.randrange(12), rng.choice([9, 12, 13, 20])
            at = rng.randrange(0, 40 - n + 1)
            w[10:10] = items[k][1].upper().split()[at : at + n]
        docs.append((d, ", ".join(w)))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda t: {tuple(words(t)[k : k + 13]) for k in range(len(words(t)) - 12)}
    want = {(d, i) for d, t in docs for i, q in items if runs(t) & runs(q)}
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 900):
        got = leaks.leaks(ddf, "doc_id", "text", idf, "item_id", "text", block_chars=block).where("n_words >= 13")
        assert {(r.doc, r.item) for r in got.collect()} == want and want


def test_joined_items_give_what_broadcast_ones_do(spark):
    rng = random.Random(21)
    opening = prose(20, rng)
    items = [(i, f"{opening} {prose(30, rng)}") for i in range(10)] + [(20, None), (21, ""), (22, "short")]
    docs = [(0, f"{prose(9, rng)} {opening} {prose(9, rng)}"), (0, f"{prose(9, rng)} {opening} {prose(9, rng)}"), (1, items[3][1]), (None, items[4][1][:70] + "#" + items[4][1][71:]), (2, None), (3, "")]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for edits in (0, 1, 2):
        one, many = (sorted(map(str, leaks.leaks(ddf, "doc_id", "text", idf, "item_id", "text", edits=edits, block_chars=n).collect())) for n in (4_000_000, 900))
        assert one == many and len(one) >= 30
    plan = leaks.leaks(ddf, "doc_id", "text", idf.where("false"), "item_id", "text", block_chars=-1)
    assert plan.collect() == []


def test_texts_that_share_very_many_qgrams_are_searched_by_halves(monkeypatch):
    line = "the same opening line of all the items that are asked about here today "
    ix = leaks.Index([(i, f"{line}{prose(30)}") for i in range(40)], 13, 1)
    texts = [f"{prose(5)} {line}{prose(5)}" for _ in range(9)]
    ids = __import__("pyarrow").array(range(9))
    whole = [r for b in leaks._searched(ix, ids, texts, 1, 13) for r in b.to_pylist()]
    monkeypatch.setattr(leaks, "MOST_HITS", 3000)
    parts = [b.to_pylist() for b in leaks._searched(ix, ids, texts, 1, 13)]
    assert len(parts) > 1 and sorted(map(str, whole)) == sorted(str(r) for b in parts for r in b) and len(whole) == 9 * 40


def test_leaks_allow_an_edit(spark):
    item = "the quick brown fox jumps over the lazy dog while nine small birds watch from a tree"
    doc = "before it " + item.replace("lazy", "lazi") + " after it"
    df = lambda c, t: spark.createDataFrame([(1, t)], f"{c} long, text string")
    r = leaks.leaks(df("doc_id", doc), "doc_id", "text", df("item_id", item), "item_id", "text").first()
    assert r is not None and r.n_words < 13 and r.n_edits == 1 and r.n_chars > 70
    assert leaks.leaks(df("doc_id", doc), "doc_id", "text", df("item_id", item), "item_id", "text", edits=0).first() is None


def longest_stretches(doc, item, edits):
    """By plain dynamic programming over all cells: most whole words (exact, with edits) and the longest length."""
    spaces = [0]
    for c in doc:
        spaces.append(spaces[-1] + (c == 32))
    table = [[[None] * (edits + 1) for _ in range(len(item) + 1)] for _ in range(len(doc) + 1)]
    exact = words = longest = 0
    for i in range(len(doc) + 1):
        for j in range(len(item) + 1):
            for e in range(edits + 1):
                starts = []
                if i and j and doc[i - 1] == item[j - 1]:
                    before = table[i - 1][j - 1][e]
                    starts.append(i - 1 if before is None else before)
                ended = bool(starts)
                if e:
                    starts += [s for s in ((table[i - 1][j - 1][e - 1] if i and j else None), (table[i - 1][j][e - 1] if i else None), (table[i][j - 1][e - 1] if j else None)) if s is not None]
                table[i][j][e] = min(starts, default=None)
                if ended:
                    s = table[i][j][e]
                    n = max(0, spaces[i] - spaces[s] - 1)
                    words, longest = max(words, n), max(longest, i - s)
                    exact = max(exact, n) if e == 0 else exact
    return exact, words, longest


@settings(max_examples=150, deadline=None)
@given(st.data(), st.sampled_from(["ab ", "a ", "abcdefgh "]), st.integers(0, 3))
def test_banded_alignment_is_plain_alignment(data, alphabet, edits):
    text = lambda n: data.draw(st.text(alphabet=alphabet, max_size=n))
    item = text(14)
    doc = text(6) + item[: data.draw(st.integers(0, 14))] + text(2) + item + text(4)
    d, i = (np.array([ord(c) for c in t], np.uint32) for t in (doc, item))
    exact, words, first, last, n = leaks.aligned(d, i, 0, len(d), range(-len(i) - 1, len(d) + 2), edits)
    assert (exact, words, last - first) == longest_stretches(d.tolist(), i.tolist(), edits) and n <= edits


def test_an_edit_amid_repetitive_words_is_passed(spark):
    item = " ".join(["aaaa aaab"] * 10) + " tail"
    doc = "start " + item[:45] + "x" + item[46:] + " end"
    df = lambda c, t: spark.createDataFrame([(1, t)], f"{c} long, text string")
    r = leaks.leaks(df("doc_id", doc), "doc_id", "text", df("item_id", item), "item_id", "text").first()
    assert r is not None and r.n_edits <= 1 and r.share > 0.9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 20))
def test_qgram_hashes_are_of_the_window(codes, q):
    c = np.array(codes, np.uint32)
    h = leaks.qgram_hashes(c, q)
    assert len(h) == max(0, len(c) - q + 1)
    for a, b in combinations(range(len(h)), 2):
        assert (h[a] == h[b]) == (codes[a : a + q] == codes[b : b + q])


# 9: residue
def test_residue(spark):
    rows = [(i, f"The {prose(12)} was measured. {prose(10).capitalize()} and {prose(5)}.\n\n{prose(20)}.") for i in range(200)]
    bad = ["404 Not Found\n\nThe requested page was not found on this server.", "Please enable JavaScript to view this page.", "Dear {{ name }},\n" + prose(30), "Lorem ipsum dolor sit amet consectetur", "TODO: write this section."]
    good = ["In the config, `{seed}` is expanded at start. " + prose(20), 'The page said "Please enable JavaScript" and nothing else. ' + prose(20), "sets x_{run} = y^{2} " + prose(20), "The log ended with an internal server error, so the run counts as a crash."]
    rows += [(1000 + i, t) for i, t in enumerate(bad * 3)] + [(2000 + i, t) for i, t in enumerate(good)]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").where("is_residue").collect()}
    assert got == {1000 + i for i in range(15)}


def test_residue_does_not_depend_on_the_size_of_the_table(spark):
    rows = [(f"The {prose(12)} was measured. {prose(10).capitalize()}.",) for _ in range(95)] + [("404 Not Found\n\nThe requested page was not found on this server.",)] * 5
    df = spark.createDataFrame(rows, "text string").withColumn("id", F.monotonically_increasing_id())
    many = df.select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("k"), "text").select(F.monotonically_increasing_id().alias("id"), "text")
    small, large = residue.learn(df), residue.learn(many)
    assert large.prior == pytest.approx(small.prior, abs=0.2)


def test_places_to_fill_in():
    for t in ("{{x}}", "${HOME_DIR}", "{% block a %}", "<%= x %>", "%(a)s", "%NAME%", "@@A_B@@", "[[tag]]", "«name»", "{lr}", "<insert date>", "[YOUR NAME HERE]", "(TBD: x)"):
        assert residue_core.SLOT.fullmatch(t), t
    for t in ("x_{a}", "{1, 2}", "<|endoftext|>", "<unk>", "{step:05d}", "100%", "a[0]", "${RUN_TAG:-x}"):
        assert not residue_core.SLOT.search(t), t


def test_features_of_many_passages_are_those_of_each():
    rng = np.random.default_rng(1)
    m = residue_core.Model(rng.normal(size=2 << residue_core.FEATURE_BITS).astype(np.float32), -1.5)
    passages = ["Error 0: Not Found", "---", "test test test test test", "{{ name }}", "", "Größe 0 of the page", "a", "test test test test test"]
    f, of, n_words = residue_core.featured(passages)
    assert n_words.tolist() == [4, 0, 5, 1, 0, 5, 1, 5] and sorted(set(of.tolist())) == [0, 2, 3, 5, 6, 7]
    for k, p in enumerate(passages):
        one = residue_core.featured([p])[0]
        assert sorted(one.tolist()) == sorted(f[of == k].tolist())
        if len(one):
            assert m.scores(passages)[0][k] == pytest.approx(m.odds[one].sum() * min(1, 14 / len(one)) ** 0.5 - 1.5, abs=1e-4)
    assert m.worst([["Error 404: Not Found", "---"], [], ["---"]])[1:] == [(None, None), (None, None)]


# the queries
def test_forms_of_the_found_queries(spark):
    shape = {"p1": ["row_id"], "p2": ["row_id"], "p4": ["row_id_a", "row_id_b"], "p5": ["row_id_a", "row_id_b"], "p6": ["row_id"], "p8": ["doc_id", "item_id"], "p9": ["doc_id"]}
    for p, columns in shape.items():
        df = queries.queries()[f"{p}_found"](spark, SMALL)
        rows = df.collect()
        assert sorted(df.columns) == columns and len(rows) == len(set(rows)) > 0, p
        if len(columns) == 2 and p != "p8":
            assert all(r.row_id_a < r.row_id_b for r in rows)
    assert queries.queries()["p7_ids"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_report_counts_the_pairs(spark):
    pairs, rows = queries.queries()["p4_found"](spark, SMALL).count(), queries.queries()["p4_report"](spark, SMALL).collect()
    for split in ("train", "val"):
        assert sum(r.n_pairs for r in rows if r.split == split) == pairs


def test_plans_read_only_what_they_need(spark):
    plan = queries.queries()["p6_found"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<row_id:bigint,text:string>", plan) and "Exchange" not in plan
    assert F  # columns only


def test_long_texts_are_cut_without_loss():
    rng = random.Random(4)
    old, quality.BATCH_CHARS = quality.BATCH_CHARS, 100
    try:
        texts = ["", "a" * 350, " ".join(rng.choice(VOCAB) for _ in range(200)), "short", "line\n" * 60]
        got = [(o, p) for own, pieces in quality._pieces(texts) for o, p in zip(own.tolist(), pieces)]
        assert [o for o, _ in got] == sorted(o for o, _ in got) and all(len(p) <= 100 for _, p in got)
        assert ["".join(p for o, p in got if o == k) for k in range(5)] == texts
    finally:
        quality.BATCH_CHARS = old
