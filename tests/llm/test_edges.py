"""Every operator with nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe, encoding, leaks, neardup, overlap, packing, pieces, quality, residue

LONG = " ".join(f"word{i % 977} stands near word{i % 31}." for i in range(60_000))  # about two million characters
ROWS = [(1, "train", LONG), (2, "val", LONG), (3, "train", ""), (4, "train", " \n\t"), (5, "train", None), (6, None, "short"), (7, "val", "short"), (7, "val", "short"), (None, "train", LONG), (8, "train", "\U0001f6b2é\u0000x"), (9, "train", "x" * 300_000)]
CLASH = ("id", "text", "n", "key", "rep", "pos", "slot", "shingles", "piece", "doc", "item", "held", "score", "restored")


def found(df):
    members, links = neardup.linked(df, "row", "body", similarity=0.6, size=3, min_words=1)
    return neardup.all_pairs(members, links)


def grouped(df):
    return neardup.groups(*neardup.linked(df, "row", "body"))


OPERATORS = {
    "garbled": lambda df: encoding.garbled_ids(df, "row", "body"),
    "restored": lambda df: encoding.restored(df, "row", "body"),
    "types": lambda df: quality.text_types(df, "row", "body"),
    "packed": lambda df: packing.packed(df, "row", "part", "body"),
    "overlaps": lambda df: overlap.overlaps(df, "row", "part", "body", min_words=1),
    "pairs": found,
    "groups": grouped,
    "pieces": lambda df: pieces.pieces(df, "row", "body"),
    "ids": lambda df: bpe.encoded(df, "row", "body"),
    "leaks": lambda df: leaks.leaks(df, "row", "body", df.limit(3), "row", "body"),
    "residue": lambda df: residue.residue(df, "row", "body"),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row long, part string, body string")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(rows, name):
    assert OPERATORS[name](rows.where("false")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_dirty_rows_and_clashing_columns(rows, name):
    plain = OPERATORS[name](rows).collect()
    clashing = OPERATORS[name](rows.withColumns({c: F.lit("other") for c in CLASH})).collect()
    assert sorted(map(str, plain)) == sorted(map(str, clashing))


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    df = spark.createDataFrame([(None, None, None), (1, None, None)], "row long, part string, body string")
    got = OPERATORS[name](df).collect()
    assert len(got) == (2 if name in ("types", "ids", "residue") else 0)


def test_defined_results(rows):
    ids = {r.row: r.ids for r in OPERATORS["ids"](rows).collect() if r.row in (3, 4, 5, 7)}
    assert ids[3] == [] and ids[5] == [] and ids[4]
    types = [(r.row, r.text_type) for r in OPERATORS["types"](rows).collect()]
    assert (3, "none") in types and (4, "none") in types and (5, "none") in types and types.count((7, types[[t[0] for t in types].index(7)][1])) == 2
    packed = OPERATORS["packed"](rows).collect()
    assert all(r.used + r.unused == 2049 and r.used == sum(x.length for x in r.records) for r in packed)
    whole = sorted(x.row for r in packed for x in r.records if x.piece == 0 and x.row)
    assert whole == [1, 2, 3, 4, 6, 7, 7, 8, 9]
    pairs = {(r.a, r.b) for r in found(rows).collect()}
    assert (1, 2) in pairs and all(a < b for a, b in pairs)
    assert {(r.held_id, r.train_id) for r in OPERATORS["overlaps"](rows).collect()} == {(2, 1)}
    scores = {r.row: r.score for r in OPERATORS["residue"](rows).collect()}
    assert scores[3] is None and scores[5] is None
