"""Text decoded with the wrong character encoding: found, and restored where possible.

1. One pass over the different texts counts the character pairs and the units that may have twins
   (``encoding_core.units``); the pairs once more without the tokens that read as UTF-8 behind another codec.
2. Units are joined with their clean near-twins: all that are equal
   when both are stripped of their non-ASCII characters.  Aligning the two shows which
   characters became which, and so which pairs of codecs do such things to this corpus.
3. What was learned is applied to every record: a token of unusual character pairs is
   garbled if undoing a learned transformation makes it usual (``Judge``).  Nothing is tried that
   no twins have shown.

The twins are tokens, not records, as a garbled record seldom has a whole twin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.encoding_core import SKETCH_BITS, Judge, bigram_keys, filled, lost_tokens, mappings, may_be, units, usual_text
from quernstone.llm.shingles import bitmap, in_bitmap
from quernstone.plans.durable import spread, written

#: Bits of the number of a record's place in the bitmap of those that are judged.
MARK_BITS = 24


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = np.zeros(2 << SKETCH_BITS, np.int64)
    seen: Counter[tuple[str, str]] = Counter()
    n = 0

    def flush() -> pa.RecordBatch:
        at = np.flatnonzero(slots)
        none = [None] * (1 + len(at))
        out = pa.record_batch(
            {
                "slot": pa.array([-1, *at.tolist(), *[None] * len(seen)], pa.int64()),
                "key": pa.array(none + [k for k, _ in seen], pa.string()),
                "unit": pa.array(none + [u for _, u in seen], pa.string()),
                "n": pa.array([n, *slots[at].tolist(), *seen.values()], pa.int64()),
            }
        )
        slots[:] = 0
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None or text.isascii():
                continue
            n += 1
            keys, clear = np.unique(bigram_keys(text)), usual_text(text)
            slots[keys] += 1
            slots[(keys if clear is text else np.unique(bigram_keys(clear))) + (1 << SKETCH_BITS)] += 1
            seen.update(set(units(text)))
            if len(seen) > 500_000:
                yield flush()
                n = 0
    yield flush()


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: Counter[tuple[int, str, str]] = Counter()
    for b in batches:
        for garbled, clean in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.update(set(mappings(garbled, clean)))
    k, x, y = zip(*got) if got else ((), (), ())
    yield pa.record_batch({"k": pa.array(k, pa.int32()), "x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "n": pa.array(list(got.values()), pa.int64())})


def learn(df: DataFrame, text: str) -> tuple[Judge, DataFrame]:
    """What ``df`` teaches: a ``Judge``, and the units of each key (``key``, ``twin``, ``often``).

    To the driver come at most 2 * 2**20 counters, and the mappings: of characters to one
    or two, so no more than alphabets and codecs have.
    """
    texts = df.select(F.col(text).cast("string").alias("text")).where("octet_length(text) > length(text)").distinct()
    raw = texts.mapInArrow(_counts, "slot long, key string, unit string, n long")
    counts = written(raw.groupBy("slot", "key", "unit").agg(F.sum("n").alias("n")))
    slots = counts.where("slot is not null").select("slot", "n").toPandas()
    sketch = np.zeros(2 << SKETCH_BITS, np.int64)
    own = slots[slots["slot"] >= 0]
    sketch[own["slot"].to_numpy()] = own["n"].to_numpy()
    n_docs = int(slots.loc[slots["slot"] < 0, "n"].sum())

    seen = counts.where("key is not null").select("key", "unit", "n")
    usual = seen.select("key", F.col("unit").alias("twin"), F.col("n").alias("often"))
    # bytes read as characters one by one; a change of one character for one, or of some for one
    by_bytes = "length(unit) = octet_length(twin)"
    other = "n * 5 <= often and length(unit) >= length(twin) and length(unit) < octet_length(twin)"
    twins = seen.join(usual, "key").where(f"unit <> twin and ({by_bytes} or {other})").select("unit", "twin")
    taught = twins.mapInArrow(_taught, "k int, x string, y string, n long").groupBy("k", "x", "y").agg(F.sum("n").alias("n"))
    learned: dict[int, dict[tuple[str, str], int]] = {}
    for r in taught.toLocalIterator():
        learned.setdefault(r["k"], {})[r["x"], r["y"]] = r["n"]
    return Judge(sketch, n_docs, learned), usual


def restored(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """The garbled records of ``df``: the id and ``restored``, the text as far as possible.

    A null or empty text is never garbled, nor is one whose garbled sequences are only shown
    in quotation marks.  Characters that lost bytes are restored in words that have a clean twin
    (``_filled``); others stay as they are.
    Repeated rows come out as often as they go in; other columns don't matter.
    """
    kept = spread(df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")))
    learned, usual = learn(kept, "text")
    judge = df.sparkSession.sparkContext.broadcast(learned)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge.value
        for batch in batches:
            ids, out, lost, texts = [], [], [], batch.column(1).to_pylist()
            for i, t in zip(batch.column(0).to_pylist(), texts):
                if t is not None and j.best(t)[0]:
                    ids.append(i)
                    out.append(j.restore(t)[1])
                    lost.append(lost_tokens(out[-1]))
            yield pa.record_batch({"id": pa.array(ids, batch.schema.field(0).type), "restored": pa.array(out, pa.string()), "lost": pa.array(lost, pa.list_(pa.string()))})

    kind = kept.schema["id"].dataType.simpleString()
    found = written(kept.mapInArrow(apply, f"id {kind}, restored string, lost array<string>"))
    return _filled(found, usual).withColumnRenamed("id", id_col)


@F.pandas_udf(T.BooleanType())
def _may_be(lost: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([may_be(x, y) for x, y in zip(lost, clean)], dtype=bool)


def _filled(found: DataFrame, usual: DataFrame) -> DataFrame:
    """``found`` (``id``, ``restored``, ``lost``) with lost tokens as their most frequent twin that allows it."""
    lost = found.select(F.explode("lost").alias("token")).distinct().withColumn("key", F.concat(F.lit("t"), F.regexp_replace("token", r"[^\x00-\x7f]+", "")))
    twins = lost.join(usual.where("key like 't%'"), "key").where(_may_be("token", "twin"))
    best = written(twins.groupBy("token").agg(F.max(F.struct("often", "twin")).alias("best")).select("token", F.col("best.twin").alias("twin")))
    # texts go by their hash, so that repeated and null ids don't matter
    keyed = found.withColumn("hash", F.xxhash64("restored"))
    known = keyed.select("hash", F.explode("lost").alias("token")).distinct().join(best, "token").groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("token", "twin"))).alias("by"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [filled(t, dict(by)) if by else t for t, by in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch({"id": b.column(0), "restored": pa.array(out, pa.string())})

    kind = found.schema["id"].dataType.simpleString()
    return keyed.join(known, "hash", "left").select("id", "restored", "by").mapInArrow(fill, f"id {kind}, restored string")


def garbled_ids(df: DataFrame, id_col: str, text: str, among: DataFrame | None = None) -> DataFrame:
    """The ids of the garbled records; all of ``df`` teaches, only ``among`` is judged if given.

    A bitmap of fixed size leaves out most other records, so that no text is shuffled.
    """
    kept = spread(df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")))
    judge = df.sparkSession.sparkContext.broadcast(learn(kept, "text")[0])
    mark = None
    if among is not None:
        among = written(among.select(F.col(id_col).alias("id")).distinct())
        mark = df.sparkSession.sparkContext.broadcast(bitmap(among.select(F.xxhash64("id")), MARK_BITS))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge.value
        for b in batches:
            batch = b if mark is None else b.filter(pa.array(in_bitmap(mark.value, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), MARK_BITS)))
            ids = [i for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None and j.best(t)[0]]
            yield pa.record_batch({"id": pa.array(ids, batch.schema.field(0).type)})

    kind = kept.schema["id"].dataType.simpleString()
    found = kept.withColumn("mark", F.xxhash64("id")).mapInArrow(apply, f"id {kind}")
    return (found if among is None else found.join(among, "id", "left_semi")).withColumnRenamed("id", id_col)
