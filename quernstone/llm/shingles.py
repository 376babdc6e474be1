"""Sets of word sequences, and counters of fixed size over a whole corpus.

``Words`` are the longest runs of letters and digits of the lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Counters and bitmaps travel in pieces of this many bytes.
CHUNK = 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BITMAP_BITS = 26


def words_of(text: str) -> list[str]:
    """The words of ``text``, lower-cased character by character as SQL does it.

    ``str.lower`` would break a word behind a dotted capital I and look for the ends of Greek words.
    """
    return WORD.findall(text.replace("İ", "i").replace("Σ", "σ").lower())


class WordHashes(dict):
    """64-bit hashes of words, of which a bounded number is kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[str], hashes: WordHashes, size: int) -> np.ndarray:
    """The different sequences of ``size`` words, as sorted 64-bit hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * _ODD[k % 5] + a[k : k + n]
        out ^= out >> np.uint64(32)
        out *= _ODD[0]
    return np.unique(out)


def set_key(shingles: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def short_key(key: bytes) -> int:
    """The first seven bytes as a number: for candidates, which are told apart by the whole key later."""
    return int.from_bytes(key[:7], "big")


def at_least(share: float, n: int) -> int:
    """The least whole number that is ``share`` of ``n`` or more, without rounding errors."""
    f = Fraction(str(share))
    return -(-f.numerator * n // f.denominator)


def chunks(data: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The pieces of an array that aren't all zero."""
    raw = data.view(np.uint8)
    for k in range(0, len(raw), CHUNK):
        part = raw[k : k + CHUNK]
        if part.any():
            yield k // CHUNK, part.tobytes()


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK // 4, np.uint64)
    for data in pdf["data"]:
        total += np.frombuffer(data, np.uint32)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})


def _ored(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.uint8)
    for data in pdf["data"]:
        total |= np.frombuffer(data, np.uint8)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [total.tobytes()]})


def gathered(parts: DataFrame, n_bytes: int, summed: bool) -> np.ndarray:
    """One array of ``n_bytes`` from the pieces (``chunk``, ``data``) of all tasks, added or or-ed.

    A group has one piece of each task; the result has a fixed size.
    """
    out = np.zeros(n_bytes, np.uint8)
    two_steps = parts.withColumn("side", F.spark_partition_id() % 64)  # first within groups of tasks
    step = _summed if summed else _ored
    first = two_steps.groupBy("chunk", "side").applyInPandas(step, "chunk int, data binary")
    for r in first.groupBy("chunk").applyInPandas(step, "chunk int, data binary").toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], np.uint8)
    return out.view(np.uint32) if summed else out


def bitmap(values: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2**``bits`` bits with the top bits of every value of a column of longs set.

    It serves only to leave out rows before a join; where it fills up it leaves out fewer.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own[(v >> np.uint64(64 - bits)).astype(np.int64)] = True
        rows = list(chunks(np.packbits(own)))
        yield pa.record_batch({"chunk": pa.array([k for k, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    return gathered(values.mapInArrow(apply, "chunk int, data binary"), 1 << (bits - 3), summed=False)


def in_bitmap(packed: np.ndarray, values: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    slot = (values >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def text_sets(df: DataFrame, wanted: DataFrame, size: int, keyed: bool = False) -> DataFrame:
    """``id`` and ``shingles``, and ``key`` if ``keyed``, of the documents of ``df`` (id, text) whose id is in ``wanted`` (id).

    A bitmap of fixed size leaves out most other texts before anything is shuffled.
    """
    spark = df.sparkSession
    bits = 24
    mark = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("id")), bits))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keep = in_bitmap(mark.value, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            part = b.filter(pa.array(keep))
            sets = [shingle_set(words_of(t), hashes, size) for t in part.column(1).to_pylist()]
            key = {"key": pa.array(map(set_key, sets), pa.binary())} if keyed else {}
            yield pa.record_batch({"id": part.column(0), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))} | key)

    kind = df.schema["id"].dataType.simpleString()
    marked = df.select("id", "text", F.xxhash64("id").alias("mark")).where("text is not null")
    sets = marked.mapInArrow(apply, f"id {kind}, shingles array<long>" + ", key binary" * keyed)
    return sets.join(wanted, "id", "left_semi")
