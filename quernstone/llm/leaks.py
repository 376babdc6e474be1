"""Passages of evaluation items inside corpus documents.

Texts are compared as words in lower case with one space between and around them.  Let the
shortest run of w words in any item have c characters.  If a run of w words of an item stands
in a document with at most e edits, the two share at least ``c + 1 - q - q * e`` q-grams (the
q-gram lemma) whose offsets, document less item, differ by at most e.  So shared q-grams are
counted in overlapping diagonal bands twice as wide; only regions that reach the bound and
are wide enough for w words go on, to banded alignment: dynamic programming over the band's
diagonals and numbers of edits, which finds the longest stretches with no more than e edits.

The items are the queries.  Up to a bounded size their index is broadcast and held against the
corpus; larger tables of items are joined with it on the q-grams.  Either way the corpus is read once
for them all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shingles import bitmap, in_bitmap
from quernstone.plans.durable import spread, written

WORD = re.compile(r"[^\W_]+")
#: Least and greatest length of the q-grams; within them as long as the bound allows.
SHORTEST, LONGEST = 4, 32
#: Characters of item text whose index is broadcast.
BLOCK_CHARS = 4_000_000
#: Shared q-grams of several texts that are looked at together.
MOST_HITS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """The words of ``text`` in lower case with single spaces between and around."""
    return " " + " ".join(WORD.findall(text.lower())) + " "


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    done, h = 0, np.zeros(len(codes), np.uint64)
    block, size, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if q & size:  # the next ``size`` characters after those done
                shifted = np.zeros_like(h)
                shifted[: len(h) - done] = block[done:]
                h = h * power + shifted
                done += size
            if done == q:
                break
            longer = block * power
            longer[: len(block) - size] += block[size:]
            block, size, power = longer, size * 2, power * power
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h[: max(0, len(codes) - q + 1)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shortest_run(texts: Iterable[np.ndarray], words: int) -> int | None:
    """Characters of the shortest run of ``words`` words in texts in normal form, None if there is none."""
    gaps = [np.flatnonzero(c == 32) for c in texts]
    return min((int((g[words:] - g[:-words]).min()) + 1 for g in gaps if len(g) > words), default=None)


def bounds(chars: int | None, words: int, edits: int) -> tuple[int, int]:
    """The length of the q-grams, and how many of them a passage of ``chars`` characters shares at least."""
    chars = chars or 2 * words + 1
    q = max(SHORTEST, min(LONGEST, (chars + 1) // (edits + 2)))
    return q, max(1, chars + 1 - q - q * edits)


class Index:
    """The q-grams of the items: sorted hashes with their items and positions."""

    def __init__(self, items: list[tuple], words: int, edits: int):
        self.ids, self.texts = [i for i, _ in items], [normal(t) for _, t in items]
        self.codes = [_codes(t) for t in self.texts]
        self.q, self.least = bounds(shortest_run(self.codes, words), words, edits)
        q = self.q
        hashes = [qgram_hashes(c, q) for c in self.codes]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        pos = np.concatenate([*map(np.arange, map(len, hashes)), np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Document position, item and item position of every shared q-gram; None if there are more than ``most``."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        n = self.last[k] - self.first[k]
        if most is not None and n.sum() > most:
            return None
        where = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[where], self.pos[where]


def whole_words(spaces: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words wholly within each stretch, with a space before and behind; ``spaces`` counts those before each place."""
    return np.maximum(0, spaces[end] - spaces[start] - 1)


def aligned(doc: np.ndarray, item: np.ndarray, low: int, high: int, shifts: range, edits: int) -> tuple[int, int, int, int, int]:
    """Banded alignment of doc[low:high] with ``item`` along the diagonals ``shifts`` (document less item).

    Most words in a row that are equal, most words of a stretch with at most ``edits`` edits; and start, end
    and edits of the longest such stretch.  Stretches begin and end with equal characters; an
    edit changes, adds or takes away one character.

    ``first[d]`` holds, for every place that a stretch can end at on a diagonal, where the longest one with so
    many edits starts.  A run of equal characters carries on the least start that any edit has
    brought to it, so a whole diagonal is one running minimum within its runs.
    """
    low, high = max(low, 0), min(high, len(doc))
    size = high - low + 1
    if size < 2:
        return 0, 0, 0, 0, 0
    none, here = np.int64(1) << 40, np.arange(size, dtype=np.int64)
    spaces = np.concatenate([[0], np.cumsum(doc[low:high] == 32)])
    same, run = {}, {}
    for d in shifts:
        eq = np.zeros(size, bool)
        a, b = max(low, d, 0), min(high, len(item) + d)
        if a < b:
            eq[a - low + 1 : b - low + 1] = doc[a:b] == item[a - d : b - d]
        same[d], run[d] = eq, np.cumsum(~eq)
    first: dict[int, np.ndarray] = {}
    exact = words = 0
    best = (0, 0, 0)
    for e in range(edits + 1):
        new = {}
        for d in shifts:
            came = here.copy()
            if e:
                fewer = [np.concatenate([[none], first[x][:-1]]) for x in (d, d - 1) if x in first]  # changed, added to the document
                fewer += [first[d + 1]] if d + 1 in first else []  # left out of it
                inside = (here + low - d >= 0) & (here + low - d <= len(item))
                came = np.where(inside, np.minimum.reduce([came, *fewer]), came)
            # the least start within each run of equal characters: later runs have lower keys
            start = np.minimum.accumulate(came - run[d] * none) + run[d] * none
            end = np.flatnonzero(same[d] & (start < here))
            if len(end):
                n = int(whole_words(spaces, start[end], end).max())
                words, exact = max(words, n), max(exact, n) if e == 0 else exact
                k = end[np.argmax(end - start[end])]
                if k - start[k] > best[1] - best[0]:
                    best = (int(start[k]), int(k), e)
            new[d] = np.where(start < here, start, none)  # an empty stretch has nothing to edit
        first = new
    return exact, words, best[0] + low, best[1] + low, best[2]


def slices(texts: list[str], most: int = 500, chars: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` texts and about ``chars`` characters, or one longer text."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and (k - lo == most or size + len(t) > chars):
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str,
          words: int = 13, edits: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents with a passage of an item: ``doc``, ``item``, ``n_words``, ``n_chars``, ``n_edits``, ``share``.

    A pair comes out if a run of ``words`` words of the item stands in the document with at most
    ``edits`` edited characters.  ``n_words`` is the longest run of words in a row that are equal
    in both, ``n_chars`` and ``n_edits`` tell of the longest stretch found with edits, ``share``
    is ``n_chars`` against the item's length.  Texts that are null, empty or of fewer words
    have no passages.  Repeated
    rows come out each time; other columns don't matter.
    """
    spark = docs.sparkSession
    source = spread(docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).cast("string").alias("text")).where("text is not null"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    kinds = {"doc": source.schema["doc"].dataType.simpleString(), "item": asked.schema["item"].dataType.simpleString()}
    schema = f"doc {kinds['doc']}, item {kinds['item']}, n_words int, n_chars int, n_edits int, share double"
    asked = asked.where(F.length("text") >= 2 * words - 1)  # shorter ones have no passage, and would come to the driver however many
    total = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total > block_chars:
        return _joined(source, asked, words, edits, schema)
    index = spark.sparkContext.broadcast(Index([tuple(r) for r in asked.collect()], words, edits))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                yield from _searched(ix, batch.column(0).slice(lo, hi - lo), texts[lo:hi], edits, words)

    return source.mapInArrow(apply, schema)


def _joined(source: DataFrame, asked: DataFrame, words: int, edits: int, schema: str) -> DataFrame:
    """The same for items of any number: both sides post their q-grams, and what meets is counted by diagonal band.

    A bitmap of fixed size leaves out q-grams that no item has.  Texts go by their hash until they are
    aligned, so copies are one text and a clash of hashes only aligns more than it must.
    """
    spark = source.sparkSession

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"n": pa.array([shortest_run((_codes(normal(t)) for t in b.column(0).to_pylist()), words)], pa.int64())})

    q, least = bounds(asked.select("text").mapInArrow(shortest, "n long").agg(F.min("n")).first()[0], words, edits)

    def posted(known: Callable[[np.ndarray], np.ndarray] | None) -> Callable:
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if k in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(k)
                    h = qgram_hashes(_codes(normal(t)), q)
                    at = np.flatnonzero(known(h)) if known else np.arange(len(h))
                    if len(at):
                        yield pa.record_batch({"h": pa.array(h[at].view(np.int64)), "k": pa.array(np.full(len(at), k, np.int64)), "pos": pa.array(at.astype(np.int32))})

        return apply

    hashed = lambda df: df.select(F.xxhash64("text").alias("k"), "text")
    item_posts = written(hashed(asked).mapInArrow(posted(None), "h long, k long, pos int").distinct())
    mark = spark.sparkContext.broadcast(bitmap(item_posts.select("h")))
    doc_posts = hashed(source).mapInArrow(posted(lambda h: in_bitmap(mark.value, h)), "h long, k long, pos int")
    d, i = doc_posts.alias("d"), item_posts.alias("i")
    width = 2 * max(1, edits)
    hits = d.join(i, F.col("d.h") == F.col("i.h")).select(F.col("d.k").alias("kd"), F.col("i.k").alias("ki"), F.col("d.pos").alias("pos"), (F.col("d.pos") - F.col("i.pos")).alias("shift"))
    bands = [F.struct(F.lit(half).alias("half"), F.floor((F.col("shift") + half * (width // 2)) / width).alias("band")) for half in (0, 1)] if edits else [F.struct(F.lit(0).alias("half"), F.col("shift").cast("long").alias("band"))]
    banded = hits.select("*", F.inline(F.array(*bands)))
    region = [F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("shift").alias("smin"), F.max("shift").alias("smax")]
    cells = banded.groupBy("kd", "ki", "half", "band").agg(F.count(F.lit(1)).alias("n"), *region).where(F.col("n") >= least)
    pairs = written(cells.groupBy("kd", "ki").agg(F.collect_set(F.struct("lo", "hi", "smin", "smax")).alias("cells")))
    docs = source.withColumn("kd", F.xxhash64("text")).withColumnRenamed("text", "doc_text")
    items = asked.withColumn("ki", F.xxhash64("text")).withColumnRenamed("text", "item_text")
    met = docs.join(pairs, "kd").join(items, "ki").select("doc", "item", "doc_text", "item_text", "cells")
    chars = 2 * words + 1

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, (t, x, regions) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))):
                text, item = _codes(normal(t)), _codes(normal(x))
                got = [aligned(text, item, r["lo"] - chars, r["hi"] + q + chars, range(r["smin"] - edits, r["smax"] + edits + 1), edits) for r in regions]
                if (got := [g for g in got if g[1] >= words]):
                    n, first, e = max((last - first, first, e) for _, _, first, last, e in got)
                    found.append((k, max(g[0] for g in got), n, e, n / max(1, len(item))))
            k, n_words, n_chars, n_edits, part = zip(*found) if found else ((), (), (), (), ())
            at = pa.array(k, pa.int64())
            yield pa.record_batch(
                {
                    "doc": b.column(0).take(at), "item": b.column(1).take(at), "n_words": pa.array(n_words, pa.int32()),
                    "n_chars": pa.array(n_chars, pa.int32()), "n_edits": pa.array(n_edits, pa.int32()), "share": pa.array(part, pa.float64()),
                }
            )

    return met.mapInArrow(verified, schema)


def _searched(ix: Index, ids: pa.Array, texts: list[str], edits: int, words: int) -> Iterator[pa.RecordBatch]:
    """What ``_search`` finds, by halves of the texts where they share very many q-grams with items."""
    found = _search(ix, ids, texts, edits, words, MOST_HITS if len(texts) > 1 else None)
    if found is not None:
        yield found
        return
    half = len(texts) // 2
    yield from _searched(ix, ids.slice(0, half), texts[:half], edits, words)
    yield from _searched(ix, ids.slice(half), texts[half:], edits, words)


def _search(ix: Index, ids: pa.Array, texts: list[str], edits: int, words: int, most: int | None = None) -> pa.RecordBatch | None:
    chars = 2 * words + 1
    doc_at, item_at, words_at, chars_at, edits_at, share_at = [], [], [], [], [], []
    norm = [normal(t) for t in texts]
    codes = _codes("\n".join(norm))
    starts = np.cumsum([0, *(len(t) + 1 for t in norm)])[:-1]
    hits = ix.hits(qgram_hashes(codes, ix.q), most)
    if hits is None:
        return None
    at, item, pos = hits
    if len(at):
        doc = np.searchsorted(starts, at, "right") - 1
        inside = at + ix.q <= starts[doc] + np.array([len(t) for t in norm])[doc]
        doc, item, at, pos = doc[inside], item[inside], (at - starts[doc])[inside], pos[inside]
        if len(texts) * len(ix.ids) <= 5_000_000:  # pairs with too few hits in all have too few in each band
            pair = doc * len(ix.ids) + item
            often = np.bincount(pair)[pair] >= ix.least
            doc, item, at, pos = doc[often], item[often], at[often], pos[often]
        width = max(1, edits)
        spaces = np.concatenate([[0], np.cumsum(codes == 32)])
        longest = np.array([len(t) for t in norm])
        shift = at - pos
        cells = []
        for half in range(2 if edits else 1):  # bands of twice the width overlap by half
            band = (shift + half * width) // (2 * width) if edits else shift
            key = (doc << 52) | (item << 30) | (band + (1 << 29))  # 500 texts, fewer than 2**22 items
            order = np.argsort(key, kind="stable")  # hits are in order of their place
            key, a, s = key[order], at[order], shift[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(a) > 4 * chars)])) if len(key) else np.zeros(0, np.int64)
            end = np.append(new[1:], len(key)).astype(np.int64) if len(new) else new
            # an edit near an end hides up to q q-grams, so the passage may be so much longer
            where = key[new] >> 52
            base, slack = starts[where], ix.q * edits + edits
            lo, hi = np.maximum(a[new] - slack, 0), np.minimum(a[end - 1] + ix.q + slack, longest[where])
            keep = (end - new >= ix.least) & (spaces[base + hi] - spaces[base + lo] >= words + 1 - edits)
            cells += [(int(key[b] >> 52), int(key[b] >> 30 & (1 << 22) - 1), int(a[b]), int(a[e - 1]), int(s[b:e].min()), int(s[b:e].max())) for b, e in zip(new[keep], end[keep])]
        best: dict[tuple[int, int], list] = {}
        parts: dict[int, np.ndarray] = {}
        seen = set()
        for d, i, lo, hi, smin, smax in cells:
            if (d, i, lo, hi, smin, smax) in seen:
                continue
            seen.add((d, i, lo, hi, smin, smax))
            text = parts.setdefault(d, _codes(norm[d]))
            n_words, most, first, last, n_edits = aligned(text, ix.codes[i], lo - chars, hi + ix.q + chars, range(smin - edits, smax + edits + 1), edits)
            n_chars = last - first
            if most >= words:
                old = best.setdefault((d, i), [0, 0, 0])
                old[0] = max(old[0], n_words)
                if n_chars > old[1]:
                    old[1:] = [n_chars, n_edits]
        for (d, i), (w, c, e) in best.items():
            doc_at.append(d)
            item_at.append(ix.ids[i])
            words_at.append(w)
            chars_at.append(c)
            edits_at.append(e)
            share_at.append(c / max(1, len(ix.texts[i])))
    kind = pa.array(ix.ids).type if ix.ids else pa.int64()
    return pa.record_batch(
        {
            "doc": ids.take(pa.array(doc_at, pa.int64())), "item": pa.array(item_at, kind), "n_words": pa.array(words_at, pa.int32()),
            "n_chars": pa.array(chars_at, pa.int32()), "n_edits": pa.array(edits_at, pa.int32()), "share": pa.array(share_at, pa.float64()),
        }
    )
