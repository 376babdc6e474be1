"""Statistics of each text, and whether it is prose or a list, a table or junk.

1. One pass counts words in units of text that are surely prose or surely not by their form,
   in two tables of fixed size; their ratio tells common words from the rest.
2. A second pass turns each unit's statistics into votes.  The votes are noisy labels: how
   often each is right in either class is learned by expectation-maximization on how they
   agree, over the counts of all patterns of votes in the corpus (at most 3**6).
3. The posteriors of its units, weighted by their characters, make up each text's.  What the units that
   are no prose are, a table, a list or junk, is learned in the same way from votes of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.encoding_core import spelled_out
from quernstone.llm.quality_core import LISTED, PROSE, TYPE_VOTERS, TYPES, WORD_BITS, Batch, expectation_maximization, learn_weights, pattern, said_over, type_pattern, type_posteriors
from quernstone.llm.shingles import chunks, gathered
from quernstone.plans.durable import spread, written

BATCH_CHARS = 2_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``BATCH_CHARS`` characters, or one longer text."""
    texts = [spelled_out(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS or k == len(texts) - 1:
            yield batch.slice(at, k + 1 - at), texts[at : k + 1]
            at, size = k + 1, 0


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts, those longer than ``BATCH_CHARS`` cut at a line or blank, in groups of about that size.

    With each group the numbers of the texts that its pieces are of, in order.
    """
    owners, pieces, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > BATCH_CHARS:
                cut = max(t.rfind("\n", at + 1, at + BATCH_CHARS), t.rfind(" ", at + BATCH_CHARS // 2, at + BATCH_CHARS))
                end = cut + 1 if cut > at else at + BATCH_CHARS
            if pieces and size + end - at > BATCH_CHARS:
                yield np.array(owners), pieces
                owners, pieces, size = [], [], 0
            owners.append(k)
            pieces.append(t[at:end])
            size += end - at
            if end == len(t):
                break
            at = end
    if pieces:
        yield np.array(owners), pieces


def _batches(texts: list[str]) -> Iterator[tuple[np.ndarray, Batch]]:
    """``_pieces`` as batches; whether a text in several pieces is said over and over is judged on the whole text."""
    over = {k: said_over(Batch(p) for _, p in _pieces([t])) for k, t in enumerate(texts) if len(t) > BATCH_CHARS}
    for own, pieces in _pieces(texts):
        b = Batch(pieces)
        b.judge_repeats({j: over[k] for j, k in enumerate(own.tolist()) if k in over})
        yield own, b


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << WORD_BITS), np.uint32)
    for batch in batches:
        for _, texts in _slices(batch):
            for _, b in _batches(texts):
                guess = b.seeds()[b.word_unit]
                for row, kind in enumerate((PROSE, LISTED)):
                    counts[row] += np.bincount(b.word_slot[guess == kind], minlength=1 << WORD_BITS).astype(np.uint32)
    parts = list(chunks(counts.reshape(-1)))
    yield pa.record_batch({"chunk": pa.array([k for k, _ in parts], pa.int32()), "data": pa.array([d for _, d in parts], pa.binary())})


def text_types(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each row of ``df``: its statistics and what kind of text it is.

    ``n_words``, ``mean_word_length``, ``symbol_ratio`` (signs among the characters that aren't
    blank), ``ended_lines`` (share of lines that end in sentence punctuation), ``common_words``
    (share of words), ``listed`` (posterior share of the characters in units that are no prose),
    of it ``as_table``, ``as_list`` and ``as_junk``, and ``text_type``: ``prose`` where ``listed`` is half or less,
    else the greatest of the three.  Null and blank texts have zeros and the type ``none``.  Repeated rows come out each time; other columns don't matter.
    """
    spark = df.sparkSession
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")))
    counts = gathered(rows.select("text").mapInArrow(_word_counts, "chunk int, data binary"), 8 << WORD_BITS, summed=True)
    prose, listed = counts.astype(np.float64).reshape(2, -1)
    weights, known = learn_weights(prose, listed)
    learned = spark.sparkContext.broadcast((weights.astype(np.float32), known.astype(np.float32)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = learned.value
        for batch in batches:
            for part, texts in _slices(batch):
                n = len(texts)
                totals, units = np.zeros((7, n)), []
                for own, b in _batches(texts):
                    v = b.votes(w, k)
                    common = np.bincount(b.word_doc, (k[b.word_slot] > 0) & (w[b.word_slot] > 0.5), b.n_texts)
                    row = own[b.doc]
                    for j, x in enumerate((b.words, b.solid, b.line_ends[0], b.line_ends[1], b.letters, b.symbols * b.solid)):
                        totals[j] += np.bincount(row, x, n)
                    totals[6] += np.bincount(own, common, n)
                    units.append((row, type_pattern(b.type_votes(w, k)) * 3**6 + pattern(v), b.chars))
                words, solid, lines, ended, letters, symbols, common = totals
                row, patterns, chars = (np.concatenate(x) for x in zip(*units))
                split = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                blank = np.array([not t or t.isspace() for t in texts], bool)
                real = lambda x: pa.array(np.where(blank, 0.0, x))
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "n_words": pa.array(words.astype(np.int64)),
                        "mean_word_length": real(letters / np.maximum(1, words)),
                        "symbol_ratio": real(symbols / np.maximum(1, solid)),
                        "ended_lines": real(ended / np.maximum(1, lines)),
                        "common_words": real(common / np.maximum(1, words)),
                        "is_blank": pa.array(blank),
                        "patterns": pa.ListArray.from_arrays(pa.array(split), pa.array(patterns.astype(np.int32))),
                        "chars": pa.ListArray.from_arrays(pa.array(split), pa.array(chars.astype(np.int32))),
                    }
                )

    kind = rows.schema["id"].dataType.simpleString()
    statistics = "n_words long, mean_word_length double, symbol_ratio double, ended_lines double, common_words double"
    described = written(rows.mapInArrow(describe, f"id {kind}, {statistics}, is_blank boolean, patterns array<int>, chars array<int>"))
    n_types = (len(TYPES) + 1) ** len(TYPE_VOTERS)
    seen = described.where("not is_blank").select(F.explode("patterns").alias("p")).groupBy("p").count().collect()  # at most 3**6 * 4**4
    counts = np.zeros((n_types, 3**6))
    for r in seen:
        counts[divmod(r["p"], 3**6)] += r["count"]
    posterior, _, _ = expectation_maximization({p: int(c) for p, c in enumerate(counts.sum(axis=0)) if c})
    listed_by = np.zeros(3**6)
    for p, x in posterior.items():
        listed_by[p] = 1 - x
    types_by = type_posteriors(counts @ listed_by)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, c = b.column(7), b.column(8)
            n = np.diff(p.offsets.to_numpy())
            at = np.repeat(np.arange(b.num_rows), n)
            types, votes = np.divmod(p.flatten().to_numpy(zero_copy_only=False), 3**6)
            w = c.flatten().to_numpy(zero_copy_only=False)
            blank = b.column(6).to_numpy(zero_copy_only=False)
            own = listed_by[votes] * w
            whole = np.maximum(1, np.bincount(at, w, b.num_rows))
            share = np.where(blank, 0.0, np.bincount(at, own, b.num_rows) / whole)
            by_type = [np.where(blank, 0.0, np.bincount(at, own * types_by[types, t], b.num_rows) / whole) for t in range(len(TYPES))]
            kinds = np.where(blank, "none", np.where(share <= 0.5, "prose", np.array(TYPES)[np.argmax(by_type, axis=0)]))
            columns = [pa.array(share), *map(pa.array, by_type), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *columns], names=[*b.schema.names[:6], "listed", *(f"as_{t}" for t in TYPES), "text_type"])

    shares = ", ".join(f"as_{t} double" for t in TYPES)
    return described.mapInArrow(decide, f"id {kind}, {statistics}, listed double, {shares}, text_type string").withColumnRenamed("id", id_col)
