"""Exact byte-pair encoding by dynamic programming over prefixes.

Every prefix of a piece of text has one encoding, so one last token.  For each prefix an
automaton names the vocabulary's tokens that are its suffixes; the last token is the one
that doesn't clash with the last token of the prefix before it.  Two neighbours clash if
merging would have crossed the boundary between them at any time, which undoing their own
merges in turn shows.  The ids follow from the back-pointers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.durable import spread

TOKENIZERS = os.environ.get("QUERNSTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Fixed value: how this public vocabulary's texts are split before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces that a worker keeps.
CACHE = 400_000


class PrefixEncoder:
    """Encodes with the ranks of a vocabulary whose ids are in order of merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT):
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.size: dict[int, int] = {}
        self.suffixes = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.size[rank] = len(token)
            self.suffixes.add_word(token.decode("latin-1"), rank)
            if len(token) > 1:
                halves = self._merge(token, rank)
                if len(halves) == 2:
                    self.parts[rank] = halves
                    self.merged[halves] = rank
        self.suffixes.make_automaton()

    def _merge(self, token: bytes, below: int) -> tuple[int, ...]:
        """``token`` merged by all ranks less than ``below``: for a token's own rank, its halves."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ranks[p] for p in parts)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two apart when they stand side by side.

        Their last merges are undone, the later one first; a merge over the boundary that
        ranks before everything undone so far would have come first.
        """
        undone = 1 << 60
        while True:
            if self.merged.get((left, right), 1 << 60) < undone:
                return False
            l, r = self.parts.get(left), self.parts.get(right)
            if l is None and r is None:
                return True
            # of equal ranks the one on the left merges first, so the right one is undone first
            if r is None or l is not None and left > right:
                undone, left = left, l[1]
            else:
                undone, right = right + 1, r[0]

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece between splits."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        last = [-1] * (n + 1)
        size, fits = self.size, self.fits
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.suffixes.iter(raw.decode("latin-1")):
            ends[end].append(token)
        for end in range(n):
            for token in ends[end]:
                before = end + 1 - size[token]
                if before == 0 or last[before] >= 0 and fits(last[before], token):
                    last[end + 1] = token
                    break
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``; names of special tokens are ordinary text."""
        out: list[int] = []
        cache = self.cache
        for m in self.pattern.finditer(text):
            word = m[0]
            ids = cache.get(word)
            if ids is None:
                ids = self.piece(word)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(word) < 64:
                    cache[word] = ids
            out += ids
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once in each worker."""
    return PrefixEncoder(read_ranks(path))


def encoded(df: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row's id and ``ids``, the token ids of its text without special tokens.

    Empty and null texts give an empty list, names of special tokens are ordinary text, and
    repeated rows come out as often as they go in.  Other columns don't matter.  The
    vocabulary is a file at the same path on every worker.
    """
    source = spread(df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [e.encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                flat = np.fromiter((i for x in found for i in x), np.int32, int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.record_batch({"id": part.column(0), "ids": lists})

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(apply, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


@lru_cache(maxsize=2)
def _spellings(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def decoded(df: DataFrame, id_col: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row's id and ``raw``, the bytes that its token ids spell; an empty list spells nothing, null is null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _spellings(vocabulary)
        for batch in batches:
            raw = [None if x is None else b"".join(map(spelling.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"id": batch.column(0), "raw": pa.array(raw, pa.binary())})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), ids).mapInArrow(apply, f"id {kind}, raw binary").withColumnRenamed("id", id_col)
