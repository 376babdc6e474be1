"""Token sequences laid into rows of fixed capacity by minimum bin slack.

The number of different lengths is bounded by the capacity, so the packing is planned on
the histogram of lengths and not on the sequences: for a row that starts with the longest
length left, a bitset subset-sum over the lengths left finds the fullest combination.  The
combination is used as often as the counts allow and then removed, so the plan takes about as
many steps for a billion sequences as for a million.  Sequences then take the places
planned for their length by their rank among those of equal length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.bpe import SPLIT, VOCABULARY, read_ranks
from quernstone.plans.durable import spread, written

#: About so many sequences of one length are ranked by one task, and so many places looked up together.
PART, BLOCK = 20_000, 4096


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=read_ranks(path), special_tokens={})


def sequence_lengths(df: DataFrame, id_col: str, split_col: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id``, ``split`` and ``n``, the number of tokens with one start token."""
    source = spread(df.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(text).cast("string").alias("text")).where("text is not null"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary).encode_ordinary
        for b in batches:
            n = pa.array([1 + len(encode(t)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.record_batch({"id": b.column(0), "split": b.column(1), "n": n})

    kind = {c: source.schema[c].dataType.simpleString() for c in ("id", "split")}
    return source.mapInArrow(apply, f"id {kind['id']}, split {kind['split']}, n long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best, as lengths and numbers.

    Bit s of a bitset tells whether the lengths looked at so far can sum to s.  Longer lengths
    come first, and the search ends when the room can be filled wholly.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take, before = min(counts[length], room // length), 1, reach
        while left:
            take = min(take, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        steps.append((length, before))
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks' end, number in a row, first row) of each step and length."""
    left, used, row, out = {x: n for x, n in counts.items() if n}, dict.fromkeys(counts, 0), 0, []
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            chosen = fullest(left, capacity - longest)
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(left[x] // n for x, n in chosen.items())
            for x, n in chosen.items():
                out.append((x, used[x], used[x] + n * times, n, row))
                used[x] += n * times
                left[x] -= n * times
            row += times
    return out


def packed(df: DataFrame, id_col: str, split_col: str, text: str, capacity: int = 2049, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of every split: ``split``, ``row_no`` from 0, ``n_records``, ``used``, ``unused``, ``records``.

    ``records`` holds the id, ``piece`` (0 for a whole sequence or its first part), ``start`` and
    ``length`` in tokens.  A sequence longer than a row is cut into full rows and a rest, which
    is packed like any other.  An empty text is its start token; a null text has no sequence; a
    null split is a split of its own; repeated rows are packed each time.
    """
    lengths = sequence_lengths(df, id_col, split_col, text, vocabulary)
    items = lengths.select("id", "split", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    items = items.select("id", "split", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))
    items = written(items)
    histogram = written(items.groupBy("split", "length").agg(F.count(F.lit(1)).alias("n")))  # at most ``capacity`` rows of a split
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    wide = histogram.withColumn("parts", F.ceil(F.col("n") / PART)).where("parts > 1").select("split", "length", "parts")
    part = F.pmod(F.xxhash64("id", "piece"), F.coalesce("parts", F.lit(1)))
    items = items.join(F.broadcast(wide), same(items, wide, "split", "length"), "left").select("id", items["split"], "piece", "start", items["length"], part.alias("part"))

    parts = items.groupBy("split", "length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("split", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity)
        out = pd.DataFrame(rows, columns=["length", "lo", "hi", "in_row", "first_row"])
        out.insert(0, "split", pdf["split"].iloc[0])
        return out

    kind = items.schema["split"].dataType.simpleString()
    steps = histogram.groupBy("split").applyInPandas(planned, f"split {kind}, length int, lo long, hi long, in_row long, first_row long")
    # each block of ranks knows the steps that reach into it, so a rank meets no others
    block = lambda c: F.floor(F.col(c) / BLOCK)
    steps = steps.where("hi > lo").withColumn("block", F.explode(F.sequence(block("lo"), F.floor((F.col("hi") - 1) / BLOCK))))

    within = Window.partitionBy("split", "length", "part").orderBy("id", "piece")
    ranked = items.withColumn("rn", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, same(ranked, offsets, "split", "length", "part")).select(
        "id", ranked["split"], "piece", "start", ranked["length"], (F.col("rn") + F.col("offset")).alias("rank")
    ).withColumn("block", block("rank"))
    placed = ranked.join(steps, [*same(ranked, steps, "split", "length", "block"), F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")]).select(
        ranked["split"], (F.col("first_row") + F.floor((F.col("rank") - F.col("lo")) / F.col("in_row"))).alias("row_no"), "id", "piece", "start", ranked["length"]
    )
    record = F.struct(F.col("id").alias(id_col), "piece", "start", "length")
    rows = placed.groupBy("split", "row_no").agg(F.count(F.lit(1)).alias("n_records"), F.sum("length").alias("used"), F.sort_array(F.collect_list(record)).alias("records"))
    return rows.select(F.col("split").alias(split_col), "row_no", "n_records", "used", (F.lit(capacity) - F.col("used")).alias("unused"), "records")
