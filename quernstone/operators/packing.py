"""Best-fit packing of token sequences into rows, by the order of the corpus."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a batch; batches don't go beyond a pack group.
BATCH = 128


class Pool:
    """Waiting sequences: a queue for each length, and the lengths in order."""

    def __init__(self):
        self.queues: dict[int, deque] = {}
        self.lengths: list[int] = []
        self.waiting = 0

    def put(self, batch: list[tuple]) -> None:
        for key, n in batch:
            if n not in self.queues:
                self.lengths.insert(bisect_left(self.lengths, n), n)
                self.queues[n] = deque()
            self.queues[n].append(key)
        self.waiting += len(batch)

    def take(self, room: int) -> tuple:
        """The longest sequence within ``room``, else the shortest of all; of equals the one that came first."""
        n = self.lengths[max(0, bisect_right(self.lengths, room) - 1)]
        queue = self.queues[n]
        key = queue.popleft()
        if not queue:
            del self.queues[n]
            self.lengths.remove(n)
        self.waiting -= 1
        return key, n


def best_fit(batches: Iterable[list[tuple]], row_tokens: int, buffer_size: int) -> Iterator[list[tuple]]:
    """Rows of exactly ``row_tokens`` as lists of (key, taken, whole length); ``batches`` hold (key, length).

    The pool takes whole batches while fewer than ``buffer_size`` sequences wait, before every placement.
    A sequence that doesn't fit whole is placed only where none does; it fills the row and its
    tail is lost.  With the last sequence it ends; an unfinished row is dropped.
    """
    pool, source = Pool(), iter(batches)
    row, room = [], row_tokens
    while True:
        while pool.waiting < buffer_size and (batch := next(source, None)) is not None:
            pool.put(batch)
        if not pool.waiting:
            return
        key, n = pool.take(room)
        row.append((key, min(n, room), n))
        room -= row[-1][1]
        if not room:
            yield row
            row, room = [], row_tokens


def pack_rows(docs: DataFrame, row_tokens: int = 2049, buffer_size: int = 1000, epochs: int = 1) -> DataFrame:
    """Rows packed within each pack group: ``pack_group``, ``row_idx``, ``epoch``, ``slot``, ``doc``, ``n_taken``, ``n_tokens``.

    The documents are read ``epochs`` times in a row; ``epoch`` is that of the last document read
    into the pool when the row was done, not that of the row's own documents.

    ``docs`` has ``pack_group``, ``pos``, ``doc`` and ``n_tokens`` (the start token counted).  A group, a
    shard or a row group, is of bounded size and packed in one task; other groups don't matter
    to it, so rows differ from those of one pool over the whole corpus.  Where all documents are of
    one group, they are the rows of that one pool.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("pack_group", "doc")}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        group, read = pdf["pack_group"].iloc[0], [0]
        pairs = list(zip(pdf["doc"], pdf["n_tokens"]))

        def source() -> Iterator[list[tuple]]:
            for read[0] in range(1, epochs + 1):
                yield from (pairs[k : k + BATCH] for k in range(0, len(pairs), BATCH))

        rows = ((read[0], row) for row in best_fit(source(), row_tokens, buffer_size))
        out = [(group, r, epoch, slot, *placed) for r, (epoch, row) in enumerate(rows) for slot, placed in enumerate(row)]
        return pd.DataFrame(out, columns=["pack_group", "row_idx", "epoch", "slot", "doc", "n_taken", "n_tokens"])

    schema = f"pack_group {kinds['pack_group']}, row_idx int, epoch int, slot int, doc {kinds['doc']}, n_taken int, n_tokens int"
    return docs.select("pack_group", "pos", "doc", "n_tokens").groupBy("pack_group").applyInPandas(pack, schema)


def shift_targets(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs and targets of packed rows: ``tokens`` has ``keys``, ``pos`` and ``token_id``."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"])
    rows = tokens.groupBy(*keys).agg(ids.alias("ids"))  # a row has a fixed number of tokens
    n = F.size("ids") - 1
    return rows.select(*keys, F.slice("ids", F.lit(1), n).alias("inputs"), F.slice("ids", F.lit(2), n).alias("targets"))


def eval_rows(rows: DataFrame, steps: int, batch: int) -> DataFrame:
    """The first ``steps`` batches of packed rows, numbered."""
    return rows.where(F.col("row_idx") < steps * batch).withColumn("step", F.floor(F.col("row_idx") / batch).cast("int"))
