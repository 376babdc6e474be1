"""Template residue, filler, error pages and notices that scripts are required.

Short records that match one of a few patterns are trusted to be such text, so are places to be
filled in that are marked in the commonest way.  A naive Bayes model of passages is learned from
them and from unlabelled records by expectation-maximization, so that it knows the other
things that error pages and filler say.  Then every passage of every record is scored, and
a record is residue if one of its passages is.  Quotations and code are not looked at.

The model is fitted on all passages of all records, as distinct forms with their counts, so
that neither it nor the threshold depends on the size of the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.leaks import slices
from quernstone.llm.residue_core import DIGITS, FEATURE_BITS, SEED_SLOT, SLOT, Model, chances, counted, featured, fit, passages, trusted
from quernstone.plans.durable import spread, written


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms of passages, whether their record is trusted, and how many there are."""
    forms: Counter[tuple[str, bool]] = Counter()

    def flush() -> pa.RecordBatch:
        out = {"form": pa.array([f for f, _ in forms], pa.string()), "known": pa.array([k for _, k in forms], pa.bool_()), "n": pa.array(list(forms.values()), pa.int64())}
        forms.clear()
        return pa.record_batch(out)

    for b in batches:
        for t in b.column(1).to_pylist():
            if t:
                known = trusted(t)
                forms.update((DIGITS.sub("0", p), known or bool(SEED_SLOT.fullmatch(p))) for p in passages(t))  # numbers are all alike
            if len(forms) > 100_000:
                yield flush()
    yield flush()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forms' features, as the bytes of an array; a place to be filled in teaches nothing where its record isn't trusted."""
    for b in batches:
        forms = ["" if not k and SLOT.fullmatch(f) else f for f, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        f, of, _ = featured(forms)
        sizes = np.bincount(of, minlength=len(forms))
        ends = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
        own = pa.BinaryArray.from_buffers(pa.binary(), len(forms), [None, pa.py_buffer(ends), pa.py_buffer(f)])
        yield pa.record_batch({"known": b.column(1), "n": b.column(2), "f": own}).filter(pa.array(sizes > 0))


def _features_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch, and how many each form has."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.int32)[ends[0] // 4 : ends[-1] // 4] if len(column) else np.zeros(0, np.int32), np.diff(ends) // 4


def _weighted(forms: DataFrame, model=None) -> tuple[np.ndarray, float, float]:
    """Feature counts of ``forms``, their number, and the greatest change of their chances.

    With a broadcast ``model``, its arguments of ``chances`` and those before, each counts by its
    chance.  At most as many sums as there are features come to the driver.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total, change = np.zeros(2 << FEATURE_BITS), 0.0, 0.0
        for b in batches:
            w, (f, sizes) = b.column(0).to_numpy(zero_copy_only=False).astype(float), _features_of(b.column(1))
            if model is not None:
                now, before = model.value
                p = chances(f, sizes, *now)
                change = max(change, float(np.abs(p - (chances(f, sizes, *before) if before else 0.0)).max(initial=0)))
                w = w * np.where(p < 1e-12, 0.0, p)  # less than what a sum of floats keeps
            sums += counted(f, sizes, w)
            total += float(w.sum())
        at = np.flatnonzero(sums)
        yield pa.record_batch({"slot": pa.array([-2, -1, *at.tolist()], pa.int64()), "v": pa.array([change, total, *sums[at].tolist()], pa.float64())})

    got = forms.select("n", "f").mapInArrow(apply, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v"), F.max("v").alias("most")).toPandas()
    own = got[got["slot"] >= 0]
    sums = np.zeros(2 << FEATURE_BITS)
    sums[own["slot"].to_numpy()] = own["v"].to_numpy()
    return sums, float(got.loc[got["slot"] == -1, "v"].sum()), float(got.loc[got["slot"] == -2, "most"].max()) if len(got) else 0.0


def learn(rows: DataFrame) -> Model:
    """The model for ``rows`` (``id``, ``text``), from all of them."""
    context = rows.sparkSession.sparkContext
    raw = rows.select("id", "text").where("text is not null").mapInArrow(_forms, "form string, known boolean, n long")
    forms = written(raw.groupBy("form", "known").agg(F.sum("n").alias("n")).mapInArrow(_featured, "known boolean, n long, f binary"))
    pos, n_pos, _ = _weighted(forms.where("known"))
    total, n_total, _ = _weighted(forms.where("not known"))

    def guess(odds: np.ndarray, prior: float, margin: float, before: tuple | None) -> tuple[np.ndarray, float, float]:
        model = context.broadcast(((odds, prior, margin), before))
        out = _weighted(forms.where("not known"), model)
        model.destroy()
        return out

    return fit(pos, n_pos, total, n_total, guess)


def residue(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each row of ``df``: ``score``, the log odds of its worst passage, ``passage``, ``is_residue``.

    Null, empty and blank texts have no passage, a null score and are no residue.  Repeated
    rows come out each time; other columns don't matter.  An empty table gives an empty result.
    """
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")))
    model = df.sparkSession.sparkContext.broadcast(learn(rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts, scores, worst = b.column(1).to_pylist(), [], []
            for lo, hi in slices([t or "" for t in texts], 2_000, 2_000_000):
                for score, passage in m.worst([passages(t) if t else [] for t in texts[lo:hi]]):
                    scores.append(score)
                    worst.append(passage)
            flags = np.array([s is not None and s > 0 for s in scores], bool)
            yield pa.record_batch({"id": b.column(0), "score": pa.array(scores, pa.float64()), "passage": pa.array(worst, pa.string()), "is_residue": pa.array(flags)})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"id {kind}, score double, passage string, is_residue boolean").withColumnRenamed("id", id_col)
