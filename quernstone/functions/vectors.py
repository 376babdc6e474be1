"""Vector primitives as column expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1.1920929e-07


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def rms_norm(v: Column, eps: float = EPS) -> Column:
    scale = F.sqrt(_sum(F.transform(v, lambda x: x * x)) / F.size(v) + eps)
    return F.transform(v, lambda x: x / scale)


def rotary(v: Column, position: Column, base: float = 10_000.0) -> Column:
    """The halves of ``v`` turned against each other by angles that grow with ``position``."""
    half = F.floor(F.size(v) / 2).cast("int")
    a, b = F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)
    angle = F.transform(F.sequence(F.lit(0), half - 1), lambda i: position / F.pow(F.lit(base), 2.0 * i / F.size(v)))
    first = F.zip_with(F.zip_with(a, angle, lambda x, t: x * F.cos(t)), F.zip_with(b, angle, lambda x, t: x * F.sin(t)), lambda x, y: x + y)
    second = F.zip_with(F.zip_with(b, angle, lambda x, t: x * F.cos(t)), F.zip_with(a, angle, lambda x, t: x * F.sin(t)), lambda x, y: x - y)
    return F.concat(first, second)


def relu2(v: Column) -> Column:
    return F.transform(v, lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(2.0)))


def gate(z: Column) -> Column:
    """Twice the logistic function."""
    return F.transform(z, lambda x: 2.0 / (1.0 + F.exp(-x)))


def softcap(z: Column, cap: float = 15.0) -> Column:
    return F.transform(z, lambda x: cap * F.tanh(x / cap))


def residual(v: Column, first: Column, scale: float, first_scale: float) -> Column:
    return F.zip_with(v, first, lambda x, y: scale * x + first_scale * y)


def linear(v: Column, rows: list[list[float]]) -> Column:
    """The products of ``v`` with the rows of a small matrix, a parameter; numbers beyond the shorter of both don't count."""
    dot = lambda row: _sum(F.transform(F.arrays_zip(F.slice(v, 1, len(row)).alias("x"), F.array(*map(F.lit, row)).alias("w")), lambda p: F.coalesce(p["x"] * p["w"], F.lit(0.0))))
    return F.array(*(dot(row) for row in rows))
