"""Column expressions on text and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(c: Column) -> Column:
    """The number that the text is, else null; ``NaN`` and infinities, too, are null."""
    s = stripped(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def finite(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def label(c: Column, most: int = 45) -> Column:
    """Stripped, and cut to ``most`` characters with three dots in place of the last ones; null is ``nan``."""
    s = stripped(F.coalesce(c, F.lit("nan")))
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 3)), F.lit("..."))).otherwise(s)


def shard_name(c: Column) -> Column:
    return F.format_string("shard_%05d.parquet", c)
