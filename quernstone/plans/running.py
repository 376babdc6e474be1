"""Running aggregates in two levels, so that no key's rows all go through one task.

Rows are cut into blocks of the order column; a block's own running value is combined with
the aggregate of the blocks before it.  Only one row for each block passes a window by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one task looks at in order.
BLOCK = 4096

_TOTAL = {
    "min": lambda c, o: F.min(c),
    "sum": lambda c, o: F.sum(c),
    "last": lambda c, o: F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), o))["v"],
}
_RUN = {"min": lambda c: F.min(c), "sum": lambda c: F.sum(c), "last": lambda c: F.last(c, ignorenulls=True)}


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column, bool]], block: Column | None = None) -> DataFrame:
    """``df`` with a column for each of ``values``: name to (kind, column, whether the row itself counts).

    Kinds are ``min``, ``sum`` (null before the first value) and ``last`` (of the values that
    aren't null).  ``order`` is unique within a key.  ``block`` may name another ascending
    division of it than ``BLOCK`` consecutive numbers.
    """
    cut = df.withColumn("_block", block if block is not None else F.floor(F.col(order) / BLOCK))
    here = Window.partitionBy(*keys, "_block").orderBy(order)
    until = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *(_RUN[k](c).over(until if with_row else before).alias(f"_own_{n}") for n, (k, c, with_row) in values.items()))
    totals = cut.groupBy(*keys, "_block").agg(*(_TOTAL[k](c, F.col(order)).alias(f"_total_{n}") for n, (k, c, _) in values.items()))
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    prior = totals.select(*keys, "_block", *(_RUN[k](F.col(f"_total_{n}")).over(past).alias(f"_past_{n}") for n, (k, _, _) in values.items()))
    joined = own.alias("o").join(prior.alias("p"), [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*keys, "_block"]])
    result = []
    for n, (k, _, _) in values.items():
        mine, past_value = F.col(f"_own_{n}"), F.col(f"_past_{n}")
        if k == "min":
            both = F.least(mine, past_value)
        elif k == "sum":
            both = F.when(mine.isNull(), past_value).when(past_value.isNull(), mine).otherwise(mine + past_value)
        else:
            both = F.coalesce(mine, past_value)
        result.append(both.alias(n))
    return joined.select(*(F.col(f"o.{c}") for c in df.columns), *result)


def ranked(df: DataFrame, keys: list[str], by: str, order: list[Column], name: str, parts: int = 64) -> DataFrame:
    """``df`` with the place of each row within its key, from 1, by descending ``by`` (nulls last) as ``order`` has it.

    A key's rows are cut at quantiles of ``by`` into parts that are ranked for themselves, and the
    sizes of the parts before are added; equal values are in one part.
    """
    cuts = df.groupBy(*keys).agg(F.percentile_approx(by, [k / parts for k in range(1, parts)]).alias("_cuts"))
    above = F.size(F.filter("_cuts", lambda c: c > F.col(f"d.{by}")))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    cut = df.alias("d").join(cuts.alias("c"), same).select("d.*", F.when(F.col(f"d.{by}").isNull(), parts).otherwise(F.coalesce(above, F.lit(0))).alias("_part"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_past", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    joined = own.alias("o").join(sizes.alias("s"), [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_part"]])
    return joined.select(*(F.col(f"o.{c}") for c in df.columns), (F.col("_own") + F.col("_past")).alias(name))
