"""Oversized texts cut into numbered pieces at natural boundaries.

One regular expression with bounded quantifiers does the cutting, inside Spark's own
expressions: its alternatives are ordered by the strength of the boundary (blank line, line,
sentence, white space, any character), each takes as much as the limit allows, and the next
is tried only if the stronger boundary doesn't occur in the second half of the piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pieces whose lengths are summed together.
GROUP = 128


def cutting_pattern(most: int) -> str:
    """Matches the next piece of at most ``most`` characters."""
    half = max(1, most // 2)
    span = f".{{{half},{most}}}"
    boundaries = (r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?]\s|[。！？])", r"(?<=\s)")
    return "(?s)" + "|".join([rf".{{1,{most}}}\z", *(span + b for b in boundaries), f".{{1,{most}}}"])


def pieces(df: DataFrame, id_col: str, text: str, limit: int = 10_000, overlap: int = 200) -> DataFrame:
    """The pieces of every text longer than ``limit`` characters (code points).

    Columns: the id, ``piece_no`` from 0, ``start`` (characters before the piece's new part),
    ``n_overlap`` and ``piece``, at most ``limit`` characters long.  A piece after the first begins
    with the last ``overlap`` characters of the one before, less a word cut at their start.
    Without the overlaps the pieces of a text make it up again.  Texts within the limit, empty
    and null ones give no row; a repeated row gives its pieces again.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    new = F.regexp_extract_all("text", F.lit(cutting_pattern(limit - overlap)), F.lit(0))
    long = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") > limit)
    cut = long.select("id", new.alias("parts"))
    # running sums in groups, so that the array that grows by copying has a place for each group only
    lengths = F.transform("parts", F.length)
    total = lambda first, n: F.aggregate(F.slice(lengths, first, n), F.lit(0), lambda s, x: s + x)
    group = lambda i: F.floor(i / GROUP).cast("int")
    sums = F.transform(F.sequence(F.lit(0), group(F.size("parts") - 1)), lambda g: total(g * GROUP + 1, F.lit(GROUP)))
    bases = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        lambda s: s["all"],
    )
    cut = cut.withColumn("bases", bases)
    starts = F.transform("parts", lambda p, i: F.get("bases", group(i)) + total(group(i) * GROUP + 1, i % GROUP))
    back = lambda p: F.regexp_replace(F.substring(p, -overlap, overlap), r"(?s)^\S*\s+(?=\S)", "") if overlap else F.lit("")
    shown = F.transform("parts", lambda p, i: F.when(i == 0, F.lit("")).otherwise(back(F.get("parts", i - 1))))
    rows = cut.select("id", F.posexplode(F.arrays_zip(F.col("parts").alias("new"), starts.alias("start"), shown.alias("before"))).alias("piece_no", "p"))
    return rows.select(
        F.col("id").alias(id_col), "piece_no", "p.start", F.length("p.before").alias("n_overlap"), F.concat("p.before", "p.new").alias("piece")
    )
