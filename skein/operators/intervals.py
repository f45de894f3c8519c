"""Points in intervals: an equi-join on buckets whose width follows the length of the intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` of equal ``on`` whose closed interval holds it.

    ``at``, ``begin`` and ``end`` are whole numbers (say microseconds). An interval goes by its length into a level, whose buckets
    are as wide as the next power of two, so it touches two of them at most; a point looks into its one bucket of every level that occurs, 64 at
    most. Only rows of a common bucket meet, and the bounds are then compared exactly. Intervals that end before they begin hold nothing; nulls
    match nothing. Columns of both sides other than ``on`` must differ in name.
    """
    length = F.col(end) - F.col(begin)
    level = F.length(F.bin(F.greatest(length, F.lit(1)))).cast("int")
    held = intervals.where(length >= 0).withColumn("_level", level)
    levels = [r[0] for r in held.select("_level").distinct().collect()]
    first, last = F.expr(f"shiftright(`{begin}`, _level)"), F.expr(f"shiftright(`{end}`, _level)")
    held = held.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    places = [F.struct(F.lit(k).alias("_level"), F.shiftright(F.col(at), k).alias("_bucket")) for k in levels]
    dealt = points.select("*", F.inline(F.array(*places))) if places else points.withColumns({"_level": F.lit(0), "_bucket": F.lit(0).cast("long")}).where("false")
    met = dealt.join(held, [*on, "_level", "_bucket"]).where(F.col(at).between(F.col(begin), F.col(end)))
    return met.drop("_level", "_bucket")
