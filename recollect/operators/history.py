"""Which memories were valid at many times at once: validity intervals joined with moments by dyadic ranges.

A half-open interval of whole numbers is a union of few ranges [n * 2^level, (n + 1) * 2^level), two of a level at most; a moment lies in one range of each
level. So an equality of (key, level, n) finds every pair of moment and interval that holds it once, and no other pair is looked at, however long an interval is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of ranges: milliseconds up to the year 2527.
LEVELS = 44
LAST = (1 << LEVELS) - 1


def ranges(start: Column, end: Column) -> Column:
    """The ranges (level, n) of the interval from start up to but without end, within 0 and LAST; a null start is the beginning, a null end never comes."""
    a = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)).cast("long")
    b = F.least(F.coalesce(end, F.lit(LAST)), F.lit(LAST)).cast("long")

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        low, high = F.ceil(a / size), F.floor(b / size)
        first = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.cast("long").alias("n")))
        second = F.when((low + low % 2 < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).cast("long").alias("n")))
        return F.array(first, second)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)), lambda x: x.isNotNull())


def moments(at: Column) -> Column:
    """The range of each level that holds the moment."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), F.floor(at / F.pow(F.lit(2.0), level)).cast("long").alias("n")))


def valid_at(memories: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(request, id) of the memories (id, valid_from, valid_to and the keys) that were valid at the moment of each request (request, at, keys). Rows with a null key or moment meet nothing."""
    own = memories.select("id", *keys, F.explode(ranges(F.col("valid_from"), F.col("valid_to"))).alias("range"))
    asked = requests.where(F.col("at").between(0, LAST - 1)).select("request", *keys, F.explode(moments(F.col("at"))).alias("range"))
    own, asked = (rows.select("*", "range.level", "range.n").drop("range") for rows in (own, asked))
    return asked.join(own, [*keys, "level", "n"]).select("request", "id")
