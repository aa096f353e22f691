"""Exact nearest-rank percentiles of groups of any size.

``percentile_disc`` keeps all different values of a group in one task. Here a group's values are
counted where they are, and the range that holds a rank is narrowed from counts of parts of it,
until few enough different values are left to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import fresh_path
from .window import joined, series

#: Parts of a range, tasks that share a group's values, and values that one task may sort.
PARTS, SALTS, HELD = 4096, 64, 100_000


def _scale(v: Column) -> Column:
    """A number that never falls as the value grows, of some 24,000 in all: sign and logarithm."""
    size = F.floor(F.ln(F.abs(v)) * 16) + 20_000
    odd = F.when(F.isnan(v), 1 << 30).when(v == float("inf"), 1 << 29).when(v == float("-inf"), -(1 << 29)).when(v == 0, 0)
    return odd.otherwise(F.when(v > 0, size).otherwise(-size)).cast("bigint")


def _kept(d: DataFrame, name: str) -> DataFrame:
    path = fresh_path(d.sparkSession, name)
    d.write.parquet(path)
    return d.sparkSession.read.parquet(path)


def _inside(counted: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values with each range of their group that they lie in; a group is spread by value."""
    spread = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return joined(counted, spread, [*keys, "salt"]).filter(F.col("value").between(F.col("lo"), F.col("hi")))


def _narrowed(d: DataFrame, part: Column, keys: Sequence[str]) -> DataFrame:
    """The part of each range that its rank lies in: lo, hi, different values, rank inside."""
    parts = d.groupBy(*keys, "p", "rank", part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    before = F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("part")) - F.col("n")
    parts = parts.withColumn("before", before).filter("before < rank AND rank <= before + n")
    return parts.select(*keys, "p", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", "kinds")


def percentiles(d: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[int], held: int = HELD) -> DataFrame:
    """keys and a column pXX for each percentile of the group's values; nulls aren't counted, NaN
    is the greatest. Groups without a value have no row."""
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")
    counted = d.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counted = _kept(counted.withColumn("salt", salt), "counted")
    sums = counted.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") / F.lit(100.0) * F.col("all"))).cast("bigint")
    ranges = sums.withColumn("p", F.explode(F.array(*map(F.lit, wanted)))).withColumn("rank", rank).select(*keys, "p", "rank", "lo", "hi")
    ranges = _kept(_narrowed(_inside(counted, ranges, keys), _scale(F.col("value")), keys), "ranges")
    width = F.col("hi") - F.col("lo")
    part = F.when(width > 0, F.floor((F.col("value") - F.col("lo")) / width * PARTS)).otherwise(F.lit(0))
    while (ranges.agg(F.max("kinds")).first()[0] or 0) > held:
        ranges = _kept(_narrowed(_inside(counted, ranges.drop("kinds"), keys), part, keys), "ranges")
    few = _inside(counted, ranges.drop("kinds"), keys)
    upto = F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("value"))
    found = few.withColumn("upto", upto).filter("upto >= rank")
    least = lambda p: F.min(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}")
    return found.groupBy(*keys).agg(*map(least, wanted))


def large_series(points: DataFrame, send: str, wanted: Sequence[int], by: Sequence[str], held: int = HELD) -> DataFrame:
    """``window.series`` where one series may hold most points."""
    keys = [*by, "key", "var", "send_at"]
    d = series(points, send, (), by)
    if not wanted:
        return d
    p = points.withColumn("send_at", F.window("ts", send)["end"])
    return joined(d, percentiles(p, keys, "raw", wanted, held), keys, "left")
