"""Building and filtering POINTS rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import allowed
from ..functions.values import strip
from ..schema import POINTS, TAGS


def to_points(df: DataFrame, entity: Column, values: dict[str, Column], percents: Iterable[str] = ()) -> DataFrame:
    """One row per named value: the columns of df plus key, var, raw and is_percent."""
    percents = set(percents)
    cells = [
        F.struct(F.lit(name).alias("var"), value.cast("double").alias("raw"), F.lit(name in percents).alias("is_percent"))
        for name, value in values.items()
    ]
    d = df.withColumn("key", entity).withColumn("cell", F.explode(F.array(*cells)))
    return d.select("*", "cell.*").drop("cell")


def normalised_names(points: DataFrame) -> DataFrame:
    """Keys trimmed, blank ones ``total``; variables trimmed, blank ones left out."""
    key = strip(F.coalesce("key", F.lit("")))
    d = points.withColumn("key", F.when(key == "", F.lit("total")).otherwise(key)).withColumn("var", strip(F.col("var")))
    return d.filter("var <> ''")


def select_vars(points: DataFrame, keep: Iterable[str] = (), drop: Iterable[str] = ()) -> DataFrame:
    return points.filter(allowed(F.col("var"), keep, drop))


def with_tags(df: DataFrame, hosts: DataFrame | None = None, **tags: str) -> DataFrame:
    """Constant tags; with ``hosts`` (one row for each host) dc, project and role come from it.

    The host table is a dimension: it is joined by the optimizer's own choice, broadcast while
    under the session's threshold.
    """
    for name in tags:
        if name not in TAGS:
            raise ValueError(f"metrics can't add the tag {name!r}")
    d = df.withColumns({name: F.lit(value) for name, value in tags.items()})
    return d if hosts is None else d.drop("dc", "project", "role").join(hosts, "host", "left")


def resample(points: DataFrame, scrape: str, *by: str) -> DataFrame:
    """The last sample of each series in every scrape slot."""
    series = [*by, "key", "var"]
    slot = F.window("ts", scrape)
    rest = [c for c in points.columns if c not in series]
    last = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("last")
    return points.groupBy(*series, slot.alias("slot")).agg(last).select(*series, "last.*")


def from_source(spark: SparkSession, source: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """Rows of a user's source, checked against the POINTS columns."""
    from pyspark.sql.types import StructType

    rows = source(spark)
    want = StructType.fromDDL(POINTS)
    have = {f.name: f.dataType for f in rows.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"the source lacks these POINTS columns or their types: {wrong}")
    return rows.select(*want.names)
