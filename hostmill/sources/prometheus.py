"""Prometheus text payloads: declared counters and gauges, summed by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import finite_number, short_name

#: name, optional labels with quoted values, then the value; a time stamp may follow.
_SAMPLE = r'^([^\s{"]+)\s*(\{(?:[^"}]|"(?:\\.|[^"\\])*")*\})?[ \t]+(\S+)'
_SPACE = r"[ \t\r\n\x0b\x0c]+"


def samples(df: DataFrame, payload: str, ids: Sequence[str]) -> DataFrame:
    """ids, line_no, name and value of each sample whose latest TYPE above it is a counter or gauge."""
    lines = df.select(*ids, F.posexplode(F.split(payload, r"\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r\n\x0b\x0c"))).filter("line <> ''")
    fields = F.split("line", _SPACE)
    is_type = (F.size(fields) == 4) & (F.get(fields, F.lit(0)) == "#") & (F.upper(F.get(fields, F.lit(1))) == "TYPE")
    comment = F.col("line").startswith("#")
    name = F.when(is_type, F.get(fields, F.lit(2))).when(~comment, F.regexp_extract("line", _SAMPLE, 1))
    d = lines.withColumn("name", F.nullif(name, F.lit(""))).filter("name IS NOT NULL")
    d = d.withColumn("declared", F.when(comment, F.lower(F.get(fields, F.lit(3)))))
    above = Window.partitionBy(*ids, "name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("type", F.last("declared", ignorenulls=True).over(above))
    d = d.filter("declared IS NULL AND type IN ('counter', 'gauge')")
    d = d.withColumn("value", finite_number(F.regexp_extract("line", _SAMPLE, 3)))
    return d.filter("value IS NOT NULL").select(*ids, "line_no", "name", "value")


def points_from_prometheus(df: DataFrame, payload: str, ids: Sequence[str], var_mode: str = "full") -> DataFrame:
    """ids, key ``total``, var and the sum of its samples; ``short`` names may meet in one sum."""
    if var_mode not in ("full", "short"):
        raise ValueError(f"var_mode is full or short, not {var_mode!r}")
    var = short_name(F.col("name")) if var_mode == "short" else F.col("name")
    d = samples(df, payload, ids).groupBy(*ids, var.alias("var")).agg(F.sum("value").alias("raw"))
    return d.select(*ids, F.lit("total").alias("key"), "var", "raw", F.lit(False).alias("is_percent"))


def prometheus_rejects(df: DataFrame, payload: str, ids: Sequence[str]) -> DataFrame:
    """Payloads without one usable sample."""
    return df.join(samples(df, payload, ids).select(*ids).distinct(), list(ids), "left_anti")
