"""Points from tables of host samples: CPU, memory, swap and file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import strip
from ..operators.points import to_points

_OUT = ("host", "ts", "key", "var", "raw", "is_percent")


def _share(used: Column, total: Column) -> Column:
    return F.when(total > 0, used / total * 100).otherwise(F.lit(0.0))


def cpu_points(samples: DataFrame) -> DataFrame:
    """host, ts, core (null for the whole host), util."""
    key = F.when(F.col("core").isNull(), F.lit("total")).otherwise(F.concat(F.lit("core"), F.col("core").cast("string")))
    return to_points(samples, key, {"util": F.col("util")}, percents=("util",)).select(*_OUT)


def ram_points(samples: DataFrame) -> DataFrame:
    """host, ts, total, used, available."""
    values = {"total": F.col("total"), "used": F.col("used"), "free": F.col("available"), "util": _share(F.col("used"), F.col("total"))}
    return to_points(samples, F.lit("total"), values, percents=("util",)).select(*_OUT)


def swap_points(samples: DataFrame) -> DataFrame:
    """host, ts, total, used."""
    values = {"total": F.col("total"), "used": F.col("used"), "util": _share(F.col("used"), F.col("total"))}
    return to_points(samples, F.lit("total"), values, percents=("util",)).select(*_OUT)


def fs_points(samples: DataFrame) -> DataFrame:
    """host, ts, mountpoint, opts (array), total, used, free, util, inodes_total/_used/_free/_util."""
    d = samples.withColumn("mountpoint", strip(F.col("mountpoint"))).filter("mountpoint <> ''")
    share = F.col("inodes_util")
    infinite = F.abs(share) == float("inf")
    readonly = F.coalesce(F.exists("opts", lambda x: F.lower(strip(x)) == "ro"), F.lit(False))
    values = {
        "total": F.col("total"),
        "used": F.col("used"),
        "free": F.col("free"),
        "avail": F.col("free"),
        "util": F.col("util"),
        "inodes_total": F.col("inodes_total"),
        "inodes_used": F.col("inodes_used"),
        "inodes_free": F.col("inodes_free"),
        "inodes_util": F.when(share.isNull() | F.isnan(share) | infinite, F.lit(0.0)).otherwise(share),
        "readonly": readonly.cast("double"),
    }
    return to_points(d, F.col("mountpoint"), values, percents=("util", "inodes_util")).select(*_OUT)
