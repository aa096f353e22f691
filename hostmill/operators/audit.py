"""Questions to the long rows: latest values, audits, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_value(rows: DataFrame, key: str, var: str, agg: str) -> DataFrame:
    """The newest row of one series among those of the last send time: one pass, a row a task."""
    own = rows.filter((F.col("key") == key) & (F.col("var") == var) & (F.col("agg") == agg))
    return own.orderBy(F.desc("dts"), F.desc("dt")).limit(1)


def latest_values(rows: DataFrame, *by: str) -> DataFrame:
    """The newest value of every series."""
    return rows.groupBy(*by).agg(F.max_by("value", F.struct("dts", "dt")).alias("value"), F.max("dts").alias("dts"))


def recent(rows: DataFrame, n: int, *then: str, condition: Column | None = None) -> DataFrame:
    d = rows if condition is None else rows.filter(condition)
    return d.orderBy(F.desc("dt"), *then).limit(n)


def with_vars(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("var").isin(*names))


def _numeric_last(rows_key: str = "key") -> Column:
    return F.col(rows_key).rlike("^[0-9]+$") & (F.col("agg") == "last") & (F.col("var") == "value")


def delivery_audit(rows: DataFrame, expected: int) -> DataFrame:
    """Numbered keys that arrived against those sent, in one pass.

    Different numbers are bits of a bitmap for each 32,768 of them, made before the shuffle; keys
    that no number stands for exactly (leading zeros, 19 digits and more) are groups of their own.
    """
    ours = _numeric_last()
    exact = F.col("key").rlike("^(0|[1-9][0-9]{0,17})$")
    n = F.when(ours & exact, F.col("key").try_cast("bigint"))
    d = rows.withColumn("at", F.bitmap_bit_position(n)).groupBy(F.bitmap_bucket_number(n).alias("bucket"), F.when(ours & ~exact, F.col("key")).alias("odd")).agg(
        F.bitmap_count(F.bitmap_construct_agg("at")).alias("different"),
        F.count_if(ours).alias("rows_last"),
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("dt") >= F.col("dts")).alias("bad_dt"),
        F.count_if(F.col("host_ip") == "::").alias("bad_ip"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    delivered = F.coalesce(F.sum(F.when(F.col("odd").isNotNull(), 1).otherwise(F.col("different"))), F.lit(0)).cast("bigint").alias("delivered")
    d = d.agg(delivered, *map(total, ("rows_last", "rows_total", "bad_dt", "bad_ip")))
    return d.select(
        F.lit(expected).cast("bigint").alias("expected"), "*",
        (F.col("delivered") == expected).alias("complete"), (F.col("rows_last") > expected).alias("duplicates"),
    )


def dt_audit(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dt") >= F.col("dts")).alias("bad_dt"))


def non_last_audit(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric").agg(F.count_if(F.col("agg") != "last").alias("not_last"))


def host_ip_audit(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric").agg(F.count_if(F.col("host_ip") == "::").alias("no_host_ip"))


def pair_lookup(pairs: DataFrame, **parts) -> DataFrame:
    """The newest row of one tuple."""
    condition = F.lit(True)
    for name, value in parts.items():
        condition = condition & (F.col(name) == value)
    return pairs.filter(condition).orderBy(F.desc("dt")).limit(1)


def pair_search(pairs: DataFrame, port: int, proto: str) -> DataFrame:
    """Number of rows with the port at either end and traffic."""
    either = (F.col("src_port") == port) | (F.col("dst_port") == port)
    return pairs.filter(either & (F.col("proto") == proto) & (F.col("bytes") > 0) & (F.col("packets") > 0)).agg(F.count(F.lit(1)).alias("n"))


def throughput(rows: DataFrame, seconds: float) -> DataFrame:
    """Rows of every metric and in all (metric null), and rows a second."""
    rate = F.round(F.col("n") / F.lit(seconds), 2) if seconds > 0 else F.lit(0.0)
    return rows.rollup("metric").agg(F.count(F.lit(1)).alias("n")).withColumn("rows_per_s", rate.cast("double"))


def target_parity(targets: dict[str, DataFrame]) -> DataFrame:
    """Row counts by target and whether all are equal and above 0."""
    d = None
    for name, rows in targets.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.lit(name))
        d = one if d is None else d.unionByName(one)
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lit(1))  # one row for each target
    return d.withColumn("parity", (F.min("n").over(w) == F.max("n").over(w)) & (F.min("n").over(w) > 0)).select("target", "n", "parity")
