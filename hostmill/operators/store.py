"""Long rows at rest: flattening, tables by metric and day, retention, fan-out."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import int_or_zero
from ..schema import BUILTIN_METRICS, LOGGED_EVENTS, METRIC_ROWS

KEEP_MONTHS = 4


def flatten_events(events: DataFrame) -> DataFrame:
    """One row per variable and aggregate; texts that are no integers become 0, and values
    beyond 64 bits, which are null, stay out (``overflow_rejects``)."""
    d = _values(events).filter("v IS NOT NULL")
    return d.withColumn("value", int_or_zero(F.col("v").cast("string"))).drop("v")


def variant_int(value: Column) -> Column:
    """Numbers without their fraction, held within 64 bits; truth as 1 and 0; texts of an
    integer; 0 for all else."""
    kind = F.schema_of_variant(value)
    wide, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    number = F.when(wide >= 2.0**63, (1 << 63) - 1).when(wide < -(2.0**63), -(1 << 63)).otherwise(F.try_variant_get(value, "$", "bigint"))
    read = F.when(kind == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
    return F.coalesce(read.when(kind.rlike("^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), number), F.lit(0).cast("bigint"))


def judged_data(data: Column) -> Column:
    """A variant as the map of maps that events have. Each entry is judged alone: those that are no
    objects go, values become integers (``variant_int``); null where there is no object at all."""
    of = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    objects = F.filter(of(data), lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT"))
    inner = lambda v: F.map_from_entries(F.transform(of(v), lambda a: F.struct(a["key"], variant_int(a["value"]))))
    return F.map_from_entries(F.transform(objects, lambda e: F.struct(e["key"], inner(e["value"]))))


def _values(events: DataFrame) -> DataFrame:
    rest = [c for c in events.columns if c != "data"]
    d = events.select(*rest, F.explode("data").alias("var", "aggs"))
    return d.select(*rest, "var", F.explode("aggs").alias("agg", "v"))


def overflow_rejects(events: DataFrame) -> DataFrame:
    """The values that ``flatten_events`` leaves out, without a value."""
    return _values(events).filter("v IS NULL").drop("v")


def stamp(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """METRIC_ROWS columns: times from dt (ms) and dts (s), an ingest time, ``::`` for no host_ip.

    Unknown columns go, tags that are missing become empty.
    """
    host_ip = F.coalesce("host_ip", F.lit("::")) if "host_ip" in rows.columns else F.lit("::")
    dt, dts = F.timestamp_millis("dt"), F.timestamp_seconds("dts")
    d = rows.withColumns({"host_ip": host_ip, "dtv": F.current_timestamp() if at is None else at, "day": F.to_date(dt), "dt": dt, "dts": dts})
    for tag in ("dc", "project", "role", "host"):
        if tag not in d.columns:
            d = d.withColumn(tag, F.lit(""))
    return d.select(*StructType.fromDDL(METRIC_ROWS).names)


def write_metric_rows(rows: DataFrame, root: str, mode: str = "append") -> None:
    """A folder per metric and day, rows in it sorted by time, host and key.

    Hosts spread a large day over tasks, so that one metric may hold most rows.
    """
    spread = F.pmod(F.xxhash64("host"), F.lit(64))
    d = rows.repartition("metric", "day", spread).sortWithinPartitions("metric", "day", "dt", "host", "key")
    d.write.mode(mode).partitionBy("metric", "day").parquet(root)


def read_metric(spark: SparkSession, root: str, metric: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of one metric, or of all, in days [since, until]; both prune folders."""
    d = spark.read.schema(METRIC_ROWS).parquet(root)
    if metric is not None:
        d = d.filter(F.col("metric") == metric)
    if since is not None:
        d = d.filter(F.col("day") >= F.lit(since).cast("date"))
    return d if until is None else d.filter(F.col("day") <= F.lit(until).cast("date"))


def day_folders(spark: SparkSession, root: str, metric: str) -> list[str]:
    """The days of a metric that have a folder, newest first. Only names are read."""
    fs, folder = _folder(spark, f"{root}/metric={metric}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((n.split("=", 1)[1] for n in names if n.startswith("day=")), reverse=True)


def read_days(spark: SparkSession, root: str, metric: str, days: Sequence[str]) -> DataFrame:
    """The rows of these day folders; no other folder is listed."""
    paths = [f"{root}/metric={metric}/day={d}" for d in days]
    d = spark.read.schema(METRIC_ROWS).option("basePath", root)
    return d.parquet(*paths) if paths else spark.createDataFrame([], METRIC_ROWS)


def newest_days(spark: SparkSession, root: str, metric: str, condition: Column, n: int = 1) -> list[str]:
    """The days to read for the newest ``n`` rows (by dt) for which the condition holds.

    A day's rows are all newer than those of the days before, so folders are read from the newest
    backwards, each time as many as so far, until they hold n. Of each only the count is taken.
    """
    days = day_folders(spark, root, metric)
    taken = found = 0
    while taken < len(days) and found < n:
        more = days[taken : max(1, 2 * taken)]
        found += read_days(spark, root, metric, more).filter(condition).limit(n - found).count()
        taken += len(more)
    return days[:taken]


def recent_rows(spark: SparkSession, root: str, metric: str, n: int, *then: str, condition: Column | None = None) -> DataFrame:
    """The newest n rows of a metric, without reading the days before theirs."""
    condition = F.lit(True) if condition is None else condition
    d = read_days(spark, root, metric, newest_days(spark, root, metric, condition, n))
    return d.filter(condition).orderBy(F.desc("dt"), *then).limit(n)


def latest_row(spark: SparkSession, root: str, metric: str, condition: Column, longest_send: int) -> DataFrame:
    """The row of the last send time (then of the last dt) for which the condition holds.

    The newest days that have such a row give a candidate. One with a later send time has its dt
    less than ``longest_send`` seconds before that, which tells how far back to read.
    """
    days = newest_days(spark, root, metric, condition)
    top = read_days(spark, root, metric, days).filter(condition).agg(F.max("dts").alias("dts"))
    since = top.select((F.to_date(F.col("dts") - F.make_dt_interval(secs=F.lit(longest_send)))).cast("string")).first()[0]
    chosen = [] if since is None else [d for d in day_folders(spark, root, metric) if d >= min(since, days[-1])]
    return read_days(spark, root, metric, chosen).filter(condition).orderBy(F.desc("dts"), F.desc("dt")).limit(1)


def apply_retention(rows: DataFrame, as_of: Column, months: int = KEEP_MONTHS) -> DataFrame:
    """Rows whose time plus the retention is still ahead; the day bound prunes folders."""
    limit = as_of.cast("timestamp") - F.make_interval(months=F.lit(months))
    d = rows.filter(F.col("dt") > limit)
    return d.filter(F.col("day") >= F.to_date(limit)) if "day" in rows.columns else d


def expired_days(rows: DataFrame, as_of: Column, months: int = KEEP_MONTHS) -> DataFrame:
    """Day folders all of whose rows are past the retention."""
    limit = F.to_date(as_of.cast("timestamp") - F.make_interval(months=F.lit(months)))
    return rows.select("metric", "day").distinct().filter(F.col("day") < limit)


def _logged(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    """``line`` and ``e``: each line as LOGGED_EVENTS, with ``bad`` where it is none."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = (spark.readStream if streaming else spark.read).text(path).withColumnRenamed("value", "line").filter("trim(line) <> ''")
    return lines.withColumn("e", F.from_json("line", f"{LOGGED_EVENTS}, bad string", {"columnNameOfCorruptRecord": "bad"}))


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Events logged as one JSON object a line, whoever wrote them; lines that can't be read, or
    with a field that isn't of its type, stay out (``event_rejects``)."""
    d = _logged(spark, path, streaming).filter("e IS NOT NULL AND e.bad IS NULL")
    d = d.select(*[f"e.{n}" for n in StructType.fromDDL(LOGGED_EVENTS).names])
    return d.withColumn("data", judged_data(F.col("data")))


def event_rejects(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The lines that ``read_events`` leaves out."""
    return _logged(spark, path, streaming).filter("e IS NULL OR e.bad IS NOT NULL").select("line")


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


Sink = Callable[[DataFrame, int], None]


def fan_out(df: DataFrame, sinks: Sequence[Sink], batch: int = 0) -> None:
    """Every sink gets all rows and the batch's number; a failing one doesn't stop the rest, and
    the first error is raised."""
    d = df.persist()
    first = None
    try:
        for sink in sinks:
            try:
                sink(d, batch)
            except Exception as e:  # noqa: BLE001  raised below
                first = first or e
    finally:
        d.unpersist()
    if first is not None:
        raise first


def writer_of(d: DataFrame) -> str:
    """The identity of the stream whose batch runs here: it stays with the checkpoint over
    restarts and differs for any other one. ``batch`` outside of streams."""
    return d.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def table_sink(root: str, made_from: Callable[[DataFrame], DataFrame] = lambda d: d) -> Sink:
    """A folder per stream and batch, replaced when the stream repeats the batch. ``made_from``
    gives the rows of this target, such as the pairs of netflow rows."""

    def write(d: DataFrame, batch: int) -> None:
        made_from(d).write.mode("overwrite").parquet(f"{root}/writer={writer_of(d)}/batch={batch}")

    return write


def metric_sink(root: str) -> Sink:
    """Metric rows by metric, day, stream and batch: what a stream repeats replaces what it wrote
    before, and nothing of another stream."""

    def write(d: DataFrame, batch: int) -> None:
        spread = F.pmod(F.xxhash64("host"), F.lit(64))
        d = d.withColumns({"writer": F.lit(writer_of(d)), "batch": F.lit(batch)})
        d = d.repartition("metric", "day", spread).sortWithinPartitions("metric", "day", "dt", "host", "key")
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "day", "writer", "batch").parquet(root)

    return write


def compact_day(spark: SparkSession, root: str, metric: str, day: str, files: int = 4) -> int:
    """Rewrite one finished day of a metric, whoever wrote it, into at most ``files`` sorted files;
    the number of its rows. The rows lie aside, with the names of what they replace, before
    anything goes: a call after a lost job first ends what that one began. Rows that come later
    have folders of their own and stay."""
    fs, folder = _folder(spark, f"{root}/metric={metric}/day={day}")
    aside = f"{root}/.merging-{metric}-{day}"

    def swap() -> None:
        for r in spark.read.text(f"{aside}/_old").collect():
            fs.delete(_folder(spark, r["value"])[1], True)
        fs.rename(_folder(spark, aside)[1], _folder(spark, f"{folder}/writer=merged")[1])

    if fs.exists(_folder(spark, f"{aside}/_old/_SUCCESS")[1]):
        swap()
    if not fs.exists(folder):
        return 0
    old = [(s.getPath().toString(),) for s in fs.listStatus(folder)]
    d = spark.read.option("recursiveFileLookup", "true").parquet(folder.toString())
    if any(not p.endswith("/writer=merged") for (p,) in old):
        fs.delete(_folder(spark, aside)[1], True)
        d.repartitionByRange(files, "dt", "host").sortWithinPartitions("dt", "host", "key").write.parquet(f"{aside}/batch=0")
        spark.createDataFrame(old, "value string").coalesce(1).write.text(f"{aside}/_old")
        swap()
    return spark.read.option("recursiveFileLookup", "true").parquet(folder.toString()).count()


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_expired(spark: SparkSession, root: str, as_of: Column, months: int = KEEP_MONTHS) -> list[tuple[str, str]]:
    """Delete the day folders all of whose rows are past the retention; (metric, day) of each.
    Only folder names are read."""
    fs, folder = _folder(spark, root)
    limit = spark.range(1).select(F.to_date(as_of.cast("timestamp") - F.make_interval(months=F.lit(months)))).first()[0]
    gone = []
    for m in [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("metric=")]:
        for p in [s.getPath() for s in fs.listStatus(m) if s.getPath().getName().startswith("day=")]:
            day = p.getName().split("=", 1)[1]
            if day < str(limit) and fs.delete(p, True):
                gone.append((m.getName().split("=", 1)[1], day))
    return sorted(gone)


def drop_expired_partitions(spark: SparkSession, table: str, as_of: Column, months: int = KEEP_MONTHS) -> list[str]:
    """The same for a catalog table partitioned by day: its expired partitions are dropped."""
    limit = spark.range(1).select(F.to_date(as_of.cast("timestamp") - F.make_interval(months=F.lit(months)))).first()[0]
    days = sorted(r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    gone = [d for d in days if d < str(limit)]
    for d in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = DATE '{d}')")
    return gone


def create_metric_tables(spark: SparkSession, database: str, names: Sequence[str] = BUILTIN_METRICS) -> list[str]:
    """A table with the METRIC_ROWS columns for each name, partitioned by day."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(METRIC_ROWS) if f.name != "metric")
    made = []
    for name in [database, *names]:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"not a table name: {name!r}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY (day)")
        made.append(f"{database}.{name}")
    return made
