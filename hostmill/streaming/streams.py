"""The window job, counters and UDP sessions as Structured Streaming, and sinks for streams."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.values import is_base_disk
from ..operators import counters, flows, store
from ..operators.window import assembled, chosen_points, series_aggregates, series_cell, stored, timed
from ..plans.spec import MetricSpec
from ..scratch import fresh_path
from . import known


def closed_windows(points: DataFrame, send: str, percentiles: Sequence[int], by: Sequence[str], delay: str, last_only: bool = False) -> DataFrame:
    """A worker's closed windows: by, w, first_ts and cells, the raw aggregates of its series.

    Two aggregations: by series, then by worker and window, whose first time is that of all its
    series. Windows close when the watermark passes their end.
    """
    d = points.withWatermark("ts", delay).groupBy(*by, "key", "var", F.window("ts", send).alias("w")).agg(*series_aggregates(percentiles, last_only))
    cells = F.struct("key", "var", "is_percent", "n", "last", "raw_max", *[f"p{p}" for p in percentiles])
    return d.groupBy(*by, "w").agg(F.min("first_ts").alias("first_ts"), F.collect_list(cells).alias("cells"))


def window_series(points: DataFrame, send: str, percentiles: Sequence[int], by: Sequence[str], delay: str) -> DataFrame:
    """Closed windows of a stream of points, with the worker's window time."""
    d = closed_windows(points, send, percentiles, by, delay)
    d = d.select(*by, F.col("w.end").alias("send_at"), "first_ts", F.inline("cells"))
    return stored(timed(d, 0), percentiles).drop("send_at", "raw_max", "is_percent")


def with_known_series(windows: DataFrame, send_seconds: int, percentiles: Sequence[int], by: Sequence[str], forget_seconds: int | None = None) -> DataFrame:
    """Closed windows to one row for a window and key, known series going on with zeros up to the
    watermark, or until they lack samples for more than ``forget_seconds``."""
    # The runner that starts the processor takes no shipped files, so the class goes by value.
    cloudpickle.register_pickle_by_value(known)
    names = ["last", "raw_max", *[f"p{p}" for p in percentiles]]
    keys = [windows.schema[c] for c in by]
    cell = ", ".join(f"{c}: double" for c in names)
    out = StructType(keys + StructType.fromDDL(f"send_at timestamp, first_ts timestamp, key string, cells array<struct<var: string, is_percent: boolean, n: bigint, {cell}>>").fields)
    d = windows.select(*by, F.col("w.end").alias("send_at"), "first_ts", "cells")
    forget = None if forget_seconds is None else 1_000_000 * forget_seconds
    return d.groupBy(*by).transformWithStateInPandas(known.KnownSeries(list(by), 1_000_000 * send_seconds, names, forget), out, "Append", "EventTime")


def known_series(points: DataFrame, send_seconds: int, delay: str, forget_seconds: int | None = None) -> DataFrame:
    """Last values of a host's closed windows, known series going on with zeros."""
    d = with_known_series(closed_windows(points, f"{send_seconds} seconds", (), ["host"], delay), send_seconds, (), ["host"], forget_seconds)
    d = d.select("host", "key", F.unix_seconds("send_at").alias("dts"), F.inline("cells")).withColumn("last", F.coalesce("last", F.lit(0.0)))
    return stored(d, ()).select("host", "key", "var", "dts", "n", "last")


def window_events(points: DataFrame, spec: MetricSpec, by: Sequence[str], delay: str) -> DataFrame:
    """The whole window job over a stream: names, masks, aggregates, zeros, thresholds, emit
    filter, stored values, drop rules. The events of a window come when it closes."""
    d = closed_windows(chosen_points(points, spec), f"{spec.send} seconds", spec.percentiles, by, delay, spec.last_only)
    if spec.zero_fill:
        d = with_known_series(d, spec.send, spec.percentiles, by)
        d = d.withColumn("cells", F.transform("cells", lambda c: _stored_cell(c, spec.percentiles)))
    else:
        d = d.select(*by, "w", "first_ts", F.inline("cells"))
        d = stored(d, spec.percentiles).groupBy(*by, "w", "first_ts", "key").agg(F.collect_list(series_cell(spec.percentiles)).alias("cells"))
        d = d.withColumn("send_at", F.col("w.end")).drop("w")
    return assembled(timed(d, spec.fallback_ms), spec)


def _stored_cell(cell, percentiles: Sequence[int]):
    from ..functions.values import normalised
    from ..operators.window import LEAST_SAMPLES

    def value(name: str):
        return normalised(F.coalesce(cell[name], F.lit(0.0)), cell["is_percent"])  # state turns NaN into null

    pairs = [F.lit("last"), value("last")]
    for p in percentiles:
        pairs += [F.lit(f"p{p}"), F.when(cell["n"] < LEAST_SAMPLES, F.lit(0).cast("bigint")).otherwise(value(f"p{p}"))]
    return F.struct(cell["var"].alias("var"), cell["n"].alias("n"), cell["raw_max"].alias("raw_max"), F.create_map(*pairs).alias("aggs"))


def with_previous(snapshots: DataFrame, names: Sequence[str], entity: Sequence[str], counted: Column | None = None) -> DataFrame:
    """Counters of a stream of scrapes (host and ts) with those of the host's scrape before, as
    ``counters.with_previous`` has them for a table: has_prev, prev_<counter> and seconds. Rows of
    a scrape older than the newest seen have ``late``: they can't be matched any more, and whoever
    reads the stream decides where they go. Rows that aren't ``counted`` make a scrape, but are no
    previous row of any other."""
    cloudpickle.register_pickle_by_value(known)
    name = F.to_json(F.struct(*entity)) if entity else F.lit("")
    d = snapshots.withColumns({"entity_of": name if counted is None else F.when(counted, name), "at_us": F.unix_micros("ts")}).drop("ts")
    more = StructType.fromDDL(", ".join(["seconds double", "has_prev boolean", "late boolean", *[f"prev_{c} double" for c in names]])).fields
    schema = StructType([f for f in d.schema.fields if f.name != "entity_of"] + more)
    match = known.PreviousScrapes(list(names), "entity_of", "at_us", schema.names)

    def run(host, frames, state):
        yield from match(host, frames, state)

    # Times pass as numbers: pandas has them in local time, where an hour comes twice.
    d = d.groupBy("host").applyInPandasWithState(run, schema, match.state, "append", GroupStateTimeout.NoTimeout)
    return d.withColumn("ts", F.timestamp_micros("at_us")).select(*snapshots.columns, *[f.name for f in more])


def _on_time(d: DataFrame) -> DataFrame:
    return d.filter("NOT late").drop("late")


def disk_points(snapshots: DataFrame) -> DataFrame:
    """``counters.disk_points`` over a stream. All devices pass the state, so that a scrape
    without a base disk is still the one before the next."""
    d = with_previous(snapshots, counters.DISK, ["device"]).filter(is_base_disk(F.col("device")))
    return counters.disk_values(_on_time(d))


def net_iface_points(snapshots: DataFrame) -> DataFrame:
    return counters.net_iface_values(_on_time(with_previous(snapshots, counters.NET, ["iface"])))


def net_stack_points(snapshots: DataFrame) -> DataFrame:
    return counters.net_stack_values(_on_time(with_previous(snapshots, list(counters.STACK), [])))


def kernel_points(snapshots: DataFrame) -> DataFrame:
    return counters.kernel_values(_on_time(with_previous(snapshots, counters.KERNEL, [])))


def process_points(snapshots: DataFrame) -> DataFrame:
    """``counters.process_points`` over a stream; processes without a name make a scrape alone."""
    named = F.coalesce("name", F.lit("")) != ""
    d = with_previous(counters.readable_io(snapshots), counters.PROCESS, ["pid"], named)
    return counters.process_values(_on_time(d.filter(named)))


def late_rows(snapshots: DataFrame, names: Sequence[str], entity: Sequence[str]) -> DataFrame:
    """The rows of late scrapes, which the points of the stream leave out."""
    return with_previous(snapshots, names, entity).filter("late").select(*snapshots.columns)


def netflow_tops(packets: DataFrame, spec: MetricSpec, root: str, checkpoint: str, delay: str, masks: Iterable[str] = (), idle: int = flows.IDLE, n: int = flows.TOP) -> None:
    """The largest flows of every closed scrape of a stream of packets, to a table. A scrape closes
    in one micro-batch, in which its flows are ranked."""
    d = flows.flow_totals(flows.on_interfaces(packets, masks).withWatermark("ts", delay), spec.scrape, idle)
    to_sinks(d, [store.table_sink(root, lambda b: flows.top_flows(b, n))], checkpoint)


def netflow_pairs(tops: DataFrame, spec: MetricSpec, root: str, checkpoint: str, delay: str) -> None:
    """Pairs of the closed windows of a stream of such flows. ``delay``: as many seconds as scrapes
    may be read after younger ones, where the table is read while it is written."""
    events = window_events(flows.flow_points(tops), spec, ["host"], delay)
    to_sinks(store.stamp(store.flatten_events(events)), [store.table_sink(root, flows.netflow_pairs)], checkpoint)


def to_sinks(stream: DataFrame, sinks: Sequence[store.Sink], checkpoint: str) -> None:
    """Every micro-batch to every sink, with its number; a stream started again goes on after
    the last whole batch. Runs through what is there."""
    q = stream.writeStream.foreachBatch(lambda d, batch: store.fan_out(d, sinks, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@contextlib.contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors need, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def udp_flows(packets: DataFrame, idle: int, delay: str) -> DataFrame:
    """Closed UDP flows of a stream. A session merges a gap equal to its length, a flow splits
    it, hence the microsecond less."""
    gap = f"{idle * 1_000_000 - 1} microseconds"
    tuple_ = ["host", "iface", "src_addr", "src_port", "dst_addr", "dst_port"]
    d = packets.filter("proto = 17").withWatermark("ts", delay)
    d = d.groupBy(*tuple_, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))
    return d.withColumn("start", F.col("s.start")).drop("s")


def run_to_end(stream: DataFrame) -> DataFrame:
    """All that a bounded stream puts out, as a table written to the shared folder."""
    spark = stream.sparkSession
    base = fresh_path(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table of one file as a stream; the folder around it is the source's path."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
