"""The registered queries: operators over the fixtures' views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses
from ..functions.values import device_path, is_base_disk, kind_is_percent
from ..operators import audit, counters, flows, points, ranks, store, window
from ..scratch import fresh_path
from ..sources import frames, hosts, json_points, procfs, prometheus
from ..streaming import streams
from . import fixtures as fx
from .spec import MetricSpec

DAY = 6 * 3600
PCTS = (50, 90, 99)
#: When one host falls silent in ``stream_silent_worker``: 2024-01-15.
_HALF_TIME = 1705276800


def _series(spark, d, percentiles=PCTS, send="6 hours"):
    return window.series(fx.samples(spark, d), send, percentiles, ["host"])


def _dts(df: DataFrame) -> DataFrame:
    return df.withColumn("dts", F.unix_seconds("send_at"))


def window_last_pct(spark: SparkSession, d: str) -> DataFrame:
    s = window.stored(_series(spark, d), PCTS)
    return _dts(s).select("host", "key", "var", "dts", "last", "p50", "p90", "p99")


def window_large_series(spark, d):
    """One series that holds the values of all events of 60 days, by exact ranks."""
    p = fx.samples(spark, d).withColumns({"host": F.lit("h"), "key": F.lit("all")})
    s = window.stored(ranks.large_series(p, "60 days", PCTS, ["host"], 64), PCTS)
    return _dts(s).select("host", "key", "var", "dts", "n", "last", "p50", "p90", "p99")


def window_last_only(spark, d):
    s = window.stored(_series(spark, d, ()), ())
    return _dts(s).select("host", "key", "var", "dts", "last")


def window_zero_fill(spark, d):
    s = window.zero_filled(_series(spark, d, (50,), "1 hour"), "1 hour", (50,), ["host"])
    return _dts(window.stored(s, (50,))).select("host", "key", "var", "dts", "n", "last", "p50")


def window_dt(spark, d):
    s = window.with_window_time(_series(spark, d, ()), ["host"], 5000)
    return s.groupBy("host", "dts").agg(F.min("dt").alias("dt"), F.max("dt").alias("dt_max"))


def _events(spark, d, pts=None, **spec):
    p = fx.samples(spark, d) if pts is None else pts
    return window.window_events(p, MetricSpec("app", 5, DAY, PCTS, **spec), ["host"])


def _rows(spark, d, **spec):
    return store.stamp(store.flatten_events(_events(spark, d, **spec)), F.timestamp_seconds(F.lit(0)))


def flatten_rows(spark, d):
    r = _rows(spark, d)
    return r.select("host", "key", "var", "agg", "value", F.unix_millis("dt").alias("dt"), F.unix_seconds("dts").alias("dts"))


def filter_drop_vars(spark, d):
    p = points.select_vars(points.normalised_names(fx.samples(spark, d)), ["*al*e", "k*"], ["k_*"])
    return p.groupBy("host", "var").agg(F.count(F.lit(1)).alias("n"))


def _dropped(spark, d, *rules):
    # Half of the hosts name their percentage otherwise, so that rules on names have both cases.
    own = F.expr("var = 'value' OR host IN ('h0', 'h2', 'h4', 'h6')")
    p = fx.samples(spark, d).withColumn("var", F.when(own, F.col("var")).otherwise("other"))
    e = _events(spark, d, p, drop_event=rules)
    return e.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))


def drop_event_key(spark, d):
    return _dropped(spark, d, "key!=*i*", "metric=other")


def drop_event_var(spark, d):
    return _dropped(spark, d, "var=k_*")


def drop_event_numeric(spark, d):
    return _dropped(spark, d, "value>60", "k_util<20")


def process_threshold(spark, d):
    s = window.process_threshold(_series(spark, d, ()), ["host"], {"value": 150.0, "k_util": 95.0})
    return _dts(s).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.min("dts").alias("first"))


def json_point_rows(spark, d):
    return json_points.points_from_json(fx.json_payloads(spark, d), "payload")


def json_rejects(spark, d):
    return json_points.json_rejects(fx.json_payloads(spark, d), "payload").select("event_id")


def prom_points(spark, d):
    return prometheus.points_from_prometheus(fx.prometheus_payloads(spark, d), "payload", ["host", "d"])


def prom_short(spark, d):
    return prometheus.points_from_prometheus(fx.prometheus_payloads(spark, d), "payload", ["host", "d"], "short").select("host", "d", "var", "raw")


def prom_type_asof(spark, d):
    s = prometheus.samples(fx.prometheus_payloads(spark, d), "payload", ["host", "d"])
    return s.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))


def _counted(spark, d, names, **named):
    """Snapshots with every counter taken from bytes or cnt."""
    s = fx.snapshots(spark, d)
    cols = {c: F.col("bytes" if k % 2 else "cnt") for k, c in enumerate(names)}
    return s.select("host", "ts", "entity", *[v.alias(k) for k, v in (cols | named).items()])


def _flat(p: DataFrame) -> DataFrame:
    return p.select("host", F.unix_seconds("ts").alias("at_s"), "key", "var", F.round("raw", 6).alias("raw"), "is_percent")


def _disks(s: DataFrame) -> DataFrame:
    """Disk counters that all differ. Every sixth day a host has partitions alone."""
    own = F.concat(F.lit("sd"), F.substring("entity", 1, 1))
    cols = {c: (F.col("bytes" if k % 2 else "cnt") * (k + 1)).alias(c) for k, c in enumerate(counters.DISK)}
    device = F.when(F.col("d") % 6 == 0, F.concat(own, F.lit("1"))).otherwise(own)
    return s.select("host", "ts", device.alias("device"), F.lit(1).alias("inflight"), *cols.values())


def disk_rates(spark, d):
    return _flat(counters.disk_points(_disks(fx.snapshots(spark, d))))


def _streamed(spark, snapshots: DataFrame, made) -> DataFrame:
    """The points of a stream of the snapshots."""
    path = fresh_path(spark, "snapshots")
    snapshots.write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    with streams.state_in_rocksdb(spark):
        return _flat(streams.run_to_end(made(stream)))


def stream_disk_rates(spark, d):
    """The same metric from a stream of the snapshots."""
    return _streamed(spark, _disks(fx.snapshots(spark, d)), streams.disk_points)


def net_rates(spark, d):
    return _flat(counters.net_iface_points(_ifaces(spark, d)))


def _ifaces(spark, d):
    return _counted(spark, d, counters.NET, iface=F.col("entity"))


def stream_net_rates(spark, d):
    return _streamed(spark, _ifaces(spark, d), streams.net_iface_points)


def _per_scrape(spark, d, names, **named):
    """One row for each host and scrape, from the greatest counters of its entities."""
    s = fx.snapshots(spark, d).groupBy("host", "ts", "d").agg(F.max("bytes").alias("bytes"), F.max("cnt").alias("cnt"))
    cols = {c: F.col("bytes" if k % 2 else "cnt") for k, c in enumerate(names)}
    return s.select("host", "ts", "d", *[v.alias(k) for k, v in (cols | named).items()])


def net_stack(spark, d):
    return _flat(counters.net_stack_points(_per_scrape(spark, d, counters.STACK)))


def stream_net_stack(spark, d):
    return _streamed(spark, _per_scrape(spark, d, counters.STACK), streams.net_stack_points)


def _kernels(spark, d):
    gauges = {"load1": F.lit(0.5), "load5": F.lit(1.0), "load15": F.lit(2.0), "procs_running": F.lit(3), "procs_blocked": F.lit(0)}
    return _per_scrape(spark, d, counters.KERNEL, **gauges)


def kernel_rates(spark, d):
    return _flat(counters.kernel_points(_kernels(spark, d)))


def stream_kernel_rates(spark, d):
    return _streamed(spark, _kernels(spark, d), streams.kernel_points)


def _processes(spark, d):
    return _counted(spark, d, counters.PROCESS, pid=F.ascii("entity"), name=F.substring("entity", 1, 1), cpu_util=F.lit(5.0), rss=F.lit(25), ram_total=F.lit(200))


def process_iops(spark, d):
    return _flat(counters.process_points(_processes(spark, d)))


def stream_process_iops(spark, d):
    return _streamed(spark, _processes(spark, d), streams.process_points)


#: Device names that stand for the five event types.
_DEVICES = ("sda", "sda1", "nvme0n1", "loop0", "dm-0")


def base_disks(spark, d):
    s = fx.snapshots(spark, d)
    name = F.get(F.array(*[F.lit(x) for x in _DEVICES]), F.length("entity") % 5)
    s = s.withColumn("device", name).filter(is_base_disk(F.col("device")))
    return s.groupBy(device_path(F.col("device")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def cpu_points(spark, d):
    s = fx.snapshots(spark, d)
    core = F.when(F.col("entity") != "view", F.length("entity"))
    return _flat(hosts.cpu_points(s.select("host", "ts", core.alias("core"), (F.col("cnt") % 101).alias("util"))))


def ram_swap_points(spark, d):
    s = _per_scrape(spark, d, (), bytes=F.col("bytes"), cnt=F.col("cnt"))
    used, total = F.col("cnt"), F.when(F.col("d") % 4 == 0, F.lit(0)).otherwise(F.col("bytes"))
    ram = hosts.ram_points(s.select("host", "ts", total.alias("total"), used.alias("used"), (total - used).alias("available")))
    swap = hosts.swap_points(s.select("host", "ts", total.alias("total"), used.alias("used")))
    return _flat(ram).withColumn("of", F.lit("ram")).unionByName(_flat(swap).withColumn("of", F.lit("swap")))


def fs_points(spark, d):
    s = fx.snapshots(spark, d)
    mount = F.when(F.col("d") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" /"), "entity"))
    opts = F.when(F.col("cnt") % 2 == 0, F.array(F.lit("rw"), F.lit("noatime"))).otherwise(F.array(F.lit(" RO ")))
    share = F.when(F.col("d") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("cnt") % 100)
    cols = {"mountpoint": mount, "opts": opts, "total": F.col("bytes"), "used": F.col("cnt"), "free": F.col("bytes") - F.col("cnt"), "util": F.col("cnt") % 100,
            "inodes_total": F.lit(10), "inodes_used": F.lit(4), "inodes_free": F.lit(6), "inodes_util": share}
    return _flat(hosts.fs_points(s.select("host", "ts", *[v.alias(k) for k, v in cols.items()])))


def proc_sections(spark, d):
    return procfs.proc_sections(fx.proc_texts(spark, d), "snmp", ["host", "entity", "d"])


def kernel_capture(spark, d):
    t = fx.proc_texts(spark, d)
    return procfs.kernel_snapshots(t, "stat", "loadavg").select("host", "entity", "d", "ctxt", "intr", "softirq", "forks", "procs_running", "procs_blocked", "load1", "load15")


def kernel_rejects(spark, d):
    """Captures that lack a number the kernel metric needs."""
    return procfs.kernel_rejects(fx.proc_texts(spark, d), "stat", "loadavg").select("host", "entity", "d")


def prometheus_rejects(spark, d):
    """Texts without a usable sample: every seventh day has comments and broken lines alone."""
    empty = F.lit("# HELP x y\n# TYPE x counter\nx not_a_number\n{} 3\n")
    t = fx.prometheus_payloads(spark, d).withColumn("payload", F.when(F.col("d") % 7 == 0, empty).otherwise(F.col("payload")))
    return prometheus.prometheus_rejects(t, "payload", ["host", "d"]).select("host", "d")


def tcp_cc(spark, d):
    t = fx.proc_texts(spark, d)
    one = procfs.tcp_socket_samples(t, "tcp", ["host", "ts"])
    both = one.unionByName(procfs.tcp_socket_samples(t, "tcp", ["host", "ts"]))
    scrapes = t.select("host", "ts", F.when(F.dayofmonth("ts") % 2 == 0, "cubic").otherwise(" ").alias("algo")).distinct()
    return _flat(procfs.tcp_cc_points(both, scrapes, 5))


def _top(spark, d):
    return flows.top_flows(flows.flows(flows.on_interfaces(fx.packets(spark, d), ["eth*"]), "300 seconds"))


def flows_topn(spark, d):
    t = _top(spark, d)
    src, dst = (flows.address_text(F.col(f"{x}_addr"), F.col(f"{x}_v4")) for x in ("src", "dst"))
    key = flows.flow_key(F.col("iface"), F.col("proto"), src, F.col("src_port"), dst, F.col("dst_port"))
    return t.select("host", F.unix_seconds("w.start").alias("at_s"), key.alias("key"), "bytes", "packets", F.col("flows").alias("n_flows"), "place")


def packets_from_frames(spark, d):
    p = frames.packets_from_frames(fx.frames(spark, d))
    return p.select("host", "seq", "proto", F.lower(F.hex("src_addr")).alias("src"), F.lower(F.hex("dst_addr")).alias("dst"), "src_port", "dst_port", "bytes", "tcp_start")


def _pairs(spark, d):
    return flows.netflow_job(fx.packets(spark, d), MetricSpec("netflow", 300, 3600, ()), ["eth*"])


def netflow_pairs(spark, d):
    p = _pairs(spark, d)
    return p.select("host", F.unix_seconds("dts").alias("dts"), "iface", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "bytes", "packets", F.col("flows").alias("n_flows"))


def pair_lookup(spark, d):
    p = audit.pair_lookup(_pairs(spark, d), host="h1", proto="tcp", src_port=40001, dst_port=443, iface="eth0", src_ip="::ffff:10.0.0.1", dst_ip="::ffff:10.0.1.1")
    return p.select("host", F.unix_seconds("dts").alias("dts"), "src_ip", "bytes", "packets")


def pair_search(spark, d):
    return audit.pair_search(_pairs(spark, d), 40001, "udp")


def latest_value(spark, d):
    r = audit.latest_value(_rows(spark, d).filter("host = 'h1'"), "click", "value", "p90")
    return r.select("host", "key", "var", "agg", "value", F.unix_seconds("dts").alias("dts"))


def latest_values(spark, d):
    r = audit.latest_values(_rows(spark, d), "host", "key", "var", "agg")
    return r.select("host", "key", "var", "agg", "value", F.unix_seconds("dts").alias("dts"))


def recent_rows(spark, d):
    r = audit.with_vars(_rows(spark, d), ["value"]).filter("agg = 'last'")
    return audit.recent(r, 50, "host", "key", "var").select("host", "key", "value", F.unix_millis("dt").alias("dt"))


def _orders(spark, d):
    """Numbered keys, with a few sent twice, late or without an address."""
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("k"))
    twice = o.filter("k % 10 = 0")
    o = o.unionByName(twice).withColumn("dts", F.timestamp_seconds(F.col("k")))
    dt = F.timestamp_seconds(F.when(F.col("k") % 50 == 0, F.col("k")).otherwise(F.col("k") - 1))
    return o.select(
        F.when(F.col("k") % 7 == 0, "stopped").otherwise(F.col("key")).alias("key"), F.lit("value").alias("var"), F.when(F.col("k") % 11 == 0, "p50").otherwise("last").alias("agg"),
        dt.alias("dt"), "dts", F.when(F.col("k") % 13 == 0, "::").otherwise("::ffff:10.0.0.1").alias("host_ip"),
        F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("metric"), F.to_date("dts").alias("day"),
    )


def delivery_audit(spark, d):
    return audit.delivery_audit(_orders(spark, d), fx.read(spark, d, "orders").count())


def dt_audit(spark, d):
    return audit.dt_audit(_orders(spark, d))


def non_last_audit(spark, d):
    return audit.non_last_audit(_orders(spark, d))


def host_ip_audit(spark, d):
    return audit.host_ip_audit(_orders(spark, d))


def throughput(spark, d):
    return audit.throughput(_rows(spark, d).withColumn("metric", F.col("var")), 45)


def retention_keep(spark, d):
    o = fx.read(spark, d, "orders").withColumn("dt", F.col("o_orderdate").cast("timestamp"))
    return store.apply_retention(o, F.lit("1997-06-30 12:00:00").cast("timestamp")).select(F.col("o_orderkey").alias("k"))


def route_roundtrip(spark, d):
    root = fresh_path(spark, "rows")
    store.write_metric_rows(_rows(spark, d).withColumn("metric", F.col("key")), root)
    r = store.read_metric(spark, root, "click", "2024-01-03", "2024-01-20")
    return r.groupBy("metric", "host", "agg").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _stored_rows(spark, d) -> str:
    root = fresh_path(spark, "rows")
    store.write_metric_rows(_rows(spark, d).withColumn("metric", F.lit("app")), root)
    return root


def stored_recent(spark, d):
    """The newest 50 stored rows of a kind, from the newest days alone."""
    r = store.recent_rows(spark, _stored_rows(spark, d), "app", 50, "host", "key", condition=F.expr("var = 'value' AND agg = 'last'"))
    return r.select("host", "key", "value", F.unix_millis("dt").alias("dt"))


def stored_latest(spark, d):
    """The latest stored value of one series, from the newest days alone."""
    own = F.expr("host = 'h1' AND key = 'click' AND var = 'value' AND agg = 'p90'")
    r = store.latest_row(spark, _stored_rows(spark, d), "app", own, DAY)
    return r.select("host", "key", "var", "agg", "value", F.unix_seconds("dts").alias("dts"))


def fan_out_parity(spark, d):
    roots = {"one": fresh_path(spark, "target"), "two": fresh_path(spark, "target")}
    store.fan_out(_rows(spark, d), [store.table_sink(r) for r in roots.values()])
    return audit.target_parity({k: spark.read.parquet(r) for k, r in roots.items()})


def event_log(spark, d):
    """Events written as JSON lines and read again."""
    path = fresh_path(spark, "events")
    store.write_json_lines(_events(spark, d), path)
    return _long(store.flatten_events(store.read_events(spark, path)))


def foreign_events(spark, d):
    """Rows of a log that the library didn't write, and how many of its lines can't be read."""
    path = fresh_path(spark, "log")
    fx.foreign_events(spark, d).write.text(path)
    rows = store.flatten_events(store.read_events(spark, path)).select("key", "var", "agg", "value", "dt", "dts")
    bad = store.event_rejects(spark, path).agg(F.count(F.lit(1)).alias("value"))
    none = F.lit(0).cast("bigint")
    return rows.unionByName(bad.select(F.lit("rejects").alias("key"), F.lit("").alias("var"), F.lit("").alias("agg"), "value", none.alias("dt"), none.alias("dts")))


def retention_removed(spark, d):
    """Orders as metric rows by day, removed past the retention: what is left in the folders."""
    root = fresh_path(spark, "orders")
    o = fx.read(spark, d, "orders")
    day = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date")
    o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").substr(1, 1).alias("metric"), day.alias("day")).repartition("metric", "day").write.partitionBy("metric", "day").parquet(root)
    store.remove_expired(spark, root, F.lit("1997-06-30 12:00:00").cast("timestamp"))
    return spark.read.schema("k long, metric string, day date").parquet(root).groupBy("metric", "day").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("most"))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("host", "key", "var", "agg", "value", "dt", "dts")


def overflow_rejects(spark, d):
    """Values scaled beyond 64 bits leave the rows and show among the rejects."""
    p = fx.samples(spark, d).withColumn("raw", F.when((F.col("var") == "value") & (F.col("key") == "click"), F.col("raw") * 1e19).otherwise(F.col("raw")))
    e = _events(spark, d, p)
    kept = store.flatten_events(e).groupBy("key", "var", "agg").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("rows"))
    return kept.unionByName(store.overflow_rejects(e).groupBy("key", "var", "agg").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("rejects")))


def custom_source(spark, d):
    """A user's source with tags: constant ones, and those of the host table."""

    def source(session):
        p = fx.samples(session, d).withColumns({"metric": F.lit("app"), "instance": F.lit("1")})
        hosts_ = p.select("host").distinct().withColumns({"dc": F.lit("dc1"), "project": F.concat(F.lit("p"), F.substring("host", 2, 1)), "role": F.lit("web")})
        return points.with_tags(points.with_tags(p, dc="x", project="y", role="z"), hosts_)

    p = points.from_source(spark, source)
    return p.groupBy("dc", "project", "role", "host", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("raw").alias("most"))


def two_definitions(spark, d):
    """One metric defined twice, with other windows and percentiles each."""
    specs = {"six hours": MetricSpec.of("app", send=DAY, percentiles=[90, 50], defaults=[99]), "a day": MetricSpec.of("app", send=4 * DAY, percentiles=[])}
    r = store.flatten_events(window.definition_events(fx.samples(spark, d), specs, ["host"]))
    return r.select(F.col("instance").alias("of"), "host", "key", "var", "agg", "value", "dts")


def ten_definitions(spark, d):
    """Ten definitions of a metric in one scan: windows of 6 to 24 hours, with and without
    percentiles, masks, thresholds, rules and zeros."""
    specs = {}
    for k, hours in enumerate((6, 8, 12, 24)):
        specs[f"p{k}"] = MetricSpec("app", 5, hours * 3600, (50, 90) if k % 2 else (99,), drop=("k_*",) if k == 3 else ())
        specs[f"l{k}"] = MetricSpec("app", hours * 3600, hours * 3600, (), keep=("value",) if k == 2 else ())
    specs["t"] = MetricSpec("app", 5, DAY, (50,), thresholds={"value": 100.0}, drop_event=("key=error",))
    specs["z"] = MetricSpec("app", 5, DAY, (50,), zero_fill=True)
    r = store.flatten_events(window.definition_events(fx.samples(spark, d), specs, ["host"]))
    return r.select("instance", "host", "key", "var", "agg", "value", "dt", "dts")


def emit_filter(spark, d):
    """Keys of which some series had enough samples."""
    emit = lambda key, cells: (key != "error") & F.exists(cells, lambda c: c["n"] >= 5)
    return _events(spark, d, emit=emit).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.min("dts").alias("first"))


def resampled(spark, d):
    p = points.resample(fx.samples(spark, d), "1 day", "host")
    return p.select("host", "key", "var", "raw", F.unix_micros("ts").alias("us"), "seq")


def first_error(spark, d):
    """A target that fails in between: the others have all rows, and its error is the one raised."""
    roots = [fresh_path(spark, "target"), fresh_path(spark, "target")]

    def broken(rows, batch):
        raise OSError("out of reach")

    said = "none"
    try:
        store.fan_out(_rows(spark, d), [store.table_sink(roots[0]), broken, store.table_sink(roots[1])])
    except OSError as e:
        said = str(e)
    both = [spark.read.parquet(r).groupBy("host").agg(F.count(F.lit(1)).alias("n")) for r in roots]
    return both[0].unionByName(both[1]).withColumn("error", F.lit(said))


def metric_tables(spark, d):
    """Tables by metric, filled with the rows whose key is their name; dropped when counted."""
    name = "m" + fresh_path(spark, "x")[-32:]
    keys = ("click", "error", "purchase", "signup", "view")
    r = _rows(spark, d)
    counted = None
    for table, key in zip(store.create_metric_tables(spark, name, keys), keys, strict=True):
        own = r.filter(F.col("key") == key)
        own.select(*spark.table(table).columns).write.mode("append").insertInto(table)
        n = spark.table(table).groupBy("host", "agg").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("metric", F.lit(key))
        counted = n if counted is None else counted.unionByName(n)
    path = fresh_path(spark, "counted")
    counted.write.parquet(path)
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.read.parquet(path)


def kinds(spark, d):
    """Kinds as texts: event types stand for five of them."""
    e = fx.read(spark, d, "events")
    told = {"click": " PCT ", "view": "number", "purchase": "uint8_percent", "signup": "%", "error": "odd"}
    kind = F.lit("num")
    for k, v in told.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return e.groupBy("event_type", kind_is_percent(kind).alias("is_percent")).agg(F.count(F.lit(1)).alias("n"))


def ipv6_pairs(spark, d):
    """Different texts of one IPv6 address become one."""
    li = fx.read(spark, d, "lineitem")
    k = F.col("l_suppkey") % 5
    text = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("2001:DB8::"), k.cast("string"))).otherwise(F.concat(F.lit("2001:0db8:0:0:0:0:0:"), k.cast("string")))
    rows = li.select(text.alias("ip"), F.col("l_quantity").cast("long").alias("n"))
    rows = rows.groupBy("ip").agg(F.sum("n").alias("n"))
    return addresses.with_ipv6(rows, "ip").groupBy("ip").agg(F.sum("n").alias("n"))


def _sample_stream(spark, d):
    e = streams.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return fx.as_samples(e)


def stream_window(spark, d):
    return streams.run_to_end(streams.window_series(_sample_stream(spark, d), "1 day", (50, 90), ["host"], "0 seconds"))


def stream_zero_fill(spark, d):
    with streams.state_in_rocksdb(spark):
        return streams.run_to_end(streams.known_series(_sample_stream(spark, d), DAY, "0 seconds"))


def stream_silent_worker(spark, d):
    """One host's samples come from another after half of the time: its series go on with zeros up
    to the watermark, and end when they have had no sample for five days."""
    e = _sample_stream(spark, d)
    moved = (F.col("host") == "h3") & (F.col("ts") >= F.timestamp_seconds(F.lit(_HALF_TIME)))
    p = e.withColumn("host", F.when(moved, "h4").otherwise(F.col("host")))
    with streams.state_in_rocksdb(spark):
        return streams.run_to_end(streams.known_series(p, DAY, "0 seconds", 5 * 86400))


def stream_udp_flows(spark, d):
    rows = fx.packets_of(streams.table_stream(spark, d, "lineitem"))
    r = streams.run_to_end(streams.udp_flows(rows, 10, "0 seconds"))
    return r.select("host", "iface", "src_port", "packets", "bytes", F.unix_seconds("start").alias("start"), F.hex("src_addr").alias("src"), F.hex("dst_addr").alias("dst"))


def stream_events(spark, d):
    """The whole window job over a stream: masks, thresholds, drop rules, percentiles, rows."""
    spec = MetricSpec("app", 5, DAY, PCTS, drop=("k_x*",), thresholds={"value": 100.0}, drop_event=("key=error",))
    return _long(store.flatten_events(streams.run_to_end(streams.window_events(_sample_stream(spark, d), spec, ["host"], "0 seconds"))))


def stream_known_events(spark, d):
    """The whole job with zeros for known series, by percentiles; dt of empty windows is told by the scrape."""
    spec = MetricSpec("app", 5, DAY, (50,), zero_fill=True, drop_event=("k_util>90",))
    with streams.state_in_rocksdb(spark):
        return _long(store.flatten_events(streams.run_to_end(streams.window_events(_sample_stream(spark, d), spec, ["host"], "0 seconds"))))


def stream_push(spark, d):
    """JSON payloads pushed as a stream; what a window without samples lacks in time is the send interval."""
    e = streams.table_stream(spark, d, "events")
    p = fx.json_payloads_of(e).withColumns({"ts": F.col("ts").cast("timestamp"), "host": F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")), "seq": F.col("event_id")})
    p = json_points.points_from_json(p, "payload")
    spec = MetricSpec("app", DAY, DAY, (), push=True, zero_fill=True, keep=("util",))
    with streams.state_in_rocksdb(spark):
        return _long(store.flatten_events(streams.run_to_end(streams.window_events(p, spec, ["host"], "0 seconds"))))


def stream_fan_out(spark, d):
    """Micro-batches to metric tables and to a plain target."""
    one, two = fresh_path(spark, "target"), fresh_path(spark, "target")
    events = streams.window_events(_sample_stream(spark, d), MetricSpec("app", 5, DAY, (50,)), ["host"], "0 seconds")
    rows = store.stamp(store.flatten_events(events), F.timestamp_seconds(F.lit(0))).withColumn("metric", F.col("key"))
    streams.to_sinks(rows, [store.metric_sink(one), store.table_sink(two)], fresh_path(spark, "state"))
    return audit.target_parity({"one": store.read_metric(spark, one), "two": spark.read.parquet(two)})


def stream_pairs(spark, d):
    """Netflow rows streamed to a pairs table: each batch appends the pairs of its rows."""
    t = flows.flow_points(_top(spark, d))
    path, root = fresh_path(spark, "points"), fresh_path(spark, "pairs")
    t.write.parquet(path)
    p = spark.readStream.schema(t.schema).parquet(path)
    events = streams.window_events(p, MetricSpec("netflow", 300, 3600, ()), ["host"], "0 seconds")
    rows = store.stamp(store.flatten_events(events), F.timestamp_seconds(F.lit(0)))
    streams.to_sinks(rows, [store.table_sink(root, flows.netflow_pairs)], fresh_path(spark, "state"))
    return _pair_rows(spark.read.parquet(root))


def _pair_rows(r: DataFrame) -> DataFrame:
    return r.select("host", F.unix_seconds("dts").alias("dts"), "iface", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "bytes", "packets", F.col("flows").alias("n_flows"))


def stream_netflow(spark, d):
    """The whole netflow job over a stream of packets: starts, totals, the largest, pairs."""
    tops, root = fresh_path(spark, "tops"), fresh_path(spark, "pairs")
    spec = MetricSpec("netflow", 300, 3600, ())
    packets = fx.packets_of(streams.table_stream(spark, d, "lineitem"))
    streams.netflow_tops(packets, spec, tops, fresh_path(spark, "state"), "0 seconds", ["eth*"])
    found = spark.readStream.schema(spark.read.parquet(tops).schema).parquet(tops)
    streams.netflow_pairs(found, spec, root, fresh_path(spark, "state"), "0 seconds")
    return _pair_rows(spark.read.parquet(root))


def queries() -> dict:
    named = [
        window_last_pct, window_large_series, window_last_only, window_zero_fill, window_dt, flatten_rows, filter_drop_vars, drop_event_key, drop_event_var,
        drop_event_numeric, process_threshold, json_rejects, prom_points, prom_short, prom_type_asof, disk_rates, net_rates, net_stack,
        kernel_rates, process_iops, base_disks, cpu_points, ram_swap_points, fs_points, proc_sections, kernel_capture, kernel_rejects, prometheus_rejects, tcp_cc, flows_topn,
        packets_from_frames, netflow_pairs, pair_lookup, pair_search, latest_value, latest_values, recent_rows, delivery_audit, dt_audit,
        non_last_audit, host_ip_audit, throughput, retention_keep, route_roundtrip, fan_out_parity, stream_window, stream_zero_fill, stream_udp_flows,
        event_log, foreign_events, retention_removed, overflow_rejects, custom_source, two_definitions, ten_definitions, stored_recent, stored_latest, emit_filter, resampled, first_error, metric_tables, kinds, ipv6_pairs,
        stream_disk_rates, stream_events, stream_known_events, stream_push, stream_fan_out, stream_pairs, stream_netflow,
        stream_net_rates, stream_net_stack, stream_kernel_rates, stream_process_iops, stream_silent_worker,
    ]
    return {f.__name__: f for f in named} | {"json_points": json_point_rows}
