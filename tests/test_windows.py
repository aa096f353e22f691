import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from hostmill.operators import audit, points, store, window
from hostmill.plans.spec import MetricSpec, resolve_percentiles
from hostmill.streaming import streams

POINT = "host string, key string, var string, raw double, is_percent boolean, ts timestamp, seq bigint"


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc)


def _points(spark, rows):
    return spark.createDataFrame([("h", k, v, float(x), p, at(t), n) for n, (k, v, x, p, t) in enumerate(rows)], POINT)


def _data(spark, rows, **spec):
    made = window.window_events(_points(spark, rows), MetricSpec("m", 1, 60, **spec), ["host"])
    return {(r.key, r.dts): {v: dict(a) for v, a in r.data.items()} for r in made.collect()}


@pytest.mark.parametrize(
    ("raw", "percent", "pcts", "want"),
    [
        ([1, 2, 3], False, (50, 90), {"last": 3, "p50": 0, "p90": 0}),
        ([10, 20, 150, 90], True, (50,), {"last": 90, "p50": 20}),
        ([0, 10, 20, 30], False, (25,), {"last": 30, "p25": 0}),
        ([1, 2, 3, 4], False, (), {"last": 4}),
    ],
)
def test_series_cases(spark, raw, percent, pcts, want):
    rows = [("k", "v", x, percent, n) for n, x in enumerate(raw)]
    assert _data(spark, rows, percentiles=pcts)[("k", 60)]["v"] == want


def test_percentiles_against_a_model(spark):
    rnd = random.Random(3)
    sets = {f"k{n}": [rnd.random() * 100 for _ in range(n)] for n in (4, 5, 25, 50, 77)}
    rows = [(k, "v", x, False, 1) for k, xs in sets.items() for x in xs]
    pcts = (1, 25, 50, 56, 90, 99, 100)
    got = window.series(_points(spark, rows), "60 seconds", pcts, ["host"]).collect()
    for r in got:
        xs = sorted(sets[r.key])
        for p in pcts:
            assert r[f"p{p}"] == xs[min(max(math.ceil(p / 100 * len(xs)), 1), len(xs)) - 1]


def test_zero_fill_and_times(spark):
    rows = [("a", "v", 5, False, 10), ("b", "v", 7, False, 70), ("a", "v", 9, False, 190)]
    got = _data(spark, rows, zero_fill=True)
    assert {k for k in got} == {("a", 60), ("a", 120), ("a", 180), ("a", 240), ("b", 120), ("b", 180), ("b", 240)}
    assert got[("a", 120)]["v"]["last"] == 0
    made = window.window_events(_points(spark, rows), MetricSpec("m", 1, 60, zero_fill=True), ["host"]).collect()
    dt = {(r.key, r.dts): r.dt for r in made}
    assert dt[("a", 60)] == 10_000
    assert dt[("a", 120)] == 70_000  # the worker's first sample, shared by its keys
    assert dt[("a", 180)] == 179_000  # no sample: send minus scrape


def test_window_start_stays_below_send(spark):
    got = window.window_events(_points(spark, [("a", "v", 1, False, 59.999)]), MetricSpec("m", 1, 60), ["host"]).first()
    assert got.dt // 1000 < got.dts


def test_thresholds(spark):
    def kept(series, limits):
        rows = [("p", v, x, False, n) for v, xs in series.items() for n, x in enumerate(xs)]
        return bool(_data(spark, rows, thresholds=limits))

    limits = {"cpu_util": 50, "ram_util": 80, "iops": 100}
    assert kept({"cpu_util": [10, 20, 55], "ram_util": [30, 40], "iops": [10]}, limits)
    assert not kept({"cpu_util": [10, 20, 30]}, {"cpu_util": 50})
    assert not kept({"cpu_util": [99]}, {})
    assert kept({"ram_util": [1]}, {"cpu_util": 0})


def test_names_and_rules(spark):
    rows = [(" ", "v", 1, False, 1), ("k ", " ", 1, False, 1), (" k", " w ", 3, False, 1)]
    got = _data(spark, rows)
    assert got == {("total", 60): {"v": {"last": 1}}, ("k", 60): {"w": {"last": 3}}}
    assert _data(spark, rows, drop_event=("w>2",)).keys() == {("total", 60)}


def test_emit_filter_and_resample(spark):
    p = _points(spark, [("a", "v", 1, False, 1), ("a", "v", 9, False, 2), ("b", "v", 2, False, 3)])
    s = window.series(p, "60 seconds", (), ["host"])
    kept = window.emit_filter(s, ["host"], F.max("raw_max") > 5).collect()
    assert [r.key for r in kept] == ["a"]
    assert {(r.key, r.raw) for r in points.resample(p, "5 seconds", "host").collect()} == {("a", 9.0), ("b", 2.0)}


@pytest.mark.parametrize(("defaults", "override", "want"), [([50, 90], None, [50, 90]), ([50], [], []), ([50], [99, 90, 99], [90, 99]), ([], None, [])])
def test_percentile_lists(defaults, override, want):
    assert resolve_percentiles(defaults, override) == want


def test_spec_defaults():
    assert MetricSpec.of("cpu").scrape == 30  # without percentiles the scrape is the send
    assert MetricSpec.of("process", defaults=[50]).scrape == 20
    assert MetricSpec.of("netflow", defaults=[50]).percentiles == ()
    assert MetricSpec.of("cpu").zero_fill and not MetricSpec.of("process").zero_fill
    with pytest.raises(ValueError):
        MetricSpec("x", percentiles=(0,))


def test_flatten_and_store(spark, tmp_path):
    data = {"util": {"last": 71, "p90": 95}}
    e = spark.createDataFrame([(1000, 2000, "cpu", "total", "h", data)], "dt bigint, dts bigint, metric string, key string, host string, data map<string,map<string,bigint>>")
    rows = store.stamp(store.flatten_events(e), F.timestamp_seconds(F.lit(5)))
    assert {(r["var"], r["agg"], r["value"], r["host_ip"]) for r in rows.collect()} == {("util", "last", 71, "::"), ("util", "p90", 95, "::")}
    store.write_metric_rows(rows, f"{tmp_path}/t")
    back = store.read_metric(spark, f"{tmp_path}/t", "cpu", "1970-01-01", "1970-01-01")
    assert back.count() == 2 and store.read_metric(spark, f"{tmp_path}/t", "ram").count() == 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "metric" in plan
    store.write_json_lines(e, f"{tmp_path}/log")
    assert store.read_events(spark, f"{tmp_path}/log").first().data == data


def test_retention_and_tables(spark):
    rows = spark.createDataFrame([("m", at(0)), ("m", at(86400 * 200))], "metric string, dt timestamp").withColumn("day", F.to_date("dt"))
    now = F.timestamp_seconds(F.lit(86400 * 201))
    assert store.apply_retention(rows, now).count() == 1
    assert [str(r.day) for r in store.expired_days(rows, now).collect()] == ["1970-01-01"]
    made = store.create_metric_tables(spark, "metrics_test", ["cpu", "ram"])
    assert made == ["metrics_test.cpu", "metrics_test.ram"]
    assert "dtv" in spark.table("metrics_test.cpu").columns
    with pytest.raises(ValueError):
        store.create_metric_tables(spark, "metrics_test", ["a; b"])


def test_fan_out_keeps_the_first_error(spark):
    got = []

    def bad(d, batch):
        raise RuntimeError("first")

    def worse(d, batch):
        raise RuntimeError("second")

    with pytest.raises(RuntimeError, match="first"):
        store.fan_out(spark.range(3), [lambda d, batch: got.append((d.count(), batch)), bad, worse, lambda d, batch: got.append((d.count(), batch))], 7)
    assert got == [(3, 7), (3, 7)]


def test_sinks_replace_a_repeated_batch(spark, tmp_path):
    data = {"util": {"last": 71, "p90": 95}}
    e = spark.createDataFrame([(1000, 2000, "cpu", "total", "h", data)], "dt bigint, dts bigint, metric string, key string, host string, data map<string,map<string,bigint>>")
    rows = store.stamp(store.flatten_events(e), F.timestamp_seconds(F.lit(5)))
    for batch in (0, 0, 1):
        store.fan_out(rows, [store.metric_sink(f"{tmp_path}/m"), store.table_sink(f"{tmp_path}/t", lambda d: d.limit(1))], batch)
    assert store.read_metric(spark, f"{tmp_path}/m", "cpu").count() == 4 and spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_values_beyond_64_bits_are_rejects(spark):
    e = window.window_events(_points(spark, [("k", "big", 1e19, False, 1), ("k", "nan", float("nan"), False, 1), ("k", "inf", float("inf"), True, 2)]), MetricSpec("m", 60, 60), ["host"])
    assert {(r["var"], r.value) for r in store.flatten_events(e).collect()} == {("nan", 0), ("inf", 100)}
    assert [(r["var"], r.agg) for r in store.overflow_rejects(e).collect()] == [("big", "last")]


def test_emit_filter_of_a_metric(spark):
    rows = [("a", "v", 1, False, 1), ("a", "w", 9, False, 2), ("b", "v", 2, False, 3)]
    emit = lambda key, cells: (key == "a") & F.exists(cells, lambda c: c["raw_max"] > 5)
    assert _data(spark, rows, emit=emit).keys() == {("a", 60)}
    assert _data(spark, rows, emit=emit, thresholds={"v": 2.0}) == {}


def test_shuffles_of_the_window_job(spark):
    """What a run shuffles: series once, and what is left of them by worker and window, in which
    their keys lie together. Nothing is joined."""
    p = _points(spark, [("a", "v", n, False, n) for n in range(200)])
    for spec in (MetricSpec("m", 5, 60, (50,)), MetricSpec("m", 60, 60)):
        made = window.window_events(p, spec, ["host"])
        made.write.format("noop").mode("overwrite").save()
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        by = [x[: x.index(", 4)")] for x in plan.split(" Exchange hashpartitioning(")[1:]]
        assert len(by) == 2 and sum("var#" in x for x in by) == 1 and sum("key#" not in x for x in by) == 1


def test_null_tags_have_a_window_time(spark):
    p = _points(spark, [("a", "v", 1, False, 7)]).withColumn("dc", F.lit(None).cast("string"))
    assert [(r.dt, r.dts) for r in window.window_events(p, MetricSpec("m", 5, 60, zero_fill=True), ["host", "dc"]).collect()] == [(7000, 60)]


def test_streams_take_nan_and_null(spark, tmp_path):
    """A bad sample or a null sequence number stops no stream, and gives what a table gives."""
    rows = [("h", "k", "v", float("nan"), False, at(1), None), ("h", "k", "w", float("inf"), True, at(2), 1), ("h", "k", "v", 3.0, False, at(65), None), ("h", "k", "v", 1.0, False, at(400), 1)]
    d = spark.createDataFrame(rows, POINT).coalesce(1)
    d.write.parquet(f"{tmp_path}/p")
    spec = MetricSpec("m", 60, 60, zero_fill=True)
    with streams.state_in_rocksdb(spark):
        made = streams.run_to_end(streams.window_events(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/p"), spec, ["host"], "0 seconds"))
    key = lambda r: (r.key, r.dts, r.dt, sorted((v, sorted(a.items())) for v, a in r.data.items()))
    want = window.window_events(d.filter("ts < timestamp_seconds(120)"), spec, ["host"])
    got = sorted(map(key, made.collect()))
    assert [g for g in got if g[1] <= 120] == sorted(map(key, want.collect()))
    # The worker was silent from then to the watermark, 400.
    zeros = [("v", [("last", 0)]), ("w", [("last", 0)])]
    assert [g for g in got if g[1] > 120] == [("k", end, (end - 60) * 1000, zeros) for end in (180, 240, 300, 360)]


def test_audits(spark):
    rows = [("1", "value", "last", 1, 2, "a"), ("2", "value", "last", 1, 2, "::"), ("2", "value", "last", 2, 2, "a"), ("stopped", "value", "last", 1, 2, "a"), ("3", "value", "p50", 1, 2, "a")]
    df = spark.createDataFrame(rows, "key string, var string, agg string, dt bigint, dts bigint, host_ip string")
    got = audit.delivery_audit(df, 2).first()
    assert (got.delivered, got.rows_last, got.bad_dt, got.bad_ip, got.complete, got.duplicates) == (2, 3, 1, 1, True, True)
    assert audit.throughput(df.withColumn("metric", F.lit("m")), 0).first().rows_per_s == 0.0


def plan_of(df):
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", text)), len(re.findall(r"FileScan|Scan parquet", text))


def test_windows_take_one_scan_and_few_shuffles(spark, data):
    """Plain windows: one scan, two shuffles. Zeros: the worker's last window is one more pruned
    scan, and two shuffles at most besides."""
    from hostmill.operators import window
    from hostmill.plans import fixtures as fx
    from hostmill.plans.spec import MetricSpec

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = fx.samples(spark, data)
        found = {}
        for name, settings in {"plain": {}, "last only": {"percentiles": []}, "zeros": {"zero_fill": True}}.items():
            spec = MetricSpec.of("app", send=21600, **{"percentiles": [50]} | settings)
            found[name] = plan_of(window.window_events(p, spec, ["host"]))
        specs = {str(k): MetricSpec("app", 5, 3600 * (k + 1), (50, 90 + k)) for k in range(10)}
        assert plan_of(window.definition_events(p, specs, ["host"])) == (2, 1)
        assert found["plain"] == found["last only"] == (2, 1)
        assert found["zeros"][0] <= 6 and found["zeros"][1] <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_definitions_of_one_length_share_their_rows(spark, data):
    """Definitions with the same windows take each point once, whatever their masks and percentiles."""
    from hostmill.operators import window
    from hostmill.plans import fixtures as fx
    from hostmill.plans.spec import MetricSpec

    p = fx.samples(spark, data)
    specs = {"a": MetricSpec("m", 5, 21600, (50,)), "b": MetricSpec("m", 5, 21600, (90,), drop=("k_*",)), "c": MetricSpec("m", 21600, 21600), "d": MetricSpec("m", 5, 3600, (50, 90), keep=("value",))}
    d = window.definition_events(p, specs, ["host"])
    rows = lambda x: sorted(map(repr, x.collect()))
    for name, spec in specs.items():
        own = d.filter(F.col("instance") == name)
        alone = window.window_events(p, spec, ["host"])
        assert rows(own.select(sorted(alone.columns))) == rows(alone.select(sorted(alone.columns)))
    text = d._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in text.splitlines() if "explode(filter(" in line][-1]
    assert inner.count("21600") == 1  # one copy for the three of six hours


def test_counters_of_a_null_host_are_kept(spark):
    from hostmill.operators import counters

    rows = [(h, "sda", f"2024-01-01 00:00:{s:02d}", s * 10.0) for h in (None, "h") for s in (0, 10)]
    d = spark.createDataFrame(rows, "host string, dev string, at string, reads double").withColumn("ts", F.col("at").cast("timestamp"))
    got = sorted((r.host or "", r.reads, r.prev_reads, r.seconds) for r in counters.with_previous(d, ["reads"], ["dev"]).collect())
    assert got == [("", 0.0, None, 0.0), ("", 100.0, 0.0, 10.0), ("h", 0.0, None, 0.0), ("h", 100.0, 0.0, 10.0)]


def test_delivery_counts_different_keys_by_bits(spark):
    keys = ["0", "1", "1", "01", "32768", "32769", "999999999999999999", "1000000000000000000", "9" * 30, "x", "-1", ""]
    cols = "key string, agg string, var string, dt timestamp, dts timestamp, host_ip string"
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    d = spark.createDataFrame([(k, "last", "value", t, t, "::") for k in keys] + [("77", "p50", "value", t, t, "::")], cols)
    (r,) = audit.delivery_audit(d, 8).collect()
    assert (r.delivered, r.rows_last, r.rows_total, r.bad_dt, r.bad_ip, r.complete, r.duplicates) == (8, 9, 13, 13, 13, True, True)
    (r,) = audit.delivery_audit(d.limit(0), 0).collect()
    assert (r.delivered, r.rows_last, r.rows_total, r.complete, r.duplicates) == (0, 0, 0, True, False)
