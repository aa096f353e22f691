"""Streams in several micro-batches against the batch jobs, and reads of the newest days."""

import random
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostmill.operators import counters, flows, ranks, store, window
from hostmill.plans.spec import MetricSpec
from hostmill.streaming import known, streams

POINT = "host string, key string, var string, raw double, is_percent boolean, ts timestamp, seq bigint"
PACKET = "host string, iface string, proto int, src_addr binary, dst_addr binary, src_v4 boolean, dst_v4 boolean, src_port int, dst_port int, bytes bigint, tcp_start boolean, ts timestamp, seq bigint"


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc)


def in_batches(spark, path, schema, *batches):
    """A stream of one micro-batch for each list of rows."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_a_silent_worker_goes_on_with_zeros_and_its_series_end(spark, tmp_path):
    point = lambda host, key, t: (host, key, "v", 5.0, False, at(t), t)
    first = [point("a", "k", 10), point("a", "q", 70), point("b", "k", 15)]
    later = [[point("b", "k", t)] for t in (130, 310, 610)]
    with streams.state_in_rocksdb(spark):
        s = in_batches(spark, tmp_path / "p", POINT, first, *later)
        r = streams.run_to_end(streams.known_series(s, 60, "0 seconds")).collect()
        ended = streams.run_to_end(streams.known_series(in_batches(spark, tmp_path / "q", POINT, first, *later), 60, "0 seconds", 120)).collect()
    got = {k: sorted((x.dts, x.n, x["last"]) for x in r if (x.host, x.key) == k) for k in {(x.host, x.key) for x in r}}
    zeros = lambda *ends: [(e, 0, 0) for e in ends]
    assert got[("a", "k")] == [(60, 1, 5), *zeros(*range(120, 601, 60))]
    assert got[("a", "q")] == [(120, 1, 5), *zeros(*range(180, 601, 60))]
    assert got[("b", "k")] == sorted([(60, 1, 5), (180, 1, 5), (360, 1, 5), *zeros(120, 240, 300, *range(420, 601, 60))])
    kept = {k: sorted(x.dts for x in ended if (x.host, x.key) == k) for k in {(x.host, x.key) for x in ended}}
    assert kept == {("a", "k"): [60, 120, 180], ("a", "q"): [120, 180, 240], ("b", "k"): [60, 120, 180, 240, 300, 360, 420, 480]}


@pytest.mark.parametrize(("scrape", "idle"), [(60, 10), (60, 7), (5, 30), (30, 45)])
def test_totals_without_windows_equal_those_of_ordered_packets(spark, scrape, idle):
    dice = random.Random(scrape * 100 + idle)
    ends = (bytearray(b"\0" * 12 + b"\n\0\0\1"), bytearray(b"\0" * 12 + b"\n\0\0\2"))
    rows, t = [], 0.0
    for n in range(600):
        t += dice.choice((0, 0.25, 1, idle - 0.000001, idle, idle + 3, scrape))
        rows.append(("h", "eth0", dice.choice((6, 17, 1)), *ends, True, True, dice.randrange(2), 443, dice.randrange(99), dice.random() < 0.3, at(round(t, 6)), n))
    p = spark.createDataFrame(rows, PACKET)
    cells = lambda d: sorted((r.proto, r.src_port, r.w.start, r.w.end, r["bytes"], r["packets"], r["flows"]) for r in d.collect())
    assert cells(flows.flow_totals(p, scrape, idle)) == cells(flows.flows(p, f"{scrape} seconds", idle))


def test_netflow_stream_in_batches_equals_the_job(spark, tmp_path):
    ends = (bytearray(b"\0" * 12 + b"\n\0\0\1"), bytearray(b"\0" * 12 + b"\n\0\0\2"))
    rows = [("h", "eth0", 17, *ends, True, True, n % 3, 443, n + 1, False, at(n * 4), n) for n in range(60)]
    spec = MetricSpec("netflow", 20, 60, ())
    streams.netflow_tops(in_batches(spark, tmp_path / "p", PACKET, rows[:25], rows[25:40], rows[40:]), spec, f"{tmp_path}/tops", f"{tmp_path}/one", "0 seconds", n=2)
    tops = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/tops").schema).parquet(f"{tmp_path}/tops")
    streams.netflow_pairs(tops, spec, f"{tmp_path}/pairs", f"{tmp_path}/two", "0 seconds")
    cols = ["host", "dts", "iface", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "bytes", "packets", "flows"]
    want = flows.netflow_job(spark.createDataFrame(rows, PACKET), spec, n=2).filter("dts < timestamp_seconds(220)")
    got = spark.read.parquet(f"{tmp_path}/pairs").select(cols).collect()
    assert got and sorted(got) == sorted(want.select(cols).collect())


def test_process_streams_in_batches_equal_the_table(spark, tmp_path):
    """Unnamed processes make a scrape; one that was unnamed before has no previous row."""
    schema = "host string, ts timestamp, pid int, name string, cpu_util double, rss bigint, ram_total bigint, reads bigint, writes bigint"
    scrapes = [
        [("h", at(0), 1, "a", 1.0, 1, 2, 10, None), ("h", at(0), 2, "", 1.0, 1, 2, 10, 0)],
        [("h", at(10), 1, "a", 1.0, 1, 2, 30, 5), ("h", at(10), 2, "b", 1.0, 1, 2, 50, 0)],
        [("h", at(20), 3, None, 1.0, 1, 2, 1, 1)],
        [("h", at(30), 1, "a", 1.0, 1, 2, 90, 5), ("h", at(30), 2, "b", 1.0, 1, 2, 99, 0)],
        [("h", at(40), 1, "a", 1.0, 1, 2, 20, 5), ("h", at(40), 2, "b", 1.0, 1, 2, 199, 0), (None, at(40), 2, "b", 1.0, 1, 2, 199, 0)],
    ]
    rows = lambda d: sorted(map(repr, d.collect()))
    with streams.state_in_rocksdb(spark):
        got = rows(streams.run_to_end(streams.process_points(in_batches(spark, tmp_path / "s", schema, *scrapes))))
    assert got == rows(counters.process_points(spark.createDataFrame(sum(scrapes, []), schema)))


class _State:
    """A host's state that counts how often it is read and written."""

    def __init__(self):
        self.value, self.calls = None, 0

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_scrapes_of_a_host_are_matched_at_once(spark):
    """Late rows, repeated rows, scrapes over several batches and null entities and counters,
    against rows taken one by one. A batch reads and writes its host's state once at most."""
    dice = random.Random(3)
    match = known.PreviousScrapes(["c"], "e", "at", ["n", "at", "e", "c", "seconds", "has_prev", "late", "prev_c"])
    state, seen, newest, before, nan = _State(), {}, None, None, float("nan")
    clean = lambda x: "null" if x != x else x
    for batch in range(200):
        rows = [(n, max(0, batch * 3 + dice.randrange(-4, 5)) * 500_000, dice.choice(("a", "b", "c", None)), dice.choice((dice.randrange(99) * 1.0, nan))) for n in range(dice.randrange(1, 12))]
        calls = state.calls
        got = pd.concat(match(("h",), iter([pd.DataFrame(rows[:4], columns=["n", "at", "e", "c"]), pd.DataFrame(rows[4:], columns=["n", "at", "e", "c"])]), state))
        assert state.calls - calls <= 2
        want = {}
        for n, at, e, c in sorted(rows, key=lambda r: r[1]):
            if newest is not None and at < newest:
                want[n] = (0.0, False, True, "null")
                continue
            if at != newest:
                before, newest = newest, at
            old = None if e is None else seen.get((e, before))
            want[n] = (0.0 if before is None else (at - before) / 1e6, old is not None, False, "null" if old is None else clean(old))
            if e is not None:
                seen[e, at] = c
        assert {r.n: (r.seconds, r.has_prev, r.late, clean(r.prev_c)) for r in got.itertuples()} == want


def test_streams_tell_scrapes_apart_when_clocks_go_back(spark, tmp_path):
    """Two scrapes of one local time, an hour apart."""
    schema = "host string, ts timestamp, ctxt bigint, intr bigint, softirq bigint, forks bigint"
    scrapes = [[("h", at(1729989000 + s), n, n, n, n)] for s, n in ((0, 0), (3600, 7200))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with streams.state_in_rocksdb(spark):
            got = streams.run_to_end(streams.with_previous(in_batches(spark, tmp_path / "s", schema, *scrapes), counters.KERNEL, [])).withColumn("us", F.unix_micros("ts")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.us, r.ctxt, r.seconds, r.prev_ctxt) for r in got) == [(1729989000_000000, 0, 0.0, None), (1729992600_000000, 7200, 3600.0, 0.0)]


def _stored(spark, root, days):
    rows = [(f"2024-01-{d:02d} 12:00:{n:02d}", send, f"h{n}", key, d * 100 + n) for d, n, send, key in days]
    r = spark.createDataFrame(rows, "at string, send int, host string, key string, value bigint")
    dt = F.col("at").cast("timestamp")
    r = r.withColumns({"dt": F.unix_millis(dt), "dts": F.unix_seconds(dt) + F.col("send"), "metric": F.lit("m"), "var": F.lit("v"), "agg": F.lit("last")})
    store.write_metric_rows(store.stamp(r, F.timestamp_seconds(F.lit(0))), root)


def test_newest_rows_read_the_newest_days_alone(spark, tmp_path):
    root = str(tmp_path)
    _stored(spark, root, [(d, n, 30, "k" if d <= 7 or n else "new") for d in range(1, 21) for n in range(3)])
    assert len(store.day_folders(spark, root, "m")) == 20
    r = store.recent_rows(spark, root, "m", 5, "host")
    assert [x.value for x in r.collect()] == [2002, 2001, 2000, 1902, 1901]
    days = lambda d: {f.split("day=")[1][:10] for f in d.inputFiles()}
    assert days(store.read_days(spark, root, "m", store.newest_days(spark, root, "m", F.lit(True), 5))) == {"2024-01-20", "2024-01-19"}
    assert store.newest_days(spark, root, "m", F.expr("host = 'h0' AND key = 'k'")) == store.day_folders(spark, root, "m")[:16]
    assert store.latest_row(spark, root, "m", F.expr("host = 'h0' AND key = 'k'"), 60).first().value == 700
    assert store.latest_row(spark, root, "m", F.expr("host = 'none'"), 60).count() == 0
    assert store.recent_rows(spark, root, "other", 5).count() == 0


def test_the_last_send_time_may_be_an_older_day(spark, tmp_path):
    """A window of three days that began before sends after one of today."""
    _stored(spark, str(tmp_path), [(1, 0, 30, "k"), (8, 0, 3 * 86400, "k"), (9, 0, 3 * 86400 - 100, "k"), (10, 0, 30, "k")])
    assert store.latest_row(spark, str(tmp_path), "m", F.lit(True), 3 * 86400).first().value == 900


@pytest.mark.parametrize("held", [1, 7, 100_000])
def test_ranks_by_narrowed_ranges(spark, held):
    dice = random.Random(5)
    big = [dice.choice((dice.gauss(0, 1), dice.lognormvariate(0, 20), -dice.random(), 0.0, 7.0)) for _ in range(3000)]
    odd = [float("nan"), float("inf"), float("-inf"), 1e308, -1e308, 5e-324, -0.0, 0.0, None] * 3
    rows = [("big", v) for v in big] + [(None, v) for v in odd] + [("one", 3.0), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    wanted = (1, 7, 50, 90, 100)
    got = ranks.percentiles(d, ["k"], "v", wanted, held)
    want = d.filter("v IS NOT NULL").groupBy("k").agg(*[window.percentile("v", p).alias(f"p{p}") for p in wanted])
    plain = lambda f: sorted(repr((r.k, *[x + 0.0 for x in r[1:]])) for r in f.collect())
    assert plain(got) == plain(want)
