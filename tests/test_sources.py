import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from hostmill.operators import counters, flows
from hostmill.plans.spec import MetricSpec
from hostmill.sources import frames, hosts, json_points, procfs, prometheus
from hostmill.streaming import streams


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc)


def _json(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")


def test_json_points(spark):
    df = _json(spark, '{"key":"tcp","data":{"conn":12,"util":{"last":77.7}}}', ' [{"key":" a ","data":{"up":true,"x":{"value":1,"last":2,"kind":"PCT"}}}, {"key":"b","data":{"y":-1e2}}]', "[]")
    got = {(r.id, r.key, r["var"]): (r.raw, r.is_percent) for r in json_points.points_from_json(df, "payload").collect()}
    assert got == {(0, "tcp", "conn"): (12.0, False), (0, "tcp", "util"): (77.7, True), (1, "a", "up"): (1.0, False), (1, "a", "x"): (1.0, True), (1, "b", "y"): (-100.0, False)}


@pytest.mark.parametrize(
    "payload",
    [
        "", "7", '{"key":7,"data":{"v":1}}', '{"key":" ","data":{"v":1}}', '{"data":{"v":1}}', '{"key":"x"}', '{"key":"x","data":[]}', '{"key":"x","data":{}}',
        '{"key":"x","data":{"v":"1"}}', '{"key":"x","data":{"v":null}}', '{"key":"x","data":{"v":[1]}}', '{"key":"x","data":{"v":{}}}',
        '{"key":"x","data":{"v":{"value":1,"kind":"odd"}}}', '[{"key":"x","data":{"v":1}},{"key":"y"}]', '{"key":"x","data":{" ":1}}', '{"key":"x"', None,
        '{"key":"x","data":"{\\"v\\":1}"}', '{"key":"x","data":{"v":{"value":"12"}}}', '{"key":"x","data":{"v":{"value":null,"last":3}}}', "{'key':'x','data':{'v':1}}",
        '{"key":"x","data":{"v":1}},{"key":"y","data":{"v":1}}', '[{"key":"x","data":{"v":1}}] 7', '[1]', '{"key":"x","data":{"v":NaN}}', '{"key":"x","data":{"v":1e400}}',
        '{"key":"x","data":{"v":{"value":1,"kind":null}}}', '{"key":"x","data":{"v":{"value":1,"kind":7}}}', '{"key":null,"data":{"v":1}}',
    ],
)
def test_json_rejects(spark, payload):
    df = _json(spark, payload)
    assert json_points.json_rejects(df, "payload").count() == 1
    assert json_points.points_from_json(df, "payload").count() == 0


def test_json_is_parsed_once(spark):
    """One parse for objects and one for arrays, wherever filters and explodes end up."""
    df = _json(spark, "{}")
    for d in (json_points.points_from_json(df, "payload"), json_points.json_rejects(df, "payload")):
        assert d._jdf.queryExecution().executedPlan().toString().count("from_json") == 2


def test_prometheus(spark):
    text = """# HELP x y
late 3
# TYPE app_a_total counter
# type app_b Gauge
# TYPE hist histogram
app_a_total{path="/x y",q="a\\"}b"} 10 1700000000
app_a_total{path="z"} 15
app_b 2.5
hist_sum 9
odd
app_b NaN
# TYPE late counter
"""
    df = spark.createDataFrame([(1, text), (2, "x 1\n")], "id int, payload string")
    got = {(r.id, r["var"]): r.raw for r in prometheus.points_from_prometheus(df, "payload", ["id"]).collect()}
    assert got == {(1, "app_a_total"): 25.0, (1, "app_b"): 2.5}
    short = {r["var"] for r in prometheus.points_from_prometheus(df, "payload", ["id"], "short").collect()}
    assert short == {"a_total", "b"}
    assert [r.id for r in prometheus.prometheus_rejects(df, "payload", ["id"]).collect()] == [2]


def test_proc_sections(spark):
    text = "Tcp: ActiveOpens RetransSegs MaxConn Extra\nTcp: 11 33 -1\n\nUdp: OutDatagrams\nUdp: 10\nIp: A\nOther: 1\n"
    df = spark.createDataFrame([("h", text), ("g", "")], "host string, content string")
    got = {(r.section, r.field): r["value"] for r in procfs.proc_sections(df, "content", ["host"]).collect()}
    assert got == {("Tcp", "ActiveOpens"): 11, ("Tcp", "RetransSegs"): 33, ("Udp", "OutDatagrams"): 10}
    full = {r.host: r for r in procfs.stack_counters(df, "content", ["host"]).collect()}
    assert full["h"].udp_out_datagrams == 10 and full["h"].tcp_timeouts == 0 and full["g"].tcp_active_opens == 0


def test_kernel_capture(spark):
    stat = "cpu 1 2\nintr 120 0\nctxt 400\nsoftirq 88 1\nprocesses 45\nprocs_running 7\nprocs_blocked 2\n"
    df = spark.createDataFrame([(1, stat, "0.12 1.34 5.67 1/2 3\n"), (2, stat.replace("ctxt", "xctxt"), "1 2 3"), (3, stat, "1 2")], "id int, stat string, load string")
    got = procfs.kernel_snapshots(df, "stat", "load").collect()
    assert [(r.id, r.load1, r.load15, r.intr, r.ctxt, r.softirq, r.forks, r.procs_running, r.procs_blocked) for r in got] == [(1, 0.12, 5.67, 120, 400, 88, 45, 7, 2)]
    assert {r.id for r in procfs.kernel_rejects(df, "stat", "load").collect()} == {2, 3}


TCP = """  sl  local rem st tx rx
   0: A:1 B:2 01 00000040:00000001 00:0 00000004 0 0 1 1 x 20 4 30 10 -1
   1: A:1 B:2 0a 00000040:00000001 00:0 00000004 0 0 1 1 x 20 4 30 10 -1
   2: A:1 B:2 06 00000010:00000001 00:0 00000002 0 0 1 1 x 20 4 30 ff -1
   3: short
"""


def test_tcp_sockets(spark):
    df = spark.createDataFrame([("h", at(0), TCP)], "host string, ts timestamp, content string")
    s = procfs.tcp_socket_samples(df, "content", ["host", "ts"])
    assert sorted((r.tx_queue, r.rx_queue, r.retransmits, r.cwnd) for r in s.collect()) == [(16, 1, 2, 255), (64, 1, 4, 10)]
    scrapes = spark.createDataFrame([("h", at(0), "cubic\n"), ("g", at(0), "")], "host string, ts timestamp, algo string")
    got = {(r.key, r["var"]): r.raw for r in procfs.tcp_cc_points(s, scrapes, 1).collect()}
    assert got[("cc:cubic", "tcp_tx_queue_bytes")] == 64 and got[("cc:cubic", "tcp_cwnd_segs")] == 10 and got[("cc:unknown", "tcp_sockets")] == 0
    assert procfs.tcp_cc_points(s, scrapes, 0).count() == 0


def test_host_points(spark):
    fs = "host string, ts timestamp, mountpoint string, opts array<string>, total bigint, used bigint, free bigint, util double, inodes_total bigint, inodes_used bigint, inodes_free bigint, inodes_util double"
    df = spark.createDataFrame([("h", at(0), " / ", ["rw", " RO"], 10, 4, 6, 40.0, 1, 1, 0, float("nan")), ("h", at(0), " ", None, 1, 1, 1, 1.0, 1, 1, 1, 1.0)], fs)
    got = {(r.key, r["var"]): r.raw for r in hosts.fs_points(df).collect()}
    assert len(got) == 10 and got[("/", "readonly")] == 1 and got[("/", "inodes_util")] == 0 and got[("/", "avail")] == 6
    ram = spark.createDataFrame([("h", at(0), 0, 5, 1)], "host string, ts timestamp, total bigint, used bigint, available bigint")
    assert {r["var"]: r.raw for r in hosts.ram_points(ram).collect()} == {"total": 0, "used": 5, "free": 1, "util": 0}
    assert hosts.swap_points(ram).count() == 3


def test_net_deltas(spark):
    cols = "host string, ts timestamp, iface string, " + ", ".join(f"{c} bigint" for c in counters.NET)
    rows = [("h", at(0), "e0", 1000, 2000, 1, 1, 0, 0, 0, 0), ("h", at(2), "e0", 1300, 2700, 5, 1, 0, 2, 0, 0), ("h", at(4), "e0", 100, 2701, 5, 1, 0, 2, 0, 0), ("h", at(4), "e1", 9, 9, 9, 9, 9, 9, 9, 9), ("h", at(8), "e1", 19, 9, 9, 9, 9, 9, 9, 9)]
    got = {(r.ts.timestamp(), r.key, r["var"]): r.raw for r in counters.net_iface_points(spark.createDataFrame(rows, cols)).collect()}
    base = {t: got[(k, "e0", "tx_bytes")] for t, k in zip("abc", sorted({x[0] for x in got})[:3], strict=True)}
    assert base == {"a": 0, "b": 300, "c": 0}
    times = sorted({x[0] for x in got})
    assert got[(times[1], "e0", "rx_bytes")] == 700 and got[(times[1], "e0", "tx_bytes_per_sec")] == 150 and got[(times[1], "e0", "tx_err")] == 2
    assert got[(times[2], "e1", "tx_bytes")] == 0 and got[(times[3], "e1", "tx_bytes_per_sec")] == 2


def test_a_scrape_without_base_disks_is_still_the_one_before(spark, tmp_path):
    cols = "host string, ts timestamp, device string, inflight int, " + ", ".join(f"{c} bigint" for c in counters.DISK)
    rows = [("h", at(0), "sda", 0, *[100] * 8), ("h", at(10), "sda1", 0, *[150] * 8), ("h", at(20), "sda", 0, *[300] * 8), ("h", at(30), "sda", 0, *[340] * 8)]
    df = spark.createDataFrame(rows, cols)
    got = sorted((r.ts.timestamp(), r.raw) for r in counters.disk_points(df).filter("var = 'rx_bytes'").collect())
    assert [x for _, x in got] == [0, 0, 40]
    for k, part in enumerate((df.filter("ts < timestamp_seconds(15)"), df.filter("ts > timestamp_seconds(15)"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    with streams.state_in_rocksdb(spark):
        made = streams.run_to_end(streams.disk_points(stream)).filter("var = 'rx_bytes'").collect()
    assert sorted((r.ts.timestamp(), r.raw) for r in made) == got


def test_process_samples_of_one_name(spark):
    cols = "host string, ts timestamp, pid int, name string, cpu_util double, rss bigint, ram_total bigint, reads bigint, writes bigint"
    rows = [("h", at(t), p, "pg", 1.0, 10, 100, 10 * t, None) for t in (0, 10) for p in (1, 2)] + [("h", at(0), 3, "", 1.0, 1, 1, 1, 1)]
    got = counters.process_points(spark.createDataFrame(rows, cols)).filter("var = 'iops'").collect()
    assert sorted(r.raw for r in got) == [0, 0, 10, 10]


def _ip4(proto, body, frag=0, cut=None):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, frag, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return (b"\0" * 12 + b"\x08\x00" + head + body)[:cut]


def _tcp(flags):
    return struct.pack(">HHIIBBHHH", 1234, 443, 0, 0, 0x50, flags, 0, 0, 0)


UDP = struct.pack(">HHHH", 53, 5353, 12, 0) + b"data"


def test_frames(spark):
    v6 = struct.pack(">IHBB", 6 << 28, len(UDP) + 8, 0, 64) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + bytes([17, 0]) + b"\0" * 6 + UDP
    auth = struct.pack(">IHBB", 6 << 28, len(UDP) + 16, 51, 64) + b"\0" * 32 + bytes([17, 2]) + b"\0" * 14 + UDP
    later = struct.pack(">IHBB", 6 << 28, len(UDP) + 8, 44, 64) + b"\0" * 32 + bytes([17, 0, 0, 8]) + b"\0" * 4 + UDP
    many = struct.pack(">IHBB", 6 << 28, len(UDP) + 96, 0, 64) + b"\0" * 32 + b"".join(bytes([60 if k < 11 else 17, 0]) + b"\0" * 6 for k in range(12)) + UDP
    mac = b"\0" * 12
    cases = {
        1: _ip4(6, _tcp(2)), 2: _ip4(6, _tcp(0x12)), 3: mac + b"\x81\x00\x00\x01" + _ip4(17, UDP)[12:], 4: mac + b"\x88\xa8\x00\x01\x81\x00\x00\x02" + _ip4(17, UDP)[12:],
        5: mac + b"\x86\xdd" + v6, 6: mac + b"\x86\xdd" + auth, 7: mac + b"\x86\xdd" + later, 8: _ip4(17, UDP, frag=1), 9: _ip4(1, UDP), 10: _ip4(6, _tcp(2), cut=40), 11: b"", 12: mac, 13: _ip4(17, UDP, cut=40),
        14: mac + b"\x81\x00\x00\x01" * 9 + _ip4(17, UDP)[12:], 15: mac + b"\x86\xdd" + many, 16: mac + b"\x81\x00" * 3,
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "id int, frame binary")
    got = {r.id: r for r in frames.packets_from_frames(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 13, 14, 15}
    assert got[14].bytes == 32 and got[15].src_port == 53
    assert (got[1].bytes, got[1].tcp_start, got[1].src_port, got[1].dst_port) == (40, True, 1234, 443)
    assert not got[2].tcp_start and got[3].bytes == 32 and got[4].proto == 17
    assert got[5].bytes == 60 and bytes(got[5].src_addr)[-1] == 1 and not got[5].src_v4
    assert got[13].bytes == 26
    assert bytes(got[1].src_addr) == b"\0" * 12 + bytes([10, 0, 0, 1])


PACKET = "host string, iface string, proto int, src_addr binary, dst_addr binary, src_v4 boolean, dst_v4 boolean, src_port int, dst_port int, bytes bigint, tcp_start boolean, ts timestamp, seq bigint"


def _packet(proto, size, t, seq, start=False, port=1):
    return ("h", "eth0", proto, bytearray(b"\0" * 12 + b"\n\0\0\1"), bytearray(b"\0" * 12 + b"\n\0\0\2"), True, True, port, 443, size, start, at(t), seq)


def test_flow_starts_and_top(spark):
    rows = [_packet(6, 10, 0, 1, True), _packet(6, 10, 1, 2)] + [_packet(17, 5, t, 9 + t) for t in (0, 5, 15, 26)]
    d = flows.flows(spark.createDataFrame(rows, PACKET), "60 seconds", 10)
    got = {r.proto: (r["bytes"], r["packets"], r["flows"]) for r in d.collect()}
    assert got == {6: (20, 2, 1), 17: (20, 4, 3)}
    many = spark.createDataFrame([_packet(6, s, 0, s, port=s) for s in (100, 300, 200)], PACKET)
    top = flows.top_flows(flows.flows(many, "60 seconds"), 2).orderBy("place").collect()
    assert [r["bytes"] for r in top] == [300, 200]


def test_netflow_job_and_pairs(spark):
    d = spark.createDataFrame([_packet(6, 1200, 0, 1, True), _packet(17, 800, 3, 2)], PACKET)
    got = flows.netflow_job(d, MetricSpec("netflow", 5, 30, ()), ["eth*"]).collect()
    assert sorted((r["proto"], r["bytes"], r["packets"], r["flows"], r.src_ip) for r in got) == [("tcp", 1200, 1, 1, "::ffff:10.0.0.1"), ("udp", 800, 1, 1, "::ffff:10.0.0.1")]
    assert flows.netflow_job(d, MetricSpec("netflow", 5, 30, ()), ["wlan*"]).count() == 0
    raw = spark.createDataFrame([("eth0|tcp|::1|70000|0:0::1|x", "last", "bytes", 5), ("a|b", "last", "bytes", 1), ("eth0|tcp|::1|1|::1|2", "p50", "bytes", 5)], "key string, agg string, var string, value bigint")
    for c in ("dc", "host", "project", "role", "host_ip"):
        raw = raw.withColumn(c, F.lit("x"))
    raw = raw.withColumn("dt", F.timestamp_seconds(F.lit(1))).withColumn("dts", F.timestamp_seconds(F.lit(2)))
    r = flows.netflow_pairs(raw).collect()
    assert [(x.src_ip, x.src_port, x.dst_ip, x.dst_port, x["bytes"], x["packets"]) for x in r] == [("::1", 0, "::1", 0, 5, 0)]


def test_rows_of_late_scrapes_are_kept_apart(spark, tmp_path):
    """What comes after a newer scrape is marked, not lost."""
    cols = "host string, ts timestamp, device string, inflight int, " + ", ".join(f"{c} bigint" for c in counters.DISK)
    df = spark.createDataFrame([("h", at(s), "sda", 0, *[100 + s] * 8) for s in (0, 10, 20, 30)], cols)
    df.filter("ts <> timestamp_seconds(10)").coalesce(1).write.parquet(f"{tmp_path}/0")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path))
    df.filter("ts = timestamp_seconds(10)").coalesce(1).write.parquet(f"{tmp_path}/1")
    with streams.state_in_rocksdb(spark):
        made = streams.run_to_end(streams.disk_points(stream())).filter("var = 'rx_bytes'").count()
        late = streams.run_to_end(streams.late_rows(stream(), counters.DISK, ["device"])).collect()
    assert made + len(late) == 4 and [r.ts for r in late] == [r.ts for r in df.filter("ts = timestamp_seconds(10)").collect()]
