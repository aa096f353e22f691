import random

import pytest
from pyspark.sql import functions as F

from hostmill.functions import masks, rules, values
from hostmill.functions.addresses import with_ipv6


def _mask_model(mask, value):
    parts = mask.split("*")
    if not value.startswith(parts[0]) or not value.endswith(parts[-1]):
        return False
    at = len(parts[0])
    for p in parts[1:-1]:
        at = value.find(p, at)
        if at < 0:
            return False
        at += len(p)
    return True


def test_masks_against_a_model(spark):
    rnd = random.Random(5)
    texts = ["", "core0", "pg_postgres_x", "dbmain", "db_main", "eth1", "aba", "util_x_util", "util", "a.b", "rx_err", "net_rx_a_err_b"]
    texts += ["".join(rnd.choice("ab_") for _ in range(rnd.randrange(6))) for _ in range(60)]
    patterns = ["*", "core*", "*postgres*", "db*main", "*rx*err*", "eth*1", "util", "ab*ba", "a.b", "a*b*a", "**a**"]
    patterns += ["".join(rnd.choice("ab*") for _ in range(1 + rnd.randrange(5))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[masks.wildcard(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for row in got:
        for k, p in enumerate(patterns):
            assert row[f"p{k}"] == _mask_model(p, row["t"]), (p, row["t"])
    assert masks.wildcard(F.col("t"), "  ") is None


def test_keep_and_drop_masks(spark):
    df = spark.createDataFrame([("rx_bytes_per_sec",), ("rx_err",), ("tx_bytes_per_sec",)], "v string")
    got = df.filter(masks.allowed(F.col("v"), ["rx_*"], ["rx_err", " "])).collect()
    assert [r.v for r in got] == ["rx_bytes_per_sec"]


EVENT = "metric string, key string, data map<string,map<string,bigint>>"


@pytest.mark.parametrize(
    ("rule", "dropped"),
    [
        ("key!=core*", True), ("key=total", True), ("key=tot", False), ("metric=cpu", True), ("metric>a", False),
        ("iops>100", True), ("iops>200", False), ("iops<151", True), ("iops=150", True), ("iops=150.0", True), ("iops!=150", False),
        ("iops=15*", True), ("iops>=5", False), ("absent!=1", False), ("var=rx_*", True), ("var!=rx_*", False), ("var!=tx_*", True), ("var=rx", False),
    ],
)
def test_drop_rules(spark, rule, dropped):
    df = spark.createDataFrame([("cpu", "total", {"iops": {"last": 150, "p50": 1}, "rx_err": {"last": 0}})], EVENT)
    assert rules.drop_events(df, [rule]).count() == (0 if dropped else 1)


def test_bad_rules():
    for text in ("", "key", "=x", "key="):
        with pytest.raises(ValueError):
            rules.parse_rule(text)


def test_stored_values(spark):
    rows = [(0.49999999999999994, False, 0), (0.5, False, 1), (2.5, False, 3), (-3.0, False, 0), (150.0, True, 100), (150.0, False, 150), (float("nan"), False, 0), (1e30, False, None), (1e30, True, 100)]
    df = spark.createDataFrame(rows, "x double, p boolean, want bigint")
    assert all(r.got == r.want for r in df.select("want", values.normalised(F.col("x"), F.col("p")).alias("got")).collect())


def test_base_disks_and_device_paths(spark):
    names = {"sda": 1, "sda1": 0, "vdb": 1, "vdb2": 0, "xvda": 1, "xvda1": 0, "hda": 1, "hda3": 0, "nvme0n1": 1, "nvme0n1p1": 0, "mmcblk0": 1, "mmcblk0p2": 0, "loop0": 0, "ram1": 0, "dm-0": 1, "md0": 1, "zd0": 1, "": 0, " ": 0, "/dev/sdb": 1, "/dev/sdb1": 0, "odd": 1}
    df = spark.createDataFrame([(k, bool(v)) for k, v in names.items()], "n string, want boolean")
    assert all(r.got == r.want for r in df.select("n", "want", values.is_base_disk(F.col("n")).alias("got")).collect())
    paths = spark.createDataFrame([("sda", "/dev/sda"), (" ", "/dev/unknown"), ("/dev/x", "/dev/x")], "n string, want string")
    assert all(r.got == r.want for r in paths.select("want", values.device_path(F.col("n")).alias("got")).collect())


def test_numbers_and_names(spark):
    numbers = [("5", 5.0), ("5d", None), ("NaN", None), ("inf", None), ("-1.5e3", -1500.0), ("1e999", None), ("", None), (".5", 0.5)]
    df = spark.createDataFrame(numbers, "t string, want double")
    assert all(r.got == r.want for r in df.select("want", values.finite_number(F.col("t")).alias("got")).collect())
    names = [("a_b_c", "b_c"), ("_a", "_a"), ("a_", "a_"), ("abc", "abc")]
    df = spark.createDataFrame(names, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", values.short_name(F.col("t")).alias("got")).collect())
    hexes = [("40", 64), ("zz", None), ("", None), ("FFFFFFFF", 4294967295)]
    df = spark.createDataFrame(hexes, "t string, want bigint")
    assert all(r.got == r.want for r in df.select("want", values.hex_number(F.col("t")).alias("got")).collect())


def test_ipv6(spark):
    rows = [("10.0.0.1", "::ffff:10.0.0.1"), ("2001:DB8:0::1", "2001:db8::1"), ("bad", "::"), ("1:2", "::"), (None, "::"), ("256.1.1.1", "::")]
    got = with_ipv6(spark.createDataFrame(rows, "ip string, want string"), "ip").collect()
    assert len(got) == len(rows)
    assert all(r.ip == r.want for r in got)


def test_ipv6_text_against_the_standard_library(spark):
    """Random texts with zeros, dotted tails, zones and mistakes; no Python in the plan."""
    import ipaddress
    import random

    rnd = random.Random(4)
    texts = ["::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", ":::", "1:::2", "1::2::3", ":1", "1:", "::1.2.3.4", "::FFFF:1.2.3.4", "64:ff9b::192.0.2.33",
             "1:2:3:4:5:6:1.2.3.4", "1.2.3.4::", "::1.2.3", "::1.2.3.256", "fe80::1%eth0", "0:0:1:0:0:0:1:0", "1:0:0:2:0:0:3:4", "00001::", "::g", "::1\n", "", "a", "::0:0", "0:0:0:0:0:ffff:102:304"]
    for _ in range(1500):
        parts = [rnd.choice(["0", "0", "0", "", "00a", "FFFF", "1", "12345", "x", "1.2.3.4"] if rnd.random() < 0.4 else ["0", "0", "0db8", "ffff", "1"]) for _ in range(rnd.choice([3, 7, 8, 8, 8, 9]))]
        texts.append(":".join(parts))
        if rnd.random() < 0.5:
            k = rnd.randrange(len(texts[-1]))
            texts[-1] = texts[-1][:k] + "::" + texts[-1][k:].lstrip(":")

    def want(t):
        try:
            return str(ipaddress.IPv6Address(t)) if ":" in t and "%" not in t else "::"
        except ValueError:
            return "::"

    d = with_ipv6(spark.createDataFrame([(t, t) for t in texts], "t string, ip string"), "ip")
    assert "Python" not in d._jdf.queryExecution().toString()
    bad = [(r.t, r.ip, want(r.t)) for r in d.collect() if r.ip != want(r.t)]
    assert not bad, bad[:5]
