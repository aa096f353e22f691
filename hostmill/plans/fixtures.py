"""Views over the given tables that stand for metric inputs, as Spark frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of eight hosts: each event gives a value and a percentage."""
    e = _events(spark, sf_dir)
    return as_samples(e)


def as_samples(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    cells = F.array(
        F.struct(F.lit("value").alias("var"), F.col("value").alias("raw"), F.lit(False).alias("is_percent")),
        F.struct(F.lit("k_util").alias("var"), k.alias("raw"), F.lit(True).alias("is_percent")),
    )
    d = e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"), F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), F.explode(cells).alias("c")
    )
    return d.select("host", "key", "ts", "seq", "c.*")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters by host and day, with a reset and missing scrapes; eight users are a host."""
    _events(spark, sf_dir).createOrReplaceTempView("fixture_events")
    return spark.sql("""
        WITH d AS (SELECT concat('h', user_id div 8) AS host, event_type AS entity, extract(day FROM ts) AS d,
                          CAST(sum(floor(value * 100)) AS BIGINT) AS b, count(*) AS c FROM fixture_events GROUP BY 1, 2, 3)
        SELECT host, entity, d, timestamp_seconds(d * 86400) AS ts,
               sum(b) OVER (PARTITION BY host, entity, d >= 16 ORDER BY d) AS bytes,
               sum(c) OVER (PARTITION BY host, entity, d >= 16 ORDER BY d) AS cnt
        FROM d WHERE (d + length(entity)) % 7 <> 0""")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded packets of three hosts over a day."""
    return packets_of(read(spark, sf_dir, "lineitem"))


def packets_of(d: DataFrame) -> DataFrame:
    zeros = F.unhex(F.lit("00" * 12))
    octet = lambda c: F.unhex(F.lpad(F.hex(c.cast("int")), 2, "0"))
    t = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 86400
    return d.select(
        F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string")).alias("host"),
        F.concat(F.lit("eth"), (F.col("l_suppkey") % 2).cast("string")).alias("iface"),
        F.when(F.col("l_linenumber") % 2 == 0, 6).otherwise(17).alias("proto"),
        F.concat(zeros, F.unhex(F.lit("0A0000")), octet(F.col("l_suppkey") % 5)).alias("src_addr"),
        F.concat(zeros, F.unhex(F.lit("0A0001")), octet(F.col("l_partkey") % 2)).alias("dst_addr"),
        F.lit(True).alias("src_v4"),
        F.lit(True).alias("dst_v4"),
        (40000 + F.col("l_partkey") % 3).cast("int").alias("src_port"),
        F.lit(443).alias("dst_port"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F")).alias("tcp_start"),
        F.timestamp_seconds(t).alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_payloads_of(read(spark, sf_dir, "events")).select("event_id", "payload")


def json_payloads_of(e: DataFrame) -> DataFrame:
    """The events with ``payload``; every 17th and 19th is bad, in one of six ways. Every fifth
    says the same with names that repeat, capitals and other white space around."""
    good = F.concat(
        F.lit('{"key":"'), "event_type", F.lit('","data":{"value":'), F.col("value").cast("string"),
        F.lit(',"util":{"last":'), F.regexp_extract("props", "([0-9]+)", 1), F.lit('},"flag":true}}'),
    )
    odd = F.concat(
        F.lit('\xa0{"key":"none","key":"'), "event_type", F.lit('","data":{"value":"bad","util":7,"flag":false,"value":{"value":0,"VALUE":1,"value":'), F.col("value").cast("string"),
        F.lit('},"util":{"LAST":'), F.regexp_extract("props", "([0-9]+)", 1), F.lit(',"Kind":"percent"}," flag ":true}}\u2003'),
    )
    good = F.when(F.col("event_id") % 5 == 1, odd).otherwise(good)
    bad = ['{"key":7,"data":{"value":1}}', '{"key":"x","data":"{\\"v\\":1}"}', '{"key":"x","data":{"v":{"value":"12"}}}', '{"key":"x","data":{"v":{"value":null,"last":3}}}', "{'key':'x','data':{'v':1}}"]
    seventeenth = F.get(F.array(*map(F.lit, bad)), (F.col("event_id") / 17).cast("int") % len(bad))
    payload = F.when(F.col("event_id") % 17 == 0, seventeenth).when(F.col("event_id") % 19 == 0, '{"key":"x"}').otherwise(good)
    return e.withColumn("payload", payload)


def prometheus_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each host and day; eight users are a host."""
    e = _events(spark, sf_dir)
    line = F.concat(F.lit("app_"), "event_type", F.lit('{u="'), F.col("user_id").cast("string"), F.lit(' }"} '), F.floor("value").cast("bigint").cast("string"))
    d = e.groupBy(F.concat(F.lit("h"), F.expr("user_id div 8").cast("string")).alias("host"), F.dayofmonth("ts").alias("d"))
    d = d.agg(F.collect_list(line).alias("lines"), F.collect_set("event_type").alias("types"))
    kind = lambda t: F.when(t == "view", "gauge").when(t == "error", "histogram").otherwise("counter")
    declared = F.transform("types", lambda t: F.concat(F.lit("# TYPE app_"), t, F.lit(" "), kind(t)))
    head = F.array(F.lit("# HELP x y"), F.lit("late_total 3"), F.lit("# TYPE late_total counter"))
    return d.select("host", "d", F.array_join(F.concat(head, declared, "lines"), "\n").alias("payload"))


def proc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with numbers from the snapshots: network sections, kernel files, a socket table."""
    s = snapshots(spark, sf_dir)
    n = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    snmp = text("Tcp: ActiveOpens RetransSegs MaxConn\nTcp: ", n("bytes"), " ", n("cnt"), " -1\n\nUdp: InDatagrams OutDatagrams\nUdp: ", n("cnt"), "\n")
    stat = text("cpu 1 2 3\nintr ", n("bytes"), " 0 0\nctxt ", n("cnt"), "\nprocesses ", n("cnt"), "\nprocs_running 2\nprocs_blocked 0\n", F.when(F.col("d") % 5 != 0, F.lit("softirq 7 1\n")).otherwise(F.lit("")))
    row = lambda k, state: text(f"  {k}: 0100007F:0016 00000000:0000 {state} ", F.lpad(F.hex(F.col("cnt") + k), 8, "0"), ":", F.lpad(F.hex(F.col("bytes") % 1000), 8, "0"), " 00:00000000 0000000", str(k), "  0 0 1 1 0 20 4 30 ", n("cnt"), " -1\n")
    tcp = text("  sl  local_address rem_address   st tx_queue rx_queue tr tm->when retrnsmt\n", row(1, "01"), row(2, "0A"), row(3, "06"))
    return s.select("host", "entity", "d", "ts", "bytes", "cnt", snmp.alias("snmp"), stat.alias("stat"), F.lit("0.50 1.25 2.00 1/100 42\n").alias("loadavg"), tcp.alias("tcp"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured frames of five shapes: plain, tagged, IPv6, a later fragment, a cut one."""
    d = read(spark, sf_dir, "lineitem")
    h2 = lambda c: F.lpad(F.hex(c.cast("int")), 4, "0")
    shape = F.col("l_orderkey") % 5
    ports = F.concat(h2(40000 + F.col("l_partkey") % 3), F.lit("01BB"))
    flags = F.when(F.col("l_returnflag") == "R", "02").otherwise("12")
    tcp = F.concat(ports, F.lit("00000001000000005"), F.lit("0"), flags, F.lit("200000000000"))
    udp = F.concat(ports, F.lit("00080000"))
    v4 = lambda proto, frag, length, rest: F.concat(F.lit("4500"), F.lit(length), F.lit("0001"), F.lit(frag), F.lit("40"), F.lit(proto), F.lit("00000A000001"), F.lit("0A000102"), rest)
    mac = F.lit("00" * 12)
    hexed = (
        F.when(shape == 0, F.concat(mac, F.lit("0800"), v4("06", "0000", "0028", tcp)))
        .when(shape == 1, F.concat(mac, F.lit("8100006488A80065"), F.lit("0800"), v4("11", "0000", "001C", udp)))
        .when(shape == 2, F.concat(mac, F.lit("86DD"), F.lit("60000000"), F.lit("0010"), F.lit("0040"), F.lit("0" * 31 + "1"), F.lit("0" * 31 + "2"), F.lit("1100000000000000"), udp))
        .when(shape == 3, F.concat(mac, F.lit("0800"), v4("11", "0001", "001C", udp)))
        .otherwise(F.lit("0000000000000000000000000800"))
    )
    return d.select(F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string")).alias("host"), F.lit("eth0").alias("iface"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.unhex(hexed).alias("frame"))


def foreign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an event log as another program may write it: values of all types, entries that
    are no objects, repeated names; every 11th line is cut and every 13th has no object of data."""
    e = read(spark, sf_dir, "events")
    line = F.concat(
        F.lit('{"dts":1700000000,"dt":1699999999000,"metric":"m","host":"h","more":{"x":1},"key":"'), F.col("event_id").cast("string"),
        F.lit('","data":{"a":5,"c":[1],"d":null,"b":{"last":"7","p50":"x","p90":'), F.col("value").cast("string"),
        F.lit(',"p99":-3.7,"t":true,"n":null,"o":{"z":1},"f":"3.5","w":1e30,"r":1,"r":2}}}'),
    )
    bare = F.concat(F.lit('{"dts":1700000000,"key":"'), F.col("event_id").cast("string"), F.lit('","data":9}'))
    cut = F.substring(line, 1, 100)
    return e.select(F.when(F.col("event_id") % 11 == 0, cut).when(F.col("event_id") % 13 == 0, bare).otherwise(line).alias("line"))
