"""Network flows: starts, totals per scrape, the largest, and the table of pairs."""

from __future__ import annotations

from collections.abc import Iterable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.addresses import to_ipv6
from ..functions.masks import any_mask
from ..functions.values import address_text, flow_key, flow_parts, port_or_zero
from ..plans.spec import MetricSpec
from .points import to_points
from .window import metric_rows

#: Seconds without a packet that end a UDP flow, and flows kept a scrape; fixed values.
IDLE, TOP = 10, 20
TUPLE = ("iface", "proto", "src_addr", "src_v4", "src_port", "dst_addr", "dst_v4", "dst_port")


def on_interfaces(packets: DataFrame, masks: Iterable[str]) -> DataFrame:
    keep = any_mask(F.col("iface"), masks)
    return packets if keep is None else packets.filter(keep)


def with_flow_start(packets: DataFrame, idle: int = IDLE) -> DataFrame:
    """TCP: a start packet. UDP: the first packet of a tuple, or one after an idle gap."""
    w = Window.partitionBy("host", *TUPLE).orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    udp = F.coalesce(gap >= idle * 1_000_000, F.lit(True))
    start = F.when(F.col("proto") == 6, F.col("tcp_start")).when(F.col("proto") == 17, udp).otherwise(F.lit(False))
    return packets.withColumn("starts", start)


def flows(packets: DataFrame, scrape: str, idle: int = IDLE) -> DataFrame:
    """Bytes, packets and flows of every tuple and scrape.

    The window needs each tuple's packets together; the sums then reuse that partitioning.
    """
    d = with_flow_start(packets, idle)
    return d.groupBy("host", *TUPLE, F.window("ts", scrape).alias("w")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"), F.count_if("starts").cast("bigint").alias("flows")
    )


def flow_totals(packets: DataFrame, scrape: int, idle: int = IDLE) -> DataFrame:
    """What ``flows`` gives, by aggregations alone, so that it runs over a stream (with a watermark
    on ts) and a busy tuple is summed before any shuffle. Both times are whole seconds.

    Packets are first summed in slots no longer than the idle time, inside which no flow can start
    but at the first packet. A scrape then takes its own slots and those of the idle time before
    it: whether a slot starts a flow is told by the packet before.
    """
    slot = f"{gcd(scrape, idle)} seconds"
    us = F.unix_micros("ts")
    d = packets.groupBy("host", *TUPLE, F.window("ts", slot).alias("slot")).agg(
        F.min(us).alias("first"), F.max(us).alias("last"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"), F.count_if("tcp_start").alias("syns")
    )
    reach = F.window("slot", f"{scrape + idle} seconds", f"{scrape} seconds", f"{-idle % scrape} seconds").alias("w")
    d = d.groupBy("host", *TUPLE, reach).agg(F.array_sort(F.collect_list(F.struct("first", "last", "bytes", "packets", "syns"))).alias("slots"))
    start = F.col("w.end") - F.expr(f"interval {scrape} seconds")
    slots = F.transform("slots", lambda s, i: s.withField("before", F.get(F.col("slots"), i - 1)["last"]))
    d = d.withColumn("own", F.filter(slots, lambda s: s["first"] >= F.unix_micros(start))).filter("size(own) > 0")
    total = lambda c: F.aggregate("own", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s[c], F.lit(0).cast("bigint"))).alias(c)
    begun = F.size(F.filter("own", lambda s: s["before"].isNull() | (s["first"] - s["before"] >= idle * 1_000_000))).cast("bigint")
    n = F.when(F.col("proto") == 6, total("syns")).when(F.col("proto") == 17, begun).otherwise(F.lit(0).cast("bigint"))
    return d.select("host", *TUPLE, F.struct(start.alias("start"), F.col("w.end").alias("end")).alias("w"), total("bytes"), total("packets"), n.alias("flows"))


def top_flows(d: DataFrame, n: int = TOP) -> DataFrame:
    """The n largest flows of a host and scrape: bytes, packets, then the tuple, IPv4 first."""
    order: list[Column] = [
        F.desc("bytes"), F.desc("packets"), F.asc("iface"), F.asc("proto"),
        F.desc("src_v4"), F.asc("src_addr"), F.asc("src_port"), F.desc("dst_v4"), F.asc("dst_addr"), F.asc("dst_port"),
    ]
    w = Window.partitionBy("host", "w").orderBy(*order)
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def flow_points(d: DataFrame, src: Column | None = None, dst: Column | None = None) -> DataFrame:
    """Flows to points: the key is interface, protocol and both ends; the time the scrape's end."""
    src = address_text(F.col("src_addr"), F.col("src_v4")) if src is None else src
    dst = address_text(F.col("dst_addr"), F.col("dst_v4")) if dst is None else dst
    key = flow_key(F.col("iface"), F.col("proto"), src, F.col("src_port"), dst, F.col("dst_port"))
    values = {c: F.col(c) for c in ("bytes", "packets", "flows")}
    at = F.col("w.end") - F.expr("interval 1 microsecond")
    d = d.withColumn("ts", at).withColumn("seq", F.lit(0).cast("bigint"))
    return to_points(d, key, values).select("host", "ts", "seq", "key", "var", "raw", "is_percent")


def netflow_pairs(rows: DataFrame) -> DataFrame:
    """Last values of six-part keys, summed by tuple and window. Addresses are made canonical
    first, so that different texts of one address meet."""
    d = rows.filter("agg = 'last'").withColumn("parts", flow_parts(F.col("key"))).filter(F.size("parts") == 6)
    base = ["dt", "dts", "dc", "host", "project", "role", "host_ip"]
    d = d.select(
        *base,
        F.get("parts", F.lit(0)).alias("iface"),
        F.get("parts", F.lit(1)).alias("proto"),
        to_ipv6(F.get("parts", F.lit(2))).alias("src_ip"),
        port_or_zero(F.get("parts", F.lit(3))).alias("src_port"),
        to_ipv6(F.get("parts", F.lit(4))).alias("dst_ip"),
        port_or_zero(F.get("parts", F.lit(5))).alias("dst_port"),
        "var",
        "value",
    )
    total = [F.coalesce(F.sum(F.when(F.col("var") == v, F.col("value"))), F.lit(0)).cast("bigint").alias(v) for v in ("bytes", "packets", "flows")]
    tuple_ = ["iface", "proto", "src_ip", "src_port", "dst_ip", "dst_port"]
    return d.groupBy(*base, *tuple_).agg(*total)


def netflow_job(packets: DataFrame, spec: MetricSpec, masks: Iterable[str] = (), idle: int = IDLE, n: int = TOP) -> DataFrame:
    """Packets to pairs: starts, totals a scrape, the largest, long rows, pairs."""
    d = top_flows(flows(on_interfaces(packets, masks), f"{spec.scrape} seconds", idle), n)
    return netflow_pairs(metric_rows(flow_points(d), spec, ["host"]))
