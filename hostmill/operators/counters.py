"""Cumulative counters of successive scrapes: deltas, rates, and the metrics made from them.

A counter row is matched to the same entity in the scrape just before it on that host; an
entity that scrape lacks has no previous row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import average_or_zero, device_path, is_base_disk
from .points import to_points
from .window import joined


def with_previous(
    snapshots: DataFrame, counters: Sequence[str], entity: Sequence[str], host: str = "host", ts: str = "ts", scrapes: DataFrame | None = None
) -> DataFrame:
    """Adds prev_<counter> (null without a previous row) and seconds since the host's scrape before.

    Scrapes are numbered per host from its different times alone; a large host's rows are
    then spread by entity. ``scrapes`` has the times where the snapshots were filtered: a scrape
    of which no row is left is still the one before the next.
    """
    times = (snapshots if scrapes is None else scrapes).select(host, ts).distinct()
    w = Window.partitionBy(host).orderBy(ts)
    times = times.withColumn("scrape_no", F.row_number().over(w)).withColumn("before", F.lag(ts).over(w))
    d = joined(snapshots, times, [host, ts])  # a host may be null
    e = Window.partitionBy(host, *entity).orderBy(ts)
    near = F.lag("scrape_no").over(e) == F.col("scrape_no") - 1
    d = d.withColumn("has_prev", F.coalesce(near, F.lit(False)))
    d = d.withColumns({f"prev_{c}": F.when(F.col("has_prev"), F.lag(c).over(e)) for c in counters})
    gone = (F.unix_micros(ts) - F.unix_micros("before")) / F.lit(1e6)
    return d.withColumn("seconds", F.coalesce(F.greatest(gone, F.lit(0.0)), F.lit(0.0))).drop("before", "scrape_no")


def delta(counter: str) -> Column:
    """Growth since the previous scrape: 0 after a reset and without a previous row."""
    return F.coalesce(F.greatest(F.col(counter) - F.col(f"prev_{counter}"), F.lit(0)), F.lit(0))


def rate(change: Column) -> Column:
    return F.when(F.col("seconds") > 0, F.floor(change / F.col("seconds"))).otherwise(F.lit(0))


DISK = ("read_count", "write_count", "read_bytes", "write_bytes", "read_time", "write_time", "io_time", "weighted_io")


def disk_points(snapshots: DataFrame) -> DataFrame:
    """host, ts, device, the DISK counters and inflight to points of base disks."""
    return disk_values(with_previous(snapshots.filter(is_base_disk(F.col("device"))), DISK, ["device"], scrapes=snapshots))


def disk_values(d: DataFrame) -> DataFrame:
    """The points of rows that have their previous counters and seconds."""
    reads, writes, ms = delta("read_count"), delta("write_count"), F.col("seconds") * 1000
    read_time, write_time = delta("read_time"), delta("write_time")
    return to_points(
        d.select("host", "ts", "device", "inflight", "seconds", *DISK, *[f"prev_{c}" for c in DISK]),
        device_path(F.col("device")),
        {
            "rx_io": rate(reads),
            "tx_io": rate(writes),
            "rx_bytes": delta("read_bytes"),
            "tx_bytes": delta("write_bytes"),
            "rx_bytes_per_sec": rate(delta("read_bytes")),
            "tx_bytes_per_sec": rate(delta("write_bytes")),
            "rx_await": average_or_zero(read_time, reads),
            "tx_await": average_or_zero(write_time, writes),
            "await": average_or_zero(read_time + write_time, reads + writes),
            "qdepth": F.when(ms > 0, delta("weighted_io") / ms).otherwise(F.lit(0.0)),
            "util": F.when(ms > 0, delta("io_time") / ms * 100).otherwise(F.lit(0.0)),
            "inflight": F.col("inflight"),
        },
        percents=("util",),
    ).select("host", "ts", "key", "var", "raw", "is_percent")


NET = ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "errin", "errout", "dropin", "dropout")


def net_iface_points(snapshots: DataFrame) -> DataFrame:
    """host, ts, iface and the NET counters to points by interface."""
    return net_iface_values(with_previous(snapshots, NET, ["iface"]))


def net_iface_values(d: DataFrame) -> DataFrame:
    return to_points(
        d,
        F.col("iface"),
        {
            "tx_bytes": delta("bytes_sent"),
            "rx_bytes": delta("bytes_recv"),
            "tx_bytes_per_sec": rate(delta("bytes_sent")),
            "rx_bytes_per_sec": rate(delta("bytes_recv")),
            "tx_pkt": rate(delta("packets_sent")),
            "rx_pkt": rate(delta("packets_recv")),
            "rx_err": delta("errin"),
            "tx_err": delta("errout"),
            "rx_drop": delta("dropin"),
            "tx_drop": delta("dropout"),
        },
    ).select("host", "ts", "key", "var", "raw", "is_percent")


#: Point names and the procfs section and field that each is read from.
STACK = {
    "tcp_active_opens": ("Tcp", "ActiveOpens"),
    "tcp_passive_opens": ("Tcp", "PassiveOpens"),
    "tcp_retrans_segs": ("Tcp", "RetransSegs"),
    "tcp_timeouts": ("TcpExt", "TCPTimeouts"),
    "tcp_out_rsts": ("Tcp", "OutRsts"),
    "udp_in_datagrams": ("Udp", "InDatagrams"),
    "udp_out_datagrams": ("Udp", "OutDatagrams"),
    "udp_in_errors": ("Udp", "InErrors"),
    "udp_no_ports": ("Udp", "NoPorts"),
    "udp_rcvbuf_errors": ("Udp", "RcvbufErrors"),
    "udp_sndbuf_errors": ("Udp", "SndbufErrors"),
}


def net_stack_points(counters: DataFrame) -> DataFrame:
    """host, ts and the STACK counters to deltas under the key total."""
    return net_stack_values(with_previous(counters, list(STACK), []))


def net_stack_values(d: DataFrame) -> DataFrame:
    return to_points(d, F.lit("total"), {name: delta(name) for name in STACK}).select("host", "ts", "key", "var", "raw", "is_percent")


KERNEL = ("ctxt", "intr", "softirq", "forks")


def kernel_points(snapshots: DataFrame) -> DataFrame:
    """host, ts, loads, running and blocked processes and the KERNEL counters to one point."""
    return kernel_values(with_previous(snapshots, KERNEL, []))


def kernel_values(d: DataFrame) -> DataFrame:
    gauges = {c: F.col(c) for c in ("load1", "load5", "load15", "procs_running", "procs_blocked")}
    rates = {f"{c}_per_sec": rate(delta(c)) for c in KERNEL}
    return to_points(d, F.lit("total"), gauges | rates).select("host", "ts", "key", "var", "raw", "is_percent")


PROCESS = ("reads", "writes")


def process_points(snapshots: DataFrame) -> DataFrame:
    """host, ts, pid, name, cpu_util, rss, ram_total, reads and writes to points by name.

    Processes of one name give one sample each, in order of pid (``seq``). Unreadable I/O
    counters count as 0.
    """
    return process_values(with_previous(named_processes(snapshots), PROCESS, ["pid"], scrapes=snapshots))


def named_processes(snapshots: DataFrame) -> DataFrame:
    return readable_io(snapshots).filter(F.coalesce("name", F.lit("")) != "")


def readable_io(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumns({c: F.coalesce(c, F.lit(0)) for c in PROCESS})


def process_values(d: DataFrame) -> DataFrame:
    d = d.withColumn("seq", F.col("pid").cast("bigint"))
    ram = F.when(F.col("ram_total") > 0, F.col("rss") / F.col("ram_total") * 100).otherwise(F.lit(0.0))
    values = {"cpu_util": F.col("cpu_util"), "ram_util": ram, "iops": rate(delta("reads") + delta("writes"))}
    return to_points(d, F.col("name"), values, percents=("cpu_util", "ram_util")).select("host", "ts", "seq", "key", "var", "raw", "is_percent")
