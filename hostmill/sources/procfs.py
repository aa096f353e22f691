"""Captured procfs texts as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import decimal_or_hex, hex_number, strip
from ..operators.counters import STACK

_SPACE = r"\s+"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\n"), lambda x: F.btrim(x, F.lit(" \t\r\n")))


def _whole(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def proc_sections(df: DataFrame, content: str, ids: Sequence[str]) -> DataFrame:
    """ids, section, field, value of two-line sections.

    Lines go in pairs after blank ones; a shorter line ends the pair, negative values and
    pairs with different names are left out, and a later value of a field wins.
    """
    filled = F.filter(_lines(F.col(content)), lambda x: x != "")
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size(filled) / 2).cast("int") - 1, F.lit(0))),
        lambda k: F.struct(F.split(F.get(filled, 2 * k), _SPACE).alias("h"), F.split(F.get(filled, 2 * k + 1), _SPACE).alias("v")),
    )
    d = df.select(*ids, F.posexplode(F.when(F.size(filled) >= 2, pairs)).alias("at", "p"))
    name = F.regexp_replace(F.get("p.h", F.lit(0)), ":$", "")
    d = d.filter((name != "") & (name == F.regexp_replace(F.get("p.v", F.lit(0)), ":$", "")))
    zipped = F.arrays_zip(F.slice("p.h", 2, 10000).alias("field"), F.slice("p.v", 2, 10000).alias("text"))
    d = d.select(*ids, "at", name.alias("section"), F.inline(zipped).alias("field", "text"))
    d = d.withColumn("value", _whole(F.col("text"))).filter("value IS NOT NULL AND field IS NOT NULL")
    return d.groupBy(*ids, "section", "field").agg(F.max_by("value", "at").alias("value"))


def stack_counters(df: DataFrame, content: str, ids: Sequence[str]) -> DataFrame:
    """ids and the network stack counters, 0 where a text lacks one."""
    sections = proc_sections(df, content, ids)
    found = [
        F.coalesce(F.max(F.when((F.col("section") == s) & (F.col("field") == f), F.col("value"))), F.lit(0)).alias(name)
        for name, (s, f) in STACK.items()
    ]
    return df.select(*ids).distinct().join(sections, list(ids), "left").groupBy(*ids).agg(*found)


#: Counters that a stat capture must have, and the names used here.
STAT = {"ctxt": "ctxt", "intr": "intr", "softirq": "softirq", "processes": "forks", "procs_running": "procs_running", "procs_blocked": "procs_blocked"}


def _captured(df: DataFrame, stat: str, loadavg: str) -> DataFrame:
    values = {}
    for field, name in STAT.items():
        # The last line of a name counts, as a later one replaces an earlier.
        values[name] = _whole(F.regexp_extract(stat, rf"(?s)(?:^|.*\n)[ \t]*{field}[ \t]+(\S+)", 1))
    loads = F.split(F.btrim(F.coalesce(loadavg, F.lit("")), F.lit(" \t\r\n")), _SPACE)
    for k, name in enumerate(("load1", "load5", "load15")):
        values[name] = F.get(loads, F.lit(k)).try_cast("double")
    return df.withColumns(values)


def kernel_snapshots(df: DataFrame, stat: str, loadavg: str) -> DataFrame:
    """The rest of the columns with counters and loads; a capture that lacks one is left out."""
    d = _captured(df, stat, loadavg).drop(stat, loadavg)
    return d.na.drop(subset=[*STAT.values(), "load1", "load5", "load15"])


def kernel_rejects(df: DataFrame, stat: str, loadavg: str) -> DataFrame:
    d = _captured(df, stat, loadavg)
    missing = F.lit(False)
    for name in (*STAT.values(), "load1", "load5", "load15"):
        missing = missing | F.col(name).isNull()
    return d.filter(missing).select(*df.columns)


def tcp_socket_samples(df: DataFrame, content: str, ids: Sequence[str]) -> DataFrame:
    """ids, line, tx_queue, rx_queue, retransmits and cwnd of each socket that doesn't listen."""
    filled = F.filter(_lines(F.col(content)), lambda x: x != "")
    body = F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0)))
    d = df.select(*ids, F.posexplode(body).alias("line", "text")).withColumn("f", F.split("text", _SPACE))
    d = d.filter((F.size("f") >= 7) & (F.upper(F.get("f", F.lit(3))) != "0A"))
    queues = F.split(F.get("f", F.lit(4)), ":", -1)
    d = d.filter(F.size(queues) == 2)
    d = d.select(
        *ids,
        "line",
        hex_number(F.get(queues, F.lit(0))).alias("tx_queue"),
        hex_number(F.get(queues, F.lit(1))).alias("rx_queue"),
        hex_number(F.get("f", F.lit(6))).alias("retransmits"),
        F.coalesce(decimal_or_hex(F.get("f", F.size("f") - 2)), F.lit(0)).alias("cwnd"),
    )
    return d.na.drop(subset=["tx_queue", "rx_queue", "retransmits"])


#: Sockets summed a scrape, at most; 0 turns the point off. A fixed value.
SOCKETS = 2000


def tcp_cc_points(sockets: DataFrame, scrapes: DataFrame, n: int = SOCKETS) -> DataFrame:
    """host, ts and points of the n busiest sockets a scrape, under the key ``cc:<algo>``.

    scrapes has host, ts and algo; one without sockets still gives zeros. Ties in queues,
    retransmits and window go by the send queue.
    """
    from ..operators.points import to_points

    if n == 0:
        scrapes = scrapes.filter(F.lit(False))
    busy = F.col("tx_queue") + F.col("rx_queue")
    w = Window.partitionBy("host", "ts").orderBy(busy.desc(), F.desc("retransmits"), F.desc("cwnd"), F.desc("tx_queue"))
    top = sockets.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(n, 1))
    d = top.groupBy("host", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tx_queue").alias("tx"), F.sum("rx_queue").alias("rx"),
        F.sum("retransmits").alias("retrans"), F.floor(F.sum("cwnd") / F.count(F.lit(1))).alias("cwnd"),
    )
    d = scrapes.join(d, ["host", "ts"], "left").na.fill(0, ["n", "tx", "rx", "retrans", "cwnd"])
    algo = strip(F.coalesce("algo", F.lit("")))
    key = F.concat(F.lit("cc:"), F.when(algo == "", F.lit("unknown")).otherwise(algo))
    values = {
        "tcp_sockets": F.col("n"),
        "tcp_tx_queue_bytes": F.col("tx"),
        "tcp_rx_queue_bytes": F.col("rx"),
        "tcp_retrans_pending": F.col("retrans"),
        "tcp_cwnd_segs": F.col("cwnd"),
    }
    return to_points(d, key, values).select("host", "ts", "key", "var", "raw", "is_percent")
