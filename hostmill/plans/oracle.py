"""The registered queries as SQL over the given tables, written apart from the operators."""

from __future__ import annotations

_V1 = """v1 AS (
  SELECT concat('h', user_id % 8) AS host, event_type AS key, 'value' AS var, value AS raw, false AS pct, ts, event_id AS seq FROM events
  UNION ALL
  SELECT concat('h', user_id % 8), event_type, 'k_util', CAST(json_extract_string(props, '$.k') AS DOUBLE), true, ts, event_id FROM events)"""


def _norm(x: str, pct: str = "pct") -> str:
    return f"TRY_CAST(CASE WHEN {pct} THEN least(round(greatest({x}, 0)), 100) ELSE round(greatest({x}, 0)) END AS BIGINT)"


def _rank(p: int) -> str:
    return f"list_sort(list(raw))[greatest(1, ceil({p} / 100::DOUBLE * count(*)))::INT]"


def _agg(send: str, pcts: tuple[int, ...], source: str = "v1", first: str = "min") -> str:
    """CTE ``a``: host, key, var, dts, n, last, pXX, raw_max and the worker's dt."""
    p = "".join(f", CASE WHEN count(*) < 4 THEN 0::BIGINT ELSE {_norm(_rank(x), 'bool_or(pct)')} END AS p{x}" for x in pcts)
    return f"""g AS (
  SELECT host, key, var, epoch(w)::BIGINT + epoch(INTERVAL '{send}')::BIGINT AS dts, count(*) AS n, bool_or(pct) AS pct,
         {_norm('arg_max(raw, row(ts, seq))', 'bool_or(pct)')} AS last, max(raw) AS raw_max, {first}(ts) AS first_ts{p}
  FROM (SELECT *, time_bucket(INTERVAL '{send}', ts, TIMESTAMP '1970-01-01') AS w FROM {source}) GROUP BY host, key, var, w),
a AS (
  SELECT *, CASE WHEN m // 1000 >= dts THEN (dts - 1) * 1000 ELSE m END AS dt
  FROM (SELECT *, floor(epoch_us(min(first_ts) OVER (PARTITION BY host, dts)) / 1000)::BIGINT AS m FROM g))"""


_A = f"WITH {_V1}, {_agg('6 hours', (50, 90, 99))}"
_LONG = _A + """, r AS (
  SELECT host, key, var, dt, dts, unnest(['last', 'p50', 'p90', 'p99']) AS agg, unnest([last, p50, p90, p99]) AS value FROM a)"""

_HALF = f"""WITH {_V1}, half AS (SELECT * REPLACE (CASE WHEN var = 'value' OR host IN ('h0', 'h2', 'h4', 'h6') THEN var ELSE 'other' END AS var) FROM v1), {_agg('6 hours', (), 'half')}"""
_EV = _HALF + """, e AS (
  SELECT host, key, dts, max(CASE WHEN var = 'value' THEN last END) AS v, max(CASE WHEN var = 'k_util' THEN last END) AS k FROM a GROUP BY 1, 2, 3)"""


def _dropped(condition: str) -> str:
    return _EV + f" SELECT host, key, count(*)::BIGINT AS n FROM e WHERE NOT coalesce({condition}, false) GROUP BY 1, 2"


_V2 = """v2 AS (
  SELECT host, entity, d, CAST(sum(b) OVER w AS BIGINT) AS bytes, CAST(sum(c) OVER w AS BIGINT) AS cnt
  FROM (SELECT concat('h', user_id // 8) AS host, event_type AS entity, CAST(extract(day FROM ts) AS INT) AS d,
               CAST(sum(floor(value * 100)) AS BIGINT) AS b, count(*) AS c FROM events GROUP BY 1, 2, 3)
  WHERE (d + length(entity)) % 7 <> 0
  WINDOW w AS (PARTITION BY host, entity, CASE WHEN d < 16 THEN 0 ELSE 1 END ORDER BY d))"""


def _deltas(name: str, where: str, source: str = "v2") -> str:
    """CTEs ``sc`` and ``x``: delta db of bytes and dc of cnt, and the seconds s, per ``name``."""
    return f"""WITH {_V2},
vs AS (SELECT host, d, '' AS entity, max(bytes) AS bytes, max(cnt) AS cnt FROM v2 GROUP BY 1, 2),
own AS (SELECT *, {name} AS name FROM {source} WHERE {where}),
sc AS (SELECT host, d, row_number() OVER (PARTITION BY host ORDER BY d) AS i, (d - lag(d) OVER (PARTITION BY host ORDER BY d)) * 86400 AS s
       FROM (SELECT DISTINCT host, d FROM v2)),
y AS (SELECT own.*, sc.i, coalesce(sc.s, 0) AS s, lag(sc.i) OVER e AS pi, lag(bytes) OVER e AS pb, lag(cnt) OVER e AS pc
      FROM own JOIN sc USING (host, d) WINDOW e AS (PARTITION BY host, name ORDER BY d)),
x AS (SELECT host, name, entity, d * 86400 AS at_s, s, CASE WHEN pi = i - 1 THEN greatest(bytes - pb, 0) ELSE 0 END AS db,
             CASE WHEN pi = i - 1 THEN greatest(cnt - pc, 0) ELSE 0 END AS dc FROM y)"""


def _rate(x: str) -> str:
    return f"CASE WHEN s > 0 THEN floor({x} / s) ELSE 0 END"


def _points(cte: str, key: str, values: dict[str, str], source: str = "x", percents: tuple[str, ...] = ()) -> str:
    parts = [
        f"SELECT host, at_s::BIGINT AS at_s, {key} AS key, '{v}' AS var, round(({e})::DOUBLE, 6) AS raw, {'true' if v in percents else 'false'} AS is_percent FROM {source}"
        for v, e in values.items()
    ]
    return cte + " " + " UNION ALL ".join(parts)


# Counters take cnt and bytes in turn, in the order the operator lists them; those of disks
# also one more time for each place in that order.
_DISK = {
    "rx_io": _rate("dc"), "tx_io": _rate("(2 * db)"), "rx_bytes": "3 * dc", "tx_bytes": "4 * db", "rx_bytes_per_sec": _rate("(3 * dc)"), "tx_bytes_per_sec": _rate("(4 * db)"),
    "rx_await": "CASE WHEN dc > 0 THEN 5 * dc / dc ELSE 0 END", "tx_await": "CASE WHEN db > 0 THEN 6 * db / (2 * db) ELSE 0 END",
    "await": "CASE WHEN dc + db > 0 THEN (5 * dc + 6 * db) / (dc + 2 * db) ELSE 0 END", "qdepth": "CASE WHEN s > 0 THEN 8 * db / (s * 1000.0::DOUBLE) ELSE 0 END",
    "util": "CASE WHEN s > 0 THEN 7 * dc / (s * 1000.0::DOUBLE) * 100 ELSE 0 END", "inflight": "1",
}
_NET = {
    "tx_bytes": "dc", "rx_bytes": "db", "tx_bytes_per_sec": _rate("dc"), "rx_bytes_per_sec": _rate("db"), "tx_pkt": _rate("dc"), "rx_pkt": _rate("db"),
    "rx_err": "dc", "tx_err": "db", "rx_drop": "dc", "tx_drop": "db",
}
_STACK = (
    "tcp_active_opens", "tcp_passive_opens", "tcp_retrans_segs", "tcp_timeouts", "tcp_out_rsts", "udp_in_datagrams", "udp_out_datagrams",
    "udp_in_errors", "udp_no_ports", "udp_rcvbuf_errors", "udp_sndbuf_errors",
)
_KERNEL = {
    "load1": "0.5", "load5": "1", "load15": "2", "procs_running": "3", "procs_blocked": "0", "ctxt_per_sec": _rate("dc"), "intr_per_sec": _rate("db"),
    "softirq_per_sec": _rate("dc"), "forks_per_sec": _rate("db"),
}

_V5 = """v5 AS (SELECT concat('h', user_id // 8) AS host, CAST(extract(day FROM ts) AS INT) AS d, concat('app_', event_type) AS name, floor(value) AS v
  FROM events WHERE event_type <> 'error')"""

_V3 = """v3 AS (
  SELECT concat('h', l_suppkey % 3) AS host, concat('eth', l_suppkey % 2) AS iface, CASE WHEN l_linenumber % 2 = 0 THEN 6 ELSE 17 END AS proto,
         concat('10.0.0.', l_suppkey % 5) AS src_ip, (40000 + l_partkey % 3)::INT AS src_port, concat('10.0.1.', l_partkey % 2) AS dst_ip, 443 AS dst_port,
         CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_returnflag = 'R' AND l_linestatus <> 'F' AS syn,
         (l_orderkey * 7919 + l_partkey * 104729) % 86400 AS t, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem),
st AS (SELECT *, CASE WHEN proto = 6 THEN syn ELSE coalesce(t - lag(t) OVER (PARTITION BY host, iface, proto, src_ip, src_port, dst_ip, dst_port ORDER BY t, seq) >= 10, true) END AS starts FROM v3),
fl AS (SELECT host, t // 300 * 300 AS at_s, iface, proto, src_ip, src_port, dst_ip, dst_port, sum(bytes)::BIGINT AS bytes, count(*)::BIGINT AS packets,
              count(*) FILTER (starts)::BIGINT AS n_flows FROM st GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY host, at_s ORDER BY bytes DESC, packets DESC, iface, proto, src_ip, src_port, dst_ip, dst_port)::INT AS place FROM fl),
top AS (SELECT *, concat(iface, '|', CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END, '|', src_ip, '|', src_port, '|', dst_ip, '|', dst_port) AS key FROM tp WHERE place <= 20)"""
_PAIRS = _V3 + """,
pr AS (SELECT host, (at_s // 3600 + 1) * 3600 AS dts, iface, CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END AS proto, concat('::ffff:', src_ip) AS src_ip, src_port,
              concat('::ffff:', dst_ip) AS dst_ip, dst_port, arg_max(bytes, at_s) AS bytes, arg_max(packets, at_s) AS packets, arg_max(n_flows, at_s) AS n_flows
       FROM top GROUP BY ALL)"""

_ORDERS = """o AS (
  SELECT CASE WHEN k % 7 = 0 THEN 'stopped' ELSE k::VARCHAR END AS key, CASE WHEN k % 11 = 0 THEN 'p50' ELSE 'last' END AS agg, k % 50 = 0 AS bad_dt,
         k % 13 = 0 AS bad_ip, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS metric
  FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0))"""


def oracle_sql() -> dict[str, str]:
    last_only = f"WITH {_V1}, {_agg('6 hours', ())}"
    found = {
        "window_last_pct": _A + " SELECT host, key, var, dts, last, p50, p90, p99 FROM a",
        "window_large_series": f"WITH {_V1}, vb AS (SELECT * REPLACE ('h' AS host, 'all' AS key) FROM v1), {_agg('60 days', (50, 90, 99), 'vb')}" + " SELECT host, key, var, dts, n::BIGINT AS n, last, p50, p90, p99 FROM a",
        "window_last_only": last_only + " SELECT host, key, var, dts, last FROM a",
        "window_zero_fill": f"""WITH {_V1}, {_agg('1 hour', (50,))},
            k AS (SELECT host, key, var, min(dts) AS f FROM a GROUP BY 1, 2, 3), t AS (SELECT host, max(dts) AS t FROM a GROUP BY 1),
            grid AS (SELECT host, key, var, unnest(range(f, t + 1, 3600)) AS dts FROM k JOIN t USING (host))
            SELECT host, key, var, dts, coalesce(n, 0)::BIGINT AS n, coalesce(last, 0)::BIGINT AS last, coalesce(p50, 0)::BIGINT AS p50
            FROM grid LEFT JOIN a USING (host, key, var, dts)""",
        "window_dt": last_only + " SELECT host, dts, min(dt) AS dt, max(dt) AS dt_max FROM a GROUP BY 1, 2",
        "flatten_rows": _LONG + " SELECT host, key, var, agg, value, dt, dts FROM r",
        "filter_drop_vars": f"WITH {_V1} SELECT host, var, count(*)::BIGINT AS n FROM v1 WHERE var = 'value' GROUP BY 1, 2",
        "drop_event_key": _dropped("NOT contains(key, 'i')"),
        "drop_event_var": _dropped("k IS NOT NULL"),
        "drop_event_numeric": _dropped("v > 60 OR (k IS NOT NULL AND k < 20)"),
        "process_threshold": last_only + """ , b AS (SELECT host, key, dts, max(CASE WHEN var = 'value' THEN raw_max END) AS v, max(CASE WHEN var = 'k_util' THEN raw_max END) AS k
            FROM a GROUP BY 1, 2, 3)
            SELECT host, key, sum(2)::BIGINT AS n, min(dts) AS first FROM b WHERE v >= 150 OR k >= 95 GROUP BY 1, 2""",
        "json_points": """WITH g AS (SELECT * FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0)
            SELECT event_id, event_type AS key, 'value' AS var, value AS raw, false AS is_percent FROM g
            UNION ALL SELECT event_id, event_type, 'util', CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), true FROM g
            UNION ALL SELECT event_id, event_type, 'flag', 1.0, false FROM g""",
        "json_rejects": "SELECT event_id FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0",
        "prom_points": f"WITH {_V5} SELECT host, d, 'total' AS key, name AS var, sum(v)::DOUBLE AS raw, false AS is_percent FROM v5 GROUP BY ALL",
        "prom_short": f"WITH {_V5} SELECT host, d, substr(name, 5) AS var, sum(v)::DOUBLE AS raw FROM v5 GROUP BY ALL",
        "prom_type_asof": f"WITH {_V5} SELECT name, count(*)::BIGINT AS n, min(v)::DOUBLE AS least FROM v5 GROUP BY ALL",
        "disk_rates": _points(_deltas("concat('sd', substr(entity, 1, 1))", "d % 6 <> 0"), "concat('/dev/', name)", _DISK, percents=("util",)),
        "net_rates": _points(_deltas("entity", "true"), "name", _NET),
        "net_stack": _points(_deltas("entity", "true", "vs"), "'total'", {n: "db" if k % 2 else "dc" for k, n in enumerate(_STACK)}),
        "kernel_rates": _points(_deltas("entity", "true", "vs"), "'total'", _KERNEL),
        "process_iops": "",
        "base_disks": f"""WITH {_V2} SELECT concat('/dev/', dev) AS key, count(*)::BIGINT AS n
            FROM (SELECT ['sda', 'sda1', 'nvme0n1', 'loop0', 'dm-0'][length(entity) % 5 + 1] AS dev FROM v2) WHERE dev NOT IN ('sda1', 'loop0') GROUP BY 1""",
        "cpu_points": f"""WITH {_V2} SELECT host, (d * 86400)::BIGINT AS at_s, CASE WHEN entity = 'view' THEN 'total' ELSE concat('core', length(entity)) END AS key, 'util' AS var,
            (cnt % 101)::DOUBLE AS raw, true AS is_percent FROM v2""",
        "ram_swap_points": f"""WITH {_V2}, u AS (SELECT host, (d * 86400)::BIGINT AS at_s, cnt AS used, CASE WHEN d % 4 = 0 THEN 0 ELSE bytes END AS total FROM (SELECT host, d, max(bytes) AS bytes, max(cnt) AS cnt FROM v2 GROUP BY 1, 2)),
            m AS (SELECT host, at_s, unnest(['total', 'used', 'util', 'free']) AS var, unnest([total, used, CASE WHEN total > 0 THEN used / total * 100 ELSE 0 END, total - used]) AS raw FROM u)
            SELECT host, at_s, 'total' AS key, var, round(raw::DOUBLE, 6) AS raw, var = 'util' AS is_percent, 'ram' AS "of" FROM m
            UNION ALL SELECT host, at_s, 'total', var, round(raw::DOUBLE, 6), var = 'util', 'swap' FROM m WHERE var <> 'free'""",
        "fs_points": f"""WITH {_V2}, u AS (SELECT host, (d * 86400)::BIGINT AS at_s, concat('/', entity) AS key, d, bytes, cnt FROM v2 WHERE d % 9 <> 0),
            m AS (SELECT host, at_s, key, unnest(['total', 'used', 'free', 'avail', 'util', 'inodes_total', 'inodes_used', 'inodes_free', 'inodes_util', 'readonly']) AS var,
                  unnest([bytes, cnt, bytes - cnt, bytes - cnt, cnt % 100, 10, 4, 6, CASE WHEN d % 5 = 0 THEN 0 ELSE cnt % 100 END, CASE WHEN cnt % 2 = 0 THEN 0 ELSE 1 END]) AS raw FROM u)
            SELECT host, at_s, key, var, raw::DOUBLE AS raw, var IN ('util', 'inodes_util') AS is_percent FROM m""",
        "proc_sections": f"""WITH {_V2} SELECT host, entity, d, unnest(['Tcp', 'Tcp', 'Udp']) AS section, unnest(['ActiveOpens', 'RetransSegs', 'InDatagrams']) AS field,
            unnest([bytes, cnt, cnt]) AS value FROM v2""",
        "kernel_capture": f"""WITH {_V2} SELECT host, entity, d, cnt AS ctxt, bytes AS intr, 7::BIGINT AS softirq, cnt AS forks, 2::BIGINT AS procs_running, 0::BIGINT AS procs_blocked,
            0.5::DOUBLE AS load1, 2.0::DOUBLE AS load15 FROM v2 WHERE d % 5 <> 0""",
        "kernel_rejects": f"WITH {_V2} SELECT host, entity, d FROM v2 WHERE d % 5 = 0",
        "prometheus_rejects": "SELECT DISTINCT concat('h', user_id // 8) AS host, CAST(extract(day FROM ts) AS INT) AS d FROM events WHERE extract(day FROM ts) % 7 = 0",
        "tcp_cc": f"""WITH {_V2}, s AS (
              SELECT host, d, cnt + k AS tx, bytes % 1000 AS rx, k AS retrans, cnt AS cwnd
              FROM v2, (SELECT unnest([1, 3]) AS k), (SELECT unnest([1, 2]) AS copy)),
            t AS (SELECT *, row_number() OVER (PARTITION BY host, d ORDER BY tx + rx DESC, retrans DESC, cwnd DESC, tx DESC) AS place FROM s),
            m AS (SELECT host, d, count(*) AS n, sum(tx) AS tx, sum(rx) AS rx, sum(retrans) AS re, sum(cwnd) // count(*) AS cw FROM t WHERE place <= 5 GROUP BY 1, 2)
            SELECT host, (d * 86400)::BIGINT AS at_s, CASE WHEN d % 2 = 1 THEN 'cc:cubic' ELSE 'cc:unknown' END AS key,
              unnest(['tcp_sockets', 'tcp_tx_queue_bytes', 'tcp_rx_queue_bytes', 'tcp_retrans_pending', 'tcp_cwnd_segs']) AS var,
              unnest([n, tx, rx, re, cw])::DOUBLE AS raw, false AS is_percent FROM m""",
        "flows_topn": f"WITH {_V3} SELECT host, at_s, key, bytes, packets, n_flows, place FROM top",
        "packets_from_frames": """SELECT concat('h', l_suppkey % 3) AS host, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 5 = 0 THEN 6 ELSE 17 END AS proto,
              CASE WHEN l_orderkey % 5 = 2 THEN concat(repeat('0', 31), '1') ELSE concat(repeat('0', 24), '0a000001') END AS src,
              CASE WHEN l_orderkey % 5 = 2 THEN concat(repeat('0', 31), '2') ELSE concat(repeat('0', 24), '0a000102') END AS dst,
              (40000 + l_partkey % 3)::INT AS src_port, 443 AS dst_port,
              (CASE l_orderkey % 5 WHEN 0 THEN 40 WHEN 1 THEN 28 ELSE 56 END)::BIGINT AS bytes, l_orderkey % 5 = 0 AND l_returnflag = 'R' AS tcp_start
            FROM lineitem WHERE l_orderkey % 5 IN (0, 1, 2)""",
        "netflow_pairs": f"WITH {_PAIRS} SELECT host, dts, iface, proto, src_ip, src_port, dst_ip, dst_port, bytes, packets, n_flows FROM pr",
        "pair_lookup": f"""WITH {_PAIRS} SELECT host, dts, src_ip, bytes, packets FROM pr WHERE host = 'h1' AND proto = 'tcp' AND src_port = 40001 AND dst_port = 443 AND iface = 'eth0'
            AND src_ip = '::ffff:10.0.0.1' AND dst_ip = '::ffff:10.0.1.1' ORDER BY dts DESC LIMIT 1""",
        "pair_search": f"WITH {_PAIRS} SELECT count(*)::BIGINT AS n FROM pr WHERE (src_port = 40001 OR dst_port = 40001) AND proto = 'udp' AND bytes > 0 AND packets > 0",
        "latest_value": _LONG + " SELECT host, key, var, agg, value, dts FROM r WHERE host = 'h1' AND key = 'click' AND var = 'value' AND agg = 'p90' ORDER BY dts DESC LIMIT 1",
        "latest_values": _LONG + " SELECT host, key, var, agg, arg_max(value, dts) AS value, max(dts) AS dts FROM r GROUP BY 1, 2, 3, 4",
        "recent_rows": _LONG + " SELECT host, key, value, dt FROM r WHERE var = 'value' AND agg = 'last' ORDER BY dt DESC, host, key, var LIMIT 50",
        "delivery_audit": f"""WITH {_ORDERS}, s AS (SELECT count(DISTINCT key) FILTER (agg = 'last' AND key <> 'stopped')::BIGINT AS delivered,
              count(*) FILTER (agg = 'last' AND key <> 'stopped')::BIGINT AS rows_last, count(*)::BIGINT AS rows_total, count(*) FILTER (bad_dt)::BIGINT AS bad_dt,
              count(*) FILTER (bad_ip)::BIGINT AS bad_ip FROM o)
            SELECT e.n AS expected, s.*, delivered = e.n AS complete, rows_last > e.n AS duplicates FROM s, (SELECT count(*)::BIGINT AS n FROM orders) e""",
        "dt_audit": f"WITH {_ORDERS} SELECT metric, count(*)::BIGINT AS n, count(*) FILTER (bad_dt)::BIGINT AS bad_dt FROM o GROUP BY 1",
        "non_last_audit": f"WITH {_ORDERS} SELECT metric, count(*) FILTER (agg <> 'last')::BIGINT AS not_last FROM o GROUP BY 1",
        "host_ip_audit": f"WITH {_ORDERS} SELECT metric, count(*) FILTER (bad_ip)::BIGINT AS no_host_ip FROM o GROUP BY 1",
        "throughput": _LONG + " SELECT var AS metric, count(*)::BIGINT AS n, round(count(*) / 45::DOUBLE, 2) AS rows_per_s FROM r GROUP BY ROLLUP (var)",
        "retention_keep": "SELECT o_orderkey AS k FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '1997-02-28 12:00:00'",
        "route_roundtrip": _LONG + """ SELECT key AS metric, host, agg, count(*)::BIGINT AS n, sum(value)::BIGINT AS total FROM r
            WHERE key = 'click' AND dt // 86400000 BETWEEN epoch(DATE '2024-01-03')::BIGINT // 86400 AND epoch(DATE '2024-01-20')::BIGINT // 86400 GROUP BY 1, 2, 3""",
        "fan_out_parity": _LONG + " SELECT unnest(['one', 'two']) AS target, n, n > 0 AS parity FROM (SELECT count(*)::BIGINT AS n FROM r)",
        "stream_window": f"""WITH {_V1}, {_agg('1 day', (50, 90))}, m AS (SELECT epoch_us(max(ts)) / 1000000 AS at_s FROM events)
            SELECT host, key, var, dts, dt, n::BIGINT AS n, last, p50, p90 FROM a, m WHERE dts <= m.at_s""",
        "stream_zero_fill": f"""WITH {_V1}, {_agg('6 hours', ())}, m AS (SELECT epoch_us(max(ts)) / 1000000 AS at_s FROM events), c AS (SELECT a.* FROM a, m WHERE dts <= m.at_s),
            k AS (SELECT host, key, var, min(dts) AS f FROM c GROUP BY 1, 2, 3),
            grid AS (SELECT host, key, var, unnest(range(f, floor(at_s)::BIGINT + 1, 21600)) AS dts FROM k, m)
            SELECT host, key, var, dts, coalesce(n, 0)::BIGINT AS n, coalesce(last, 0)::BIGINT AS last FROM grid LEFT JOIN c USING (host, key, var, dts)""",
        "stream_udp_flows": f"""WITH {_V3}, u AS (SELECT *, sum(starts::INT) OVER (PARTITION BY host, iface, src_ip, src_port, dst_ip, dst_port ORDER BY t, seq) AS f FROM st WHERE proto = 17),
            s AS (SELECT host, iface, src_port, src_ip, dst_ip, count(*)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes, min(t)::BIGINT AS start, max(t) AS stop
                  FROM u GROUP BY host, iface, src_port, src_ip, dst_ip, f)
            SELECT host, iface, src_port, packets, bytes, start, concat(repeat('0', 24), '0A00000', right(src_ip, 1)) AS src, concat(repeat('0', 24), '0A00010', right(dst_ip, 1)) AS dst
            FROM s WHERE stop + 10 <= (SELECT max(t) FROM v3 WHERE proto = 17)""",
    }
    found |= _more()
    found["stream_silent_worker"] = f"""WITH {_V1}, vq AS (SELECT * REPLACE (CASE WHEN host = 'h3' AND ts >= TIMESTAMP '2024-01-15' THEN 'h4' ELSE host END AS host) FROM v1),
        {_agg('6 hours', (), 'vq')}, {_CLOSED}, c AS (SELECT a.*, at_s FROM a, m WHERE dts <= m.at_s),
        k AS (SELECT *, least(lead(dts) OVER (PARTITION BY host, key, var ORDER BY dts) - 21600, dts + 432000, floor(at_s)::BIGINT) AS t FROM c),
        grid AS (SELECT host, key, var, unnest(range(dts, t + 1, 21600)) AS dts FROM k)
        SELECT host, key, var, dts, coalesce(n, 0)::BIGINT AS n, coalesce(last, 0)::BIGINT AS last FROM grid LEFT JOIN c USING (host, key, var, dts)"""
    found["stream_netflow"] = f"""WITH {_PAIRS} SELECT host, dts, iface, proto, src_ip, src_port, dst_ip, dst_port, bytes, packets, n_flows
        FROM pr WHERE dts < (SELECT max(at_s) + 300 FROM top WHERE at_s + 300 <= (SELECT max(t) FROM v3))"""
    found["process_iops"] = (
        _deltas("ascii(entity)", "true")
        + f""", p AS (SELECT host, at_s, substr(entity, 1, 1) AS key, unnest(['cpu_util', 'ram_util', 'iops']) AS var, unnest([5, 25 / 200 * 100, {_rate("(dc + db)")}])::DOUBLE AS raw FROM x)
        SELECT host, at_s::BIGINT AS at_s, key, var, round(raw, 6) AS raw, var <> 'iops' AS is_percent FROM p"""
    )
    found |= {"stored_recent": found["recent_rows"], "stored_latest": found["latest_value"], "ten_definitions": _definitions()}
    for name in ("net_rates", "net_stack", "kernel_rates", "process_iops"):
        found[f"stream_{name}"] = found[name]
    return found


def _definitions() -> str:
    """Rows of each definition of ``ten_definitions``, one after the other."""
    parts = []

    def add(name, hours, pcts, first="min", where="true", cte="", source="a"):
        values = ["last", *[f"p{p}" for p in pcts]]
        parts.append(f"""(WITH {_V1}, {_agg(f"{hours} hours", pcts, first=first)}{cte} SELECT '{name}' AS instance, host, key, var, unnest({values}) AS agg, unnest([{', '.join(values)}])::BIGINT AS value, dt, dts
            FROM {source} WHERE {where})""")

    for k, hours in enumerate((6, 8, 12, 24)):
        add(f"p{k}", hours, (50, 90) if k % 2 else (99,), where="var = 'value'" if k == 3 else "true")
        add(f"l{k}", hours, (), "max", "var = 'value'" if k == 2 else "true")
    good = ", good AS (SELECT host, key, dts FROM a WHERE key <> 'error' GROUP BY 1, 2, 3 HAVING max(CASE WHEN var = 'value' THEN raw_max END) >= 100)"
    add("t", 6, (50,), cte=good, source="a JOIN good USING (host, key, dts)")
    zeros = """, k AS (SELECT host, key, var, min(dts) AS f FROM a GROUP BY 1, 2, 3), t AS (SELECT host, max(dts) AS t FROM a GROUP BY 1),
        grid AS (SELECT host, key, var, unnest(range(f, t + 1, 21600)) AS dts FROM k JOIN t USING (host)), w AS (SELECT DISTINCT host, dts, dt FROM a),
        z AS (SELECT grid.host, grid.key, grid.var, grid.dts, coalesce(w.dt, grid.dts * 1000 - 5000) AS dt, coalesce(last, 0) AS last, coalesce(p50, 0) AS p50
              FROM grid LEFT JOIN a USING (host, key, var, dts) LEFT JOIN w ON grid.host = w.host AND grid.dts = w.dts)"""
    add("z", 6, (50,), cte=zeros, source="z")
    return " UNION ALL ".join(parts)


_CLOSED = "m AS (SELECT epoch_us(max(ts)) / 1000000 AS at_s FROM events)"


def _known(cte: str, values: tuple[str, ...], fallback_ms: int, dropped: str = "false") -> str:
    """Rows of closed windows (CTE ``a``) with zeros for known series, without keys that are dropped."""
    grid = "".join(f", coalesce({v}, 0) AS {v}" for v in values)
    return f"""{cte}, c AS (SELECT a.* FROM a, m WHERE dts <= m.at_s),
        k AS (SELECT host, key, var, min(dts) AS f FROM c GROUP BY 1, 2, 3),
        grid AS (SELECT host, key, var, unnest(range(f, floor(at_s)::BIGINT + 1, 21600)) AS dts FROM k, m), w AS (SELECT DISTINCT host, dts, dt FROM c),
        z AS (SELECT grid.host, grid.key, grid.var, grid.dts, coalesce(w.dt, grid.dts * 1000 - {fallback_ms})::BIGINT AS dt{grid}
              FROM grid LEFT JOIN c USING (host, key, var, dts) LEFT JOIN w ON grid.host = w.host AND grid.dts = w.dts),
        bad AS (SELECT host, key, dts FROM z GROUP BY 1, 2, 3 HAVING bool_or({dropped}))
        SELECT host, key, var, unnest({list(values)}) AS agg, unnest([{', '.join(values)}])::BIGINT AS value, dt, dts FROM z ANTI JOIN bad USING (host, key, dts)"""


def _more() -> dict[str, str]:
    long = " SELECT host, key, var, agg, value, dt, dts FROM r"
    big = f"WITH {_V1}, v1x AS (SELECT * REPLACE (CASE WHEN var = 'value' AND key = 'click' THEN raw * 1e19 ELSE raw END AS raw) FROM v1), {_agg('6 hours', (50, 90, 99), 'v1x')}"
    big += ", r AS (SELECT key, var, unnest(['last', 'p50', 'p90', 'p99']) AS agg, unnest([last, p50, p90, p99]) AS value FROM a)"
    pushed = """vj AS (SELECT concat('h', user_id % 8) AS host, event_type AS key, 'util' AS var, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS raw, true AS pct, ts, event_id AS seq
        FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0)"""
    return {
        "event_log": _LONG + long,
        "foreign_events": """WITH e AS (SELECT event_id AS i, value AS x FROM events)
            SELECT CAST(i AS VARCHAR) AS key, 'b' AS var, unnest(['last', 'p50', 'p90', 'p99', 't', 'n', 'o', 'f', 'w', 'r']) AS agg,
                   unnest([7, 0, trunc(x)::BIGINT, -3, 1, 0, 0, 0, 9223372036854775807, 2]) AS value, 1699999999000 AS dt, 1700000000::BIGINT AS dts
            FROM e WHERE i % 11 <> 0 AND i % 13 <> 0 UNION ALL SELECT 'rejects', '', '', count(*), 0, 0 FROM e WHERE i % 11 = 0""",
        "retention_removed": """SELECT substr(o_orderpriority, 1, 1) AS metric, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, count(*)::BIGINT AS n, max(o_orderkey) AS most
            FROM orders WHERE date_trunc('month', o_orderdate) >= DATE '1997-02-28' GROUP BY 1, 2""",
        "overflow_rejects": big + """ SELECT key, var, agg, count(*)::BIGINT AS n, CASE WHEN value IS NULL THEN 'rejects' ELSE 'rows' END AS "of" FROM r GROUP BY ALL""",
        "custom_source": f"""WITH {_V1} SELECT 'dc1' AS dc, concat('p', substr(host, 2, 1)) AS project, 'web' AS role, host, 'app' AS metric, count(*)::BIGINT AS n, max(raw) AS most
            FROM v1 GROUP BY host""",
        "two_definitions": f"""(WITH {_V1}, {_agg('6 hours', (50, 90))} SELECT 'six hours' AS "of", host, key, var, unnest(['last', 'p50', 'p90']) AS agg, unnest([last, p50, p90]) AS value, dts FROM a)
            UNION ALL (WITH {_V1}, {_agg('1 day', ())} SELECT 'a day', host, key, var, 'last', last, dts FROM a)""",
        "emit_filter": _A + """ SELECT host, key, count(*)::BIGINT AS n, min(dts) AS first
            FROM (SELECT host, key, dts FROM a WHERE key <> 'error' GROUP BY 1, 2, 3 HAVING max(n) >= 5) GROUP BY 1, 2""",
        "resampled": f"""WITH {_V1} SELECT host, key, var, arg_max(raw, row(ts, seq)) AS raw, epoch_us(max(ts)) AS us, arg_max(seq, row(ts, seq)) AS seq
            FROM v1 GROUP BY host, key, var, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')""",
        "first_error": _LONG + ", h AS (SELECT host, count(*)::BIGINT AS n FROM r GROUP BY 1) SELECT host, n, 'out of reach' AS error FROM h UNION ALL SELECT host, n, 'out of reach' FROM h",
        "metric_tables": _LONG + " SELECT key AS metric, host, agg, count(*)::BIGINT AS n, sum(value)::BIGINT AS total FROM r GROUP BY 1, 2, 3",
        "kinds": "SELECT event_type, CASE WHEN event_type = 'view' THEN false WHEN event_type <> 'error' THEN true END AS is_percent, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
        "ipv6_pairs": """SELECT CASE WHEN k = 0 THEN '2001:db8::' ELSE concat('2001:db8::', k) END AS ip, sum(n)::BIGINT AS n
            FROM (SELECT l_suppkey % 5 AS k, CAST(trunc(l_quantity) AS BIGINT) AS n FROM lineitem) GROUP BY k""",
        "stream_disk_rates": _points(_deltas("concat('sd', substr(entity, 1, 1))", "d % 6 <> 0"), "concat('/dev/', name)", _DISK, percents=("util",)),
        "stream_events": _A + f""", {_CLOSED}, good AS (SELECT host, key, dts FROM a WHERE key <> 'error' GROUP BY 1, 2, 3 HAVING max(CASE WHEN var = 'value' THEN raw_max END) >= 100)
            SELECT host, key, var, unnest(['last', 'p50', 'p90', 'p99']) AS agg, unnest([last, p50, p90, p99]) AS value, dt, dts
            FROM a JOIN good USING (host, key, dts), m WHERE dts <= m.at_s""",
        "stream_known_events": _known(f"WITH {_V1}, {_agg('6 hours', (50,))}, {_CLOSED}", ("last", "p50"), 5000, "var = 'k_util' AND last > 90"),
        "stream_push": _known(f"WITH {pushed}, {_agg('6 hours', (), 'vj', 'max')}, m AS (SELECT epoch_us(max(ts)) / 1000000 AS at_s FROM vj)", ("last",), 21_600_000),
        "stream_fan_out": f"""WITH {_V1}, {_agg('6 hours', (50,))}, {_CLOSED}
            SELECT unnest(['one', 'two']) AS target, n, n > 0 AS parity FROM (SELECT 2 * count(*)::BIGINT AS n FROM a, m WHERE dts <= m.at_s)""",
        "stream_pairs": f"""WITH {_PAIRS} SELECT host, dts, iface, proto, src_ip, src_port, dst_ip, dst_port, bytes, packets, n_flows
            FROM pr WHERE dts < (SELECT max(at_s) + 300 FROM top)""",
    }
