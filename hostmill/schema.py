"""Row shapes shared by all operators."""

from __future__ import annotations

POINTS = (
    "dc string, host string, project string, role string, metric string, instance string, key string, var string,"
    " raw double, is_percent boolean, ts timestamp, seq bigint"
)
EVENTS = (
    "dt bigint, dts bigint, metric string, dc string, host string, project string, role string, key string,"
    " data map<string,map<string,bigint>>, host_ip string"
)
#: Events as others may log them: what ``data`` holds is judged entry by entry.
LOGGED_EVENTS = EVENTS.replace("map<string,map<string,bigint>>", "variant")
METRIC_ROWS = (
    "dt timestamp, dts timestamp, dtv timestamp, dc string, host string, project string, role string, host_ip string,"
    " key string, var string, agg string, value bigint, metric string, day date"
)
PACKETS = (
    "host string, iface string, proto int, src_addr binary, dst_addr binary, src_v4 boolean, dst_v4 boolean,"
    " src_port int, dst_port int, bytes bigint, tcp_start boolean, ts timestamp, seq bigint"
)
TAGS = ("dc", "host", "project", "role")
#: One worker collects one definition of a metric on one host.
WORKER = (*TAGS, "metric", "instance")
#: Metrics that keep a table of their own by default; fixed values.
BUILTIN_METRICS = ("cpu", "ram", "swap", "kernel", "net", "netflow", "disk", "fs", "process")
