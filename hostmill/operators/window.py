"""Windows: points to aggregates, events and long rows.

One scan and two shuffles: one on worker, window, key and variable for the series, and one of the
series on worker and window, which gives the window's time and, without another, its events. Zeros
for known series take two more: of the series by worker, key and variable, where the gap to the next
window is filled, and of one row a worker for its last window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.masks import allowed
from ..functions.rules import drop_events, dropped_by
from ..functions.values import before_send, normalised
from ..plans.spec import MetricSpec
from .points import normalised_names, select_vars
from .store import flatten_events, stamp

#: Below so many samples every percentile is 0; a fixed value.
LEAST_SAMPLES = 4


def percentile(column: str, p: int) -> Column:
    """Nearest-rank percentile of a group."""
    return F.expr(f"percentile_disc({p}/100D) WITHIN GROUP (ORDER BY `{column}`)")


def series_aggregates(percentiles: Sequence[int], last_only: bool = False) -> list[Column]:
    """last, is_percent, n, raw_max, first_ts and pXX (all raw) of a group of points.

    last_only: only the last sample counts, as if the window were one scrape.
    """
    order = F.struct("ts", "seq")
    last = F.max_by("raw", order)
    return [
        last.alias("last"),
        F.max_by("is_percent", order).alias("is_percent"),
        F.lit(1).cast("long").alias("n") if last_only else F.count(F.lit(1)).alias("n"),
        (last if last_only else F.max("raw")).alias("raw_max"),
        (F.max("ts") if last_only else F.min("ts")).alias("first_ts"),
        *[percentile("raw", p).alias(f"p{p}") for p in percentiles],
    ]


def series(points: DataFrame, send: str, percentiles: Sequence[int], by: Sequence[str], last_only: bool = False) -> DataFrame:
    """One row per window and series: last, pXX (raw), count, greatest raw value, first time."""
    d = points.groupBy(*by, "key", "var", F.window("ts", send).alias("w")).agg(*series_aggregates(percentiles, last_only))
    return d.withColumn("send_at", F.col("w.end")).drop("w")


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which a null equals a null, with the left side's keys kept."""
    other = right.withColumnsRenamed({k: f"of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return left.join(other, on, how).drop(*[f"of_{k}" for k in keys])


def stored(aggregates: DataFrame, percentiles: Sequence[int]) -> DataFrame:
    """Normalised values; percentiles of fewer than four samples are 0."""
    d = aggregates
    for p in percentiles:
        value = F.when(F.col("n") < LEAST_SAMPLES, F.lit(0).cast("bigint")).otherwise(normalised(F.col(f"p{p}"), F.col("is_percent")))
        d = d.withColumn(f"p{p}", value)
    return d.withColumn("last", normalised(F.col("last"), F.col("is_percent")))


def zero_filled(
    aggregates: DataFrame, send: str | Column, percentiles: Sequence[int], by: Sequence[str], until: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Every series in each window from its first one to the worker's last (or ``until``).

    Each window is followed by those up to the series' next one; these have 0 everywhere and a
    null first time. Rows that aren't in ``where`` stay as they are.
    """
    step = F.expr(f"interval {send}") if isinstance(send, str) else send
    if until is None:
        # The worker's last window, from one row a worker: no window over all its series.
        d = joined(aggregates, aggregates.groupBy(*by).agg(F.max("send_at").alias("to_")), by)
    else:
        d = aggregates.withColumn("to_", until)
    series_ = Window.partitionBy(*by, "key", "var").orderBy("send_at")
    stop = F.coalesce(F.lead("send_at").over(series_) - step, F.greatest("send_at", "to_"))
    if where is not None:
        stop = F.when(where, stop).otherwise(F.col("send_at"))
    d = d.withColumn("stop", stop).withColumn("slot", F.explode(F.sequence("send_at", "stop", step)))
    own = F.col("slot") == F.col("send_at")
    zero = {c: F.when(own, F.col(c)).otherwise(F.lit(0)) for c in ("n", "last", "raw_max", *[f"p{p}" for p in percentiles])}
    return d.withColumns(zero | {"first_ts": F.when(own, F.col("first_ts")), "send_at": F.col("slot")}).drop("to_", "stop", "slot")


def window_times(aggregates: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first time of a worker's samples in each window: one row for each."""
    return aggregates.groupBy(*by, "send_at").agg(F.min("first_ts").alias("first_ts"))


def timed(d: DataFrame, fallback_ms: int | Column) -> DataFrame:
    """dt (ms) and dts (s) from first_ts and send_at: the first time, or send - fallback, always
    below the send second."""
    sent = F.unix_millis("send_at")
    dts = F.floor(sent / 1000).cast("bigint")
    first = F.coalesce(F.unix_millis("first_ts"), sent - fallback_ms)
    return d.withColumn("dts", dts).withColumn("dt", before_send(first, dts)).drop("first_ts")


def with_window_time(aggregates: DataFrame, by: Sequence[str], fallback_ms: int) -> DataFrame:
    """The aggregates with their worker's dt and dts."""
    d = joined(aggregates.drop("first_ts"), window_times(aggregates, by), [*by, "send_at"])
    return timed(d, fallback_ms)


def process_threshold(aggregates: DataFrame, by: Sequence[str], limits: dict[str, float]) -> DataFrame:
    """Keys whose greatest raw value reaches one of the limits; no limits, no keys."""
    if not limits:
        return aggregates.filter(F.lit(False))
    w = Window.partitionBy(*by, "send_at", "key")
    reached = F.lit(False)
    for var, limit in limits.items():
        most = F.coalesce(F.max(F.when(F.col("var") == var, F.col("raw_max"))).over(w), F.lit(0.0))
        reached = reached | (most >= limit)
    return aggregates.withColumn("reached", reached).filter("reached").drop("reached")


def emit_filter(aggregates: DataFrame, by: Sequence[str], condition: Column) -> DataFrame:
    """Keys for which an aggregate condition over their series holds, such as
    ``max(when(var = 'x', raw_max)) > 5``."""
    keys = [*by, "send_at", "key"]
    good = aggregates.groupBy(*keys).agg(condition.alias("good")).filter("good").select(*keys)
    return aggregates.join(good, keys, "left_semi")


def series_cell(percentiles: Sequence[int]) -> Column:
    """A stored series as an element of its key's cells: var, n, raw_max and its values by name."""
    cells = [F.lit("last"), F.col("last")]
    for p in percentiles:
        cells += [F.lit(f"p{p}"), F.col(f"p{p}")]
    return F.struct("var", "n", "raw_max", F.create_map(*cells).alias("aggs"))


def reaches(cells: Column, limits: dict[str, float]) -> Column:
    """Whether a key's greatest raw value of some variable reaches its limit; no limits, no keys."""

    def most(var: str) -> Column:
        own = F.filter(cells, lambda c: c["var"] == var)
        return F.coalesce(F.array_max(F.transform(own, lambda c: c["raw_max"])), F.lit(0.0))

    reached = F.lit(False)
    for var, limit in limits.items():
        reached = reached | (most(var) >= limit)
    return reached


def assembled(keys: DataFrame, spec: MetricSpec) -> DataFrame:
    """Rows with key, ``cells``, dt and dts to events: thresholds and the emit filter on raw
    values, then drop rules on stored ones. Batches and streams share it."""
    d = keys
    if spec.thresholds is not None:
        d = d.filter(reaches(F.col("cells"), spec.thresholds))
    if spec.emit is not None:
        d = d.filter(spec.emit(F.col("key"), F.col("cells")))
    pairs = F.transform("cells", lambda c: F.struct(c["var"], c["aggs"]))
    d = d.withColumn("data", F.map_from_entries(pairs)).drop("cells", "send_at")
    if "metric" not in d.columns:
        d = d.withColumn("metric", F.lit(spec.metric))
    return drop_events(d, spec.drop_event).drop("instance")


def chosen_points(points: DataFrame, spec: MetricSpec) -> DataFrame:
    return select_vars(normalised_names(points), spec.keep, spec.drop)


def window_events(points: DataFrame, spec: MetricSpec, by: Sequence[str]) -> DataFrame:
    """Points to events, in the order: names, variable masks, window time, aggregates, zeros,
    thresholds and emit filter on raw values, stored values, drop rules on stored values."""
    send = f"{spec.send} seconds"
    chosen = chosen_points(points, spec)
    agg = series(chosen, send, spec.percentiles, by, spec.last_only)
    if spec.zero_fill:
        agg = zero_filled(agg, send, spec.percentiles, by)
    # A worker's series of one window meet for its time; their keys then lie together already.
    first = F.min("first_ts").over(Window.partitionBy(*by, "send_at"))
    cells = F.collect_list(series_cell(spec.percentiles)).alias("cells")
    made = stored(agg, spec.percentiles).withColumn("first_ts", first).groupBy(*by, "key", "send_at")
    made = timed(made.agg(cells, F.min("first_ts").alias("first_ts")), spec.fallback_ms)
    return assembled(made, spec)


def _by_definition(specs: Mapping[str, MetricSpec], value: Callable[[MetricSpec], object]) -> Column:
    """A column with ``value`` of the row's own definition."""
    chosen = F.lit(None)
    for name, spec in specs.items():
        v = value(spec)
        chosen = F.when(F.col("instance") == name, v if isinstance(v, Column) else F.lit(v)).otherwise(chosen)
    return chosen


def definition_events(points: DataFrame, specs: Mapping[str, MetricSpec], by: Sequence[str]) -> DataFrame:
    """``window_events`` of several definitions of a metric at once; ``instance`` is the
    definition's name in ``specs``.

    Each point is taken once for every window length of the definitions that want its variable,
    with the length and its own window in the key; the aggregates of a window are then dealt to
    the definitions. So one scan and the two shuffles of a single definition serve all of them
    (zeros cost what they cost there), and definitions of one length share what is shuffled.
    """
    lengths: dict[int, list[MetricSpec]] = {}
    for s in specs.values():
        lengths.setdefault(s.send, []).append(s)

    def wants(s: MetricSpec) -> Column:
        return allowed(F.col("var"), s.keep, s.drop)

    def dealt(d: DataFrame, name: str, *values: Column) -> DataFrame:
        return d.withColumn(name, F.explode(F.filter(F.array(*values), lambda x: x.isNotNull())))

    d = normalised_names(points)
    d = dealt(d, "length", *[F.when(reduce(or_, map(wants, own)), F.lit(send).cast("bigint")) for send, own in lengths.items()])
    us, step = F.unix_micros("ts"), 1_000_000 * F.col("length")
    d = d.withColumn("send_at", F.timestamp_micros(us - F.pmod(us, step) + step))
    order = F.struct("ts", "seq")
    used: dict[int, set[int]] = {}
    for s in specs.values():
        for p in s.percentiles:
            used.setdefault(p, set()).add(s.send)
    ranked = [F.expr(f"percentile_disc({p}/100D) WITHIN GROUP (ORDER BY raw) FILTER (WHERE length IN ({', '.join(map(str, sorted(of)))}))").alias(f"p{p}") for p, of in used.items()]
    agg = d.groupBy(*by, "length", "key", "var", "send_at").agg(
        F.max_by("raw", order).alias("last"), F.max_by("is_percent", order).alias("is_percent"), F.count(F.lit(1)).alias("n"),
        F.max("raw").alias("raw_max"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *ranked,
    )
    agg = dealt(agg, "instance", *[F.when((F.col("length") == s.send) & wants(s), F.lit(name)) for name, s in specs.items()]).drop("length")
    one = _by_definition(specs, lambda s: s.last_only)
    agg = agg.withColumns(
        {"n": F.when(one, F.lit(1).cast("bigint")).otherwise(F.col("n")), "raw_max": F.when(one, F.col("last")).otherwise(F.col("raw_max")), "first_ts": F.when(one, F.col("last_ts")).otherwise(F.col("first_ts"))}
    ).drop("last_ts")
    by = [*by, "instance"]
    if any(s.zero_fill for s in specs.values()):
        seconds = F.make_dt_interval(secs=_by_definition(specs, lambda s: s.send))
        agg = zero_filled(agg, seconds, tuple(used), by, where=_by_definition(specs, lambda s: s.zero_fill))
    first = F.min("first_ts").over(Window.partitionBy(*by, "send_at"))
    cells = F.collect_list(_by_definition(specs, lambda s: series_cell(s.percentiles))).alias("cells")
    made = stored(agg, tuple(used)).withColumn("first_ts", first).groupBy(*by, "key", "send_at")
    d = timed(made.agg(cells, F.min("first_ts").alias("first_ts")), _by_definition(specs, lambda s: s.fallback_ms))
    d = d.filter(_by_definition(specs, lambda s: True if s.thresholds is None else reaches(F.col("cells"), s.thresholds)))
    d = d.filter(_by_definition(specs, lambda s: True if s.emit is None else s.emit(F.col("key"), F.col("cells"))))
    pairs = F.transform("cells", lambda c: F.struct(c["var"], c["aggs"]))
    d = d.withColumn("data", F.map_from_entries(pairs)).drop("cells", "send_at").withColumn("metric", _by_definition(specs, lambda s: s.metric))

    def stays(s: MetricSpec):
        dropped = dropped_by(s.drop_event)
        return True if dropped is None else ~dropped

    return d.filter(_by_definition(specs, stays))


def metric_rows(points: DataFrame, spec: MetricSpec, by: Sequence[str], stamped_at: Column | None = None) -> DataFrame:
    return stamp(flatten_events(window_events(points, spec, by)), stamped_at)
