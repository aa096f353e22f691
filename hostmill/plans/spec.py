"""Definition of a metric's windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

#: Defaults in seconds; fixed values.
SCRAPE, SEND, PROCESS_SCRAPE = 5, 30, 20
#: Metrics whose known series go on with zeros; the others report what they saw.
KEEP_KNOWN = frozenset({"cpu", "ram", "swap", "kernel", "net", "disk", "fs"})


def resolve_percentiles(defaults: list[int], override: list[int] | None = None) -> list[int]:
    """The override, even an empty one, beats the default; sorted, without repeats, 1 to 100."""
    chosen = defaults if override is None else override
    if any(not 1 <= p <= 100 for p in chosen):
        raise ValueError(f"percentiles must be from 1 to 100: {chosen}")
    return sorted(set(chosen))


@dataclass(frozen=True)
class MetricSpec:
    metric: str
    scrape: int = SCRAPE
    send: int = SEND
    percentiles: tuple[int, ...] = ()
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    drop_event: tuple[str, ...] = ()
    zero_fill: bool = False
    push: bool = False
    thresholds: dict[str, float] | None = field(default=None)
    #: Whether a key's event goes out: from the key and the array of its series (var, n, raw_max, aggs).
    emit: Callable[[Column, Column], Column] | None = field(default=None)

    def __post_init__(self):
        object.__setattr__(self, "percentiles", tuple(resolve_percentiles(list(self.percentiles))))
        if self.scrape <= 0 or self.send <= 0:
            raise ValueError("scrape and send must be positive")

    @property
    def last_only(self) -> bool:
        """Without percentiles a window is one scrape, and its last sample is all there is."""
        return not self.percentiles and self.scrape == self.send

    @property
    def fallback_ms(self) -> int:
        return 1000 * (self.send if self.push else self.scrape)

    @staticmethod
    def of(metric: str, scrape: int | None = None, send: int | None = None, percentiles: list[int] | None = None, defaults: list[int] = (), **rest) -> MetricSpec:
        """Defaults applied: netflow inherits no percentiles, and without any the scrape is the send."""
        chosen = resolve_percentiles([] if metric == "netflow" else list(defaults), percentiles)
        send = send or SEND
        scrape = scrape or (PROCESS_SCRAPE if metric == "process" else SCRAPE)
        if not chosen:
            scrape = send
        rest.setdefault("zero_fill", metric in KEEP_KNOWN)
        return MetricSpec(metric, scrape, send, tuple(chosen), **rest)
