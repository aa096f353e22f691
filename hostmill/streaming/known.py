"""State that streams keep from batch to batch. It imports nothing of this package, as it is
sent by value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


class KnownSeries(StatefulProcessor):
    """Per worker: every series seen so far with the last window it had samples in, and the last
    window's end.

    A row comes for each closed window with samples, holding its aggregates. It goes on with
    those and a zero for each known series it lacks. Windows without any row are made of zeros:
    those before the next row when it comes, those of a silent worker by a timer, as soon as the
    watermark passes their end. What comes out is one row for a window and key, a frame a window.

    ``forget_us``: a series without samples for longer ends, and a worker without series has no
    timer. None keeps them for good.
    """

    def __init__(self, by: list[str], send_us: int, names: list[str], forget_us: int | None = None):
        self.by, self.send, self.names, self.forget = by, send_us, names, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "key string, var string", "percent boolean, seen bigint")
        self.last = handle.getValueState("last", "end bigint")

    def _alarm(self, end: int) -> int:
        # Timers before the watermark ring; a window is closed at its end, hence the millisecond less.
        return (end + self.send) // 1000 - 1

    def _window(self, worker, end: int, first, have: dict, known: dict) -> Iterator[pd.DataFrame]:
        if self.forget is not None:
            for name in [n for n, (_, seen) in known.items() if end - seen > self.forget]:
                del known[name]
                self.known.removeKey(name)
        zero = dict.fromkeys(self.names, 0.0)
        by_key: dict[str, list] = {}
        for (key, var), (percent, _) in sorted(known.items()):
            by_key.setdefault(key, []).append(have.get((key, var)) or {"var": var, "is_percent": percent, "n": 0, **zero})
        rows = [(*worker, pd.Timestamp(end, unit="us"), first, key, cells) for key, cells in by_key.items()]
        if rows:
            yield pd.DataFrame(rows, columns=[*self.by, "send_at", "first_ts", "key", "cells"])

    def _held(self) -> tuple[dict, int | None]:
        known = {tuple(k): (bool(v[0]), v[1]) for k, v in self.known.iterator()}
        return known, self.last.get()[0] if self.last.exists() else None

    def handleInputRows(self, worker, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, last = self._held()
        if last is not None:
            self.handle.deleteTimer(self._alarm(last))
        windows = [(r.send_at.value // 1000, r.first_ts, r.cells) for batch in rows for r in batch.itertuples(index=False)]
        for end, first, cells in sorted(windows, key=lambda w: w[0]):
            while known and last is not None and last + self.send < end:
                last += self.send
                yield from self._window(worker, last, pd.NaT, {}, known)
            have = {}
            for c in cells:
                c = c.asDict() if hasattr(c, "asDict") else dict(c)
                name = (c.pop("key"), c["var"])
                have[name] = c
                known[name] = (bool(c["is_percent"]), end)
                self.known.updateValue(name, known[name])
            yield from self._window(worker, end, first, have, known)
            last = end
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(self._alarm(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The worker's empty windows up to the watermark."""
        known, last = self._held()
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        while known and last + self.send <= closed:
            last += self.send
            yield from self._window(key, last, pd.NaT, {}, known)
        self.last.update((last,))
        if known:
            self.handle.registerTimer(self._alarm(last))

    def close(self) -> None:
        pass


#: A time that isn't there.
_NEVER = -(1 << 63)


class PreviousScrapes:
    """Per host: the times of the newest scrape and the one before, and the counters of the entities
    in these two (rows of the newest may still be coming).

    It is called with all rows of a host in a micro-batch and matches them at once: state comes and
    goes with the rows, so that a host costs no more calls than its rows do. Rows of older scrapes
    come out marked ``late``, without a previous row; a null entity makes a scrape and nothing else.
    ``at``: the column of a row's time in microseconds.
    """

    def __init__(self, counters: list[str], entity: str, at: str, columns: list[str]):
        self.counters, self.entity, self.at, self.columns = counters, entity, at, columns
        self.state = "before bigint, newest bigint, entity array<string>, at array<bigint>" + "".join(f", c{k} array<double>" for k in range(len(counters)))

    def __call__(self, host, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batches = [b for b in frames if len(b)]
        if not batches:
            return
        d = batches[0] if len(batches) == 1 else pd.concat(batches)
        d = d[d[self.at].notna()]
        if not len(d):
            return
        before, newest, names, ats, *held = state.get if state.exists else (_NEVER, _NEVER, [], [], *[[] for _ in self.counters])
        m = len(names)
        at = np.concatenate([np.array(ats, np.int64), d[self.at].to_numpy(np.int64)])
        values = [np.concatenate([np.array(old, float), d[c].to_numpy(float, na_value=np.nan)]) for old, c in zip(held, self.counters, strict=True)]
        entity = np.concatenate([np.array(names, object), d[self.entity].to_numpy(object)])
        code = pd.factorize(entity)[0]  # -1: null
        late = at < newest
        late[:m] = False
        times = np.unique(at[m:][~late[m:]])
        if len(times):
            priors = np.concatenate([[before if times[0] == newest else newest], times[:-1]])
            prior = priors[np.minimum(np.searchsorted(times, at), len(times) - 1)]
        else:
            prior = np.full(len(at), _NEVER)
        # Rows of one entity and time in a row; the last of them counts for the next time.
        order = np.lexsort((at, code))
        order = order[(code[order] >= 0) & ~late[order]]
        new = np.ones(len(order), bool)
        new[1:] = (code[order[1:]] != code[order[:-1]]) | (at[order[1:]] != at[order[:-1]])
        start = np.flatnonzero(new)
        last = order[np.append(start[1:], len(order)) - 1] if len(order) else order
        old = np.full(len(last), -1)
        old[1:] = np.where(code[last[1:]] == code[last[:-1]], last[:-1], -1)
        old = np.where((old >= 0) & (at[old] == prior[last]), old, -1)
        match = np.full(len(at), -1)
        match[order] = old[np.cumsum(new) - 1]
        match, prior, late = match[m:], prior[m:], late[m:]
        seconds = np.where(late | (prior == _NEVER), 0.0, (at[m:] - np.where(prior == _NEVER, at[m:], prior)) / 1e6)
        made = {"seconds": seconds, "has_prev": match >= 0, "late": late}
        made |= {f"prev_{c}": np.where(match >= 0, v[match], np.nan) for c, v in zip(self.counters, values, strict=True)}
        if len(times):
            before, newest = int(priors[-1]), int(times[-1])
            kept = last[(at[last] == before) | (at[last] == newest)]
            state.update((before, newest, entity[kept].tolist(), at[kept].tolist(), *[v[kept].tolist() for v in values]))
        yield pd.concat([d, pd.DataFrame(made, index=d.index)], axis=1)[self.columns]
