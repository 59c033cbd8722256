"""Per-source running features and rate limits as keyed streaming state that expires.

State lives in the RocksDB store of the session, one small set of maps per source. Inside a micro-batch a source's
events are taken in (time, id) order, so in-order input gives the numbers of the batch functions. Only the few columns
that decide are put in order; the rows stay in the frames they came in.

State goes in one of two ways. `expire="event"`: a timer of event time, moved on with each batch, fires when the watermark
has passed the source's last event by the longest time that the state can matter; replays expire alike. Rows later
than `watermark` are dropped and counted (`windows.late_rows`). `expire="processing"`: every entry has a time to live on
the wall clock since its last use, as a cache has; no row is dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hawkframe.operators.sliced import US, micros
from hawkframe.schemas import PORT_TTL, SESSION_TTL, WINDOWS

MINUTE = 60 * US
COUNTRY_TTL = 7 * 86400
WATERMARK = "10 minutes"
_SET_COLUMNS = {"i": "destination_ip", "p": "destination_port", "r": "protocol"}
_OUTPUT = ["unique_dst_ips", "unique_dst_ports", "unique_protocols"]


class Expiring(StatefulProcessor):
    """State of a key in groups, each with the time after the key's last event at which it goes."""

    def __init__(self, expire: str = "event") -> None:
        if expire not in ("event", "processing"):
            raise ValueError(f"expire must be event or processing, not {expire}")
        self.by_event = expire == "event"

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups: list[tuple[int, list]] = []
        # Time of the key's newest event, and of the timer that is set (0: none).
        self.clock = handle.getValueState("clock", "last long, due_ms long")

    def map_state(self, name: str, key: str, value: str, keep_us: int):
        return self._grouped(self.handle.getMapState(name, key, value, self._ttl(keep_us)), keep_us)

    def value_state(self, name: str, value: str, keep_us: int):
        return self._grouped(self.handle.getValueState(name, value, self._ttl(keep_us)), keep_us)

    def _ttl(self, keep_us: int) -> int | None:
        return None if self.by_event else max(1, -(-keep_us // 1000))

    def _grouped(self, state, keep_us: int):
        self.groups.append((keep_us, state))
        self.groups.sort(key=lambda g: g[0])
        return state

    def last(self) -> int | None:
        row = self.clock.get()
        return None if row is None else row[0]

    def touch(self, newest: int) -> None:
        """Note the newest event and move the timer behind it."""
        row = self.clock.get()
        due = 0
        if self.by_event:
            due = (newest + self.groups[0][0]) // 1000 + 1
            if row is not None and row[1] and row[1] != due:
                self.handle.deleteTimer(row[1])
            self.handle.registerTimer(due)
        self.clock.update((newest, due))

    def keep_from(self, newest: int, span_us: int, timer_values) -> int:
        """Oldest time that a row which may still come can look back to."""
        if self.by_event:
            newest = min(newest, timer_values.getCurrentWatermarkInMs() * 1000)
        return newest - span_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row, now = self.clock.get(), expiredTimerInfo.getExpiryTimeInMs()
        if row is not None and row[1] == now:
            later = []
            for keep, state in self.groups:
                due = (row[0] + keep) // 1000 + 1
                if due <= now:
                    state.clear()
                else:
                    later.append(due)
            if later:
                self.handle.registerTimer(min(later))
                self.clock.update((row[0], min(later)))
            else:
                self.clock.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Batch:
    """A key's rows of one micro-batch: frames as they came, and the order of all their rows by time and id."""

    def __init__(self, frames: Iterator[pd.DataFrame]) -> None:
        self.frames = list(frames)
        self.t = self.column("t_us").astype(np.int64)
        ids = np.unique(self.column("event_id"), return_inverse=True)[1]
        self.order = np.lexsort((ids, self.t))

    def column(self, name: str) -> np.ndarray:
        return np.concatenate([f[name].to_numpy() for f in self.frames])

    def sorted(self, name: str) -> list:
        return self.column(name)[self.order].tolist()

    def results(self, out: Mapping[str, Sequence]) -> Iterator[pd.DataFrame]:
        """Each frame with its part of the columns, which are given in time order."""
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        at = 0
        for f in self.frames:
            rows = back[at : at + len(f)]
            at += len(f)
            yield f.assign(**{n: pd.Series(np.asarray(v)[rows], index=f.index) for n, v in out.items()})


class _Members:
    """A set kept in map state that asks the store once per value and batch."""

    def __init__(self, state, refresh: bool) -> None:
        self.state, self.refresh, self.known, self.empty = state, refresh, {}, False

    def clear(self) -> None:
        self.state.clear()
        self.known, self.empty = {}, True

    def add(self, value: str) -> bool:
        """Put the value in; true when it was not there. Writing again renews its time to live."""
        first = value not in self.known
        if first:
            self.known[value] = not self.empty and self.state.containsKey((value,))
        fresh = not self.known[value]
        if fresh or (first and self.refresh):
            self.state.updateValue((value,), (True,))
            self.known[value] = True
        return fresh


class SourceHistory(Expiring):
    """Counts and novelty of one source from its earlier events, distinct counts per inactivity session."""

    def __init__(self, windows: Mapping[str, int], session_s: int, port_s: int, expire: str = "event") -> None:
        super().__init__(expire)
        self.windows = {w: s * US for w, s in windows.items()}
        self.session = session_s * US
        self.port_ttl = port_s * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start(handle)
        # Times of recent events, grouped by minute.
        self.times = self.map_state("times", "minute long", "t array<long>", max(self.windows.values()) + MINUTE)
        # Values of the current session and how many there are; ports of the long session.
        self.seen = self.map_state("seen", "value string", "x boolean", self.session)
        self.sizes = self.value_state("sizes", "i long, p long, r long", self.session)
        self.ports = self.map_state("ports", "value string", "x boolean", self.port_ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _Batch(rows)
        minutes = {k[0]: list(v[0]) for k, v in self.times.iterator()}
        touched: set[int] = set()
        seen, ports = _Members(self.seen, not self.by_event), _Members(self.ports, not self.by_event)
        last, row = self.last(), self.sizes.get()
        sizes = list(row) if row is not None else [0, 0, 0]
        out = {n: [] for n in [*(f"conn_count_{w}" for w in self.windows), *_OUTPUT, "is_novel_port"]}
        values = [batch.sorted(c) for c in _SET_COLUMNS.values()]
        for t, *used in zip(batch.t[batch.order].tolist(), *values, strict=True):
            if last is not None and t - last >= self.session:
                seen.clear()
                sizes = [0, 0, 0]
            if last is not None and t - last >= self.port_ttl:
                ports.clear()
            for w, span in self.windows.items():
                out[f"conn_count_{w}"].append(_between(minutes, t - span, t))
            for n, size in zip(_OUTPUT, sizes, strict=True):
                out[n].append(size)
            out["is_novel_port"].append(ports.add(str(used[1])))
            for j, (tag, value) in enumerate(zip(_SET_COLUMNS, used, strict=True)):
                sizes[j] += seen.add(f"{tag}|{value}")
            minute = t - t % MINUTE
            insort(minutes.setdefault(minute, []), t)
            touched.add(minute)
            last = t if last is None else max(last, t)
        oldest = self.keep_from(last, max(self.windows.values()), timerValues)
        for minute in list(minutes):
            if minute + MINUTE <= oldest:
                if self.times.containsKey((minute,)):
                    self.times.removeKey((minute,))
            elif minute in touched:
                self.times.updateValue((minute,), (minutes[minute],))
        self.sizes.update(tuple(sizes))
        self.touch(last)
        yield from batch.results(out)


def _between(minutes: dict[int, list[int]], low: int, high: int) -> int:
    """Number of stored times in [low, high]."""
    first, final = low - low % MINUTE, high - high % MINUTE
    total = 0
    for minute, times in minutes.items():
        if first < minute < final:
            total += len(times)
        elif minute in (first, final):
            total += bisect_right(times, high) - bisect_left(times, low)
    return total


class WindowHistory(Expiring):
    """Features over trailing windows: a ring of minutes with times and bytes, and last uses of values.

    The count and the moments of a window are differences of running sums over the ring; a distinct count is the values whose
    last use lies in the window. Last uses outlive the ring only for novelty (ports, countries), and are read one by one.
    """

    def __init__(self, windows: Mapping[str, int], distinct: Mapping[str, tuple[str, Sequence[str]]], moments: str, novel: Mapping[str, tuple[str, int]], expire: str = "event") -> None:
        super().__init__(expire)
        self.windows = {w: s * US for w, s in windows.items()}
        self.span = max(self.windows.values())
        self.distinct, self.moments = dict(distinct), moments
        self.novel = {name: (column, s * US) for name, (column, s) in novel.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start(handle)
        self.ring = self.map_state("ring", "minute long", "t array<long>, b array<long>", self.span + MINUTE)
        self.uses = self.map_state("uses", "prefix string, value string", "t long", self.span + MINUTE)
        self.novelty = {n: self.map_state(n, "value string", "t long", ttl) for n, (_, ttl) in self.novel.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _Batch(rows)
        t = batch.t[batch.order]
        last = self.last()
        newest = int(t[-1]) if last is None else max(last, int(t[-1]))
        oldest = self.keep_from(newest, self.span, timerValues)
        size = [None if pd.isna(b) else int(b) for b in batch.sorted("bytes_sent")]
        ring = {k[0]: (list(v[0]), list(v[1])) for k, v in self.ring.iterator()}
        out: dict[str, Sequence] = self._counts(ring, t, size)
        uses: dict[str, dict[str, int]] = {p: {} for p in self.distinct}
        for (prefix, value), (at,) in self.uses.iterator():
            uses[prefix][value] = at
        for prefix, (column, wanted) in self.distinct.items():
            used = [str(v) for v in batch.sorted(column)]
            out |= self._distinct(prefix, uses[prefix], t, used, wanted)
            self._write_uses(prefix, uses[prefix], t.tolist(), used, oldest)
        for name, (column, ttl) in self.novel.items():
            out[name] = self._novel(self.novelty[name], batch.sorted(column), t.tolist(), ttl)
        self._write_ring(ring, t.tolist(), size, oldest)
        self.touch(newest)
        yield from batch.results(out)

    def _counts(self, ring: dict, t: np.ndarray, size: list) -> dict[str, Sequence]:
        """Earlier events per window, mean and deviation of `bytes_sent` over the window of the moments."""
        old_t = np.array([x for times, _ in ring.values() for x in times], np.int64)
        old_b = [x for _, sizes in ring.values() for x in sizes]
        every = np.concatenate([old_t, t])
        order = np.argsort(every, kind="stable")  # what is stored comes before a new event of the same moment
        every = every[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[len(old_t) :]
        low = {w: np.searchsorted(every, t - span, "left") for w, span in self.windows.items()}
        out: dict[str, Sequence] = {f"conn_count_{w}": place - low[w] for w in self.windows}
        # Whole numbers of any size, so that the sums are exact.
        b = np.array([0 if x is None else x for x in [*old_b, *size]], object)[order]
        s1, s2 = (np.concatenate([[0], np.cumsum(x)]) for x in (b, b * b))
        a, z = low[self.moments], place + 1
        n, one, two = z - a, s1[z] - s1[a], s2[z] - s2[a]
        given = np.array([x is not None for x in size])
        mean = np.array([x / int(k) for x, k in zip(one, n, strict=True)], float)
        spread = np.array([max(int(k) * y - x * x, 0) for x, y, k in zip(one, two, n, strict=True)], float)
        deviation = np.where(n > 1, np.sqrt(spread / np.maximum(n * (n - 1.0), 1.0)), 0.0)
        out["payload_size_mean"] = np.where(given, mean, np.nan)
        out["payload_size_stddev"] = np.where(given, deviation, 0.0)
        return out

    def _distinct(self, prefix: str, known: dict[str, int], t: np.ndarray, used: list[str], wanted: Sequence[str]) -> dict[str, Sequence]:
        """Values used in each window up to and with the event.

        A value is in from a use that no other one precedes within the window, until a window after a use that no other
        one follows within it; so the content of a window is a difference of two counts.
        """
        values = [*known, *used]
        times = np.concatenate([np.fromiter(known.values(), np.int64, len(known)), t])
        order = np.argsort(times, kind="stable")
        code = np.unique(np.array(values, object), return_inverse=True)[1]
        by_value = order[np.argsort(code[order], kind="stable")]
        same = code[by_value][1:] == code[by_value][:-1]
        gap = np.where(same, times[by_value][1:] - times[by_value][:-1], np.iinfo(np.int64).max)
        before, behind = np.full(len(times), np.iinfo(np.int64).max), np.full(len(times), np.iinfo(np.int64).max)
        before[by_value[1:]], behind[by_value[:-1]] = gap, gap
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out = {}
        for w in wanted:
            span = self.windows[w]
            entered = np.cumsum(before[order] > span)[place[len(known) :]]
            ends = np.sort(times[behind > span])
            out[f"{prefix}_{w}"] = entered - np.searchsorted(ends, t - span, "left")
        return out

    def _write_uses(self, prefix: str, known: dict[str, int], t: list[int], used: list[str], oldest: int) -> None:
        newest = dict(zip(used, t, strict=True))
        for value, at in known.items():
            if max(at, newest.get(value, at)) < oldest:
                self.uses.removeKey((prefix, value))
        for value, at in newest.items():
            at = max(at, known.get(value, at))
            if at >= oldest:
                self.uses.updateValue((prefix, value), (at,))

    def _novel(self, state, values: list, t: list[int], ttl: int) -> list[bool]:
        """True where the value was not used within `ttl` before. No value (of a country) is never novel."""
        out, known = [], {}
        for at, value in zip(t, values, strict=True):
            if value is None:
                out.append(False)
                continue
            name = str(value)
            if name not in known:
                row = state.getValue((name,))
                known[name] = None if row is None else row[0]
            out.append(known[name] is None or at - known[name] > ttl)
            known[name] = at if known[name] is None else max(at, known[name])
        for name, at in known.items():
            state.updateValue((name,), (at,))
        return out

    def _write_ring(self, ring: dict, t: list[int], size: list, oldest: int) -> None:
        fresh: dict[int, tuple[list, list]] = {}
        for at, b in zip(t, size, strict=True):
            times, sizes = fresh.setdefault(at - at % MINUTE, ([], []))
            times.append(at)
            sizes.append(b)
        for minute, (times, sizes) in fresh.items():
            old = ring.get(minute, ([], []))
            if minute + MINUTE > oldest:
                self.ring.updateValue((minute,), (old[0] + times, old[1] + sizes))
        for minute in ring:
            if minute + MINUTE <= oldest:
                self.ring.removeKey((minute,))


def _keyed(rows: DataFrame, key: str, processor: Expiring, extra: Sequence[tuple[str, T.DataType]], watermark: str) -> DataFrame:
    """`rows` (with t_us) and the columns that `processor` adds."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in extra]])
    if processor.by_event:
        rows = rows.withColumn("_event_time", F.timestamp_micros("t_us")).withWatermark("_event_time", watermark)
    mode = "EventTime" if processor.by_event else "ProcessingTime"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode=mode).drop("t_us")


def history_features(
    events: DataFrame,
    windows: Mapping[str, int] = WINDOWS,
    session_s: int = SESSION_TTL,
    port_s: int = PORT_TTL,
    key: str = "source_ip",
    ts: str = "timestamp",
    expire: str = "event",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Event columns plus the features of the source's earlier events, in the session form."""
    extra = [(f"conn_count_{w}", T.LongType()) for w in windows]
    extra += [(n, T.LongType()) for n in _OUTPUT] + [("is_novel_port", T.BooleanType())]
    rows = events.withColumn("t_us", micros(events, ts))
    return _keyed(rows, key, SourceHistory(windows, session_s, port_s, expire), extra, watermark)


def window_features(
    events: DataFrame,
    windows: Mapping[str, int] = WINDOWS,
    port_s: int = PORT_TTL,
    country_s: int = COUNTRY_TTL,
    key: str = "source_ip",
    ts: str = "timestamp",
    expire: str = "event",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Event columns plus the window form of the features, equal to the batch ones for input in time order.

    Distinct values, counts and moments of bytes per trailing window; first use of a port, and of a country where
    `events` has such a column. A late row that the watermark lets pass sees last uses that are newer than itself.
    """
    distinct = {"unique_dst_ips": ("destination_ip", list(windows)), "unique_dst_ports": ("destination_port", list(windows)), "unique_protocols": ("protocol", ["1min"])}
    novel = {"is_novel_port": ("port_text", port_s)} | ({"is_new_country": ("country", country_s)} if "country" in events.columns else {})
    extra = [(f"conn_count_{w}", T.LongType()) for w in windows]
    extra += [("payload_size_mean", T.DoubleType()), ("payload_size_stddev", T.DoubleType())]
    extra += [(f"{p}_{w}", T.LongType()) for p, (_, wanted) in distinct.items() for w in wanted]
    extra += [(n, T.BooleanType()) for n in novel]
    port = F.coalesce(F.col("destination_port").cast("string"), F.lit("none"))
    rows = events.withColumn("t_us", micros(events, ts)).withColumn("port_text", port)
    processor = WindowHistory(windows, distinct, "1hour", novel, expire)
    return _keyed(rows, key, processor, extra, watermark).drop("port_text")


class CallLog(Expiring):
    """Allowed call times of one client."""

    def __init__(self, max_calls: int, window_s: int, expire: str = "event") -> None:
        super().__init__(expire)
        self.max_calls, self.window = max_calls, window_s * US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start(handle)
        self.log = self.value_state("log", "t array<long>", self.window)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _Batch(rows)
        row, last = self.log.get(), self.last()
        log = list(row[0]) if row is not None else []
        allowed = []
        for t in batch.t[batch.order].tolist():
            log = [x for x in log if t - x < self.window]
            allowed.append(len(log) < self.max_calls)
            if allowed[-1]:
                log.append(t)
            last = t if last is None else max(last, t)
        self.log.update((log,))
        self.touch(last)
        yield from batch.results({"allowed": allowed})


def limit_stream(
    calls: DataFrame,
    max_calls: int,
    window_s: int,
    key: str = "source_ip",
    ts: str = "timestamp",
    expire: str = "event",
    watermark: str = WATERMARK,
) -> DataFrame:
    rows = calls.withColumn("t_us", micros(calls, ts))
    return _keyed(rows, key, CallLog(max_calls, window_s, expire), [("allowed", T.BooleanType())], watermark)
