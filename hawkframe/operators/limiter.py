"""Sliding-log rate limiting and keep-first suppression over event tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkframe.operators.sliced import RANK_ROWS, US, micros, null_safe_join, number_slices, sessionize
from hawkframe.operators.state import trailing
from hawkframe.session import durable


def _walk(times: np.ndarray, log: deque, max_calls: int, window: int):
    """Decide one run of sorted calls; `log` holds the allowed times and is updated."""
    allowed = np.zeros(len(times), dtype=bool)
    wait = np.zeros(len(times), dtype=np.int64)
    i = 0
    while i < len(times):
        while log and times[i] - log[0] >= window:
            log.popleft()
        if len(log) < max_calls:
            allowed[i] = True
            log.append(int(times[i]))
            i += 1
            continue
        free_at = log[0] + window
        j = int(np.searchsorted(times, free_at, side="left"))
        wait[i:j] = free_at - times[i:j]
        i = j
    return allowed, wait


def limit_calls(
    calls: DataFrame,
    max_calls: int,
    window_s: int,
    key: str = "source_ip",
    ts: str = "timestamp",
    order_id: str = "event_id",
    slice_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add `allowed` and `wait_s` (time until a denied call could pass).

    A call passes when fewer than `max_calls` passed calls lie less than the
    window before it; denied calls leave no trace.  Two exact cuts keep most
    of the work in the JVM: a pause of a whole window empties the log, and a
    burst with too few calls to fill the log passes as a whole.  Bursts that
    reach the limit are cut into slices of about `slice_rows` calls, which are
    walked side by side, each from the log that holds at its first call.
    """
    window = window_s * US
    base = calls.select(
        F.col(key).alias("_key"), F.col(order_id).alias("event_id"), F.col(ts).alias("_ts"), micros(calls, ts).alias("_t"), F.struct(*calls.columns).alias("_row")
    )
    bursts = sessionize(base, ["_key"], "_t", "event_id", window)
    # A call less than a window back sits in the same burst; the longest
    # window below `window` is one microsecond shorter.
    busy = (
        trailing(bursts.drop("_row"), {"w": window_s - 1 / US}, key="_key", ts="_ts")
        .filter(F.col("conn_count_w") >= max_calls)
        .select("_key", "session_start")
        .distinct()
        .withColumn("_busy", F.lit(True))
    )
    flagged = durable(
        null_safe_join(bursts, busy, ["_key", "session_start"], "left").select(
            F.struct("_key", "session_start").alias("_burst"), "event_id", "_t", "_row", "_busy"
        )
    )
    calm = flagged.filter("_busy is null").select("_row", F.lit(True).alias("allowed"), F.lit(0.0).alias("wait_s"))
    sliced = number_slices(flagged.filter("_busy").drop("_busy"), F.struct("_burst", "_t", "event_id"), slice_rows)
    logs = _entry_logs(sliced, max_calls, window)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, deque()
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("_vs", "_key", "session_start")), strict=True))
            given, real = batch.column("_log"), batch.column("_t").is_valid().to_numpy(zero_copy_only=False)
            times = batch.column("_t").fill_null(0).to_numpy()
            # A run ends where the burst changes; a row that brings a log is a run of its own.
            starts = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1] or not real[i] or not real[i - 1]]
            allowed = np.zeros(len(times), dtype=bool)
            wait = np.zeros(len(times), dtype=np.int64)
            for a, b in zip(starts, [*starts[1:], len(times)]):
                if not real[a]:
                    current, log = marks[a], deque(given[a].as_py())
                    continue
                if marks[a] != current:
                    current, log = marks[a], deque()
                allowed[a:b], wait[a:b] = _walk(times[a:b], log, max_calls, window)
            out = [batch.column("_row"), pa.array(allowed), pa.array(wait / US)]
            yield pa.RecordBatch.from_arrays([column.filter(pa.array(real)) for column in out], names=["_row", "allowed", "wait_s"])

    # The call itself goes through as it is, so repeated ids stay rows of their own.
    walked = (
        sliced.unionByName(logs, allowMissingColumns=True)
        .repartition("_vs")
        .sortWithinPartitions("_vs", "_burst", F.asc_nulls_first("_t"), "event_id")
        .select("_vs", "_burst.*", "_t", "_row", "_log")
        .mapInArrow(decide, calm.schema)
    )
    return calm.unionByName(walked).select(*[F.col("_row").getField(c).alias(c) for c in calls.columns], "allowed", "wait_s")


def _entry_logs(sliced: DataFrame, max_calls: int, window: int) -> DataFrame:
    """`_log`: the allowed times that still count where a burst goes on into a later slice.

    Only bursts over more than one slice are followed, at most one more piece than there are slices. Their call times
    alone, an array per piece, pass the one task of a burst; it looks at allowed calls only and holds a piece at a time.
    """
    torn = sliced.groupBy("_burst").agg(F.min("_vs").alias("_first"), F.max("_vs").alias("_last")).filter("_first < _last")
    pieces = (
        sliced.join(torn.select("_burst"), "_burst")
        .groupBy("_burst", "_vs")
        .agg(F.sort_array(F.collect_list("_t")).alias("_times"))
        .repartition("_burst")
        .sortWithinPartitions("_burst", "_vs")
    )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, deque()
        for batch in batches:
            held = []
            for i in range(batch.num_rows):
                burst = batch.column("_burst")[i].as_py()
                if burst != current:
                    current, log = burst, deque()
                held.append(list(log))
                _walk(batch.column("_times")[i].values.to_numpy(), log, max_calls, window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_burst"), batch.column("_vs"), pa.array(held, pa.list_(pa.int64()))], names=["_burst", "_vs", "_log"]
            )

    schema = T.StructType([pieces.schema["_burst"], pieces.schema["_vs"], T.StructField("_log", T.ArrayType(T.LongType()))])
    return pieces.mapInArrow(follow, schema)


def keep_first(
    alerts: DataFrame,
    window_s: int = 60,
    keys: Sequence[str] = ("source_ip", "threat_type"),
    ts: str = "timestamp",
    order_id: str = "alert_id",
) -> DataFrame:
    """Suppress alerts less than the window after the last *kept* one of the key."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    marked = limit_calls(
        alerts.withColumn("_key", key), 1, window_s, key="_key", ts=ts, order_id=order_id
    )
    return marked.select(*alerts.columns, (~F.col("allowed")).alias("is_duplicate"))
