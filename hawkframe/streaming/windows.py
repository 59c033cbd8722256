"""Event-time windows, sessions and duplicate suppression on streams.

All work with a watermark: rows later than it are dropped and counted in the
query progress (`late_rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Watermarks need a zoned timestamp; a zone-free one is read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def tumbling_stream(
    events: DataFrame,
    length: str,
    watermark: str = "10 minutes",
    key: str = "source_ip",
    ts: str = "timestamp",
    exact: bool = False,
) -> DataFrame:
    """Per source and window: counts, distinct destinations, byte moments.

    Exact distinct counts are not available in one streaming aggregate; by
    default sketches of fixed size count them, with `exact` the window keeps
    its values in state.
    """
    if exact:
        distinct = lambda c: F.size(F.collect_set(c)).cast("bigint")
    else:
        distinct = F.approx_count_distinct
    return (
        _timed(events, ts, watermark)
        .groupBy(key, F.window(ts, length).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("connection_count"),
            distinct("destination_ip").alias("unique_dst_ips"),
            distinct("destination_port").alias("unique_dst_ports"),
            F.avg("bytes_sent").alias("avg_bytes_sent"),
            F.coalesce(F.stddev_samp("bytes_sent"), F.lit(0.0)).alias("stddev_bytes_sent"),
        )
        .select(key, F.col("_w.end").alias("window_end"), "connection_count", "unique_dst_ips", "unique_dst_ports", "avg_bytes_sent", "stddev_bytes_sent")
    )


def session_stream(
    events: DataFrame, gap: str, watermark: str = "10 minutes", key: str = "source_ip", ts: str = "timestamp"
) -> DataFrame:
    return (
        _timed(events, ts, watermark)
        .groupBy(key, F.session_window(ts, gap).alias("_s"))
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count(F.lit(1)).alias("n"))
        .select(key, "session_start", "last_event", "n")
    )


def suppress_repeats(
    alerts: DataFrame,
    window: str = "60 seconds",
    keys: tuple[str, ...] = ("source_ip", "threat_type"),
    ts: str = "timestamp",
) -> DataFrame:
    """Keep the first alert of a key until the watermark has passed it by `window`.

    Unlike `dedup_alerts` it drops repeats, and expiry follows the watermark.
    """
    return _timed(alerts, ts, window).dropDuplicatesWithinWatermark(list(keys))


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late in the retained progress of a query."""
    return sum(
        int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"]
    )
