"""Windowed and grouped event statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.operators.sliced import exact_quantiles, micros


def tumble_features(
    df: DataFrame, length: str, key: str = "source_ip", ts: str = "timestamp"
) -> DataFrame:
    """Counts, distinct destinations and byte moments per source and tumbling window."""
    return (
        df.groupBy(key, F.window(ts, length).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("connection_count"),
            F.countDistinct("destination_ip").alias("unique_dst_ips"),
            F.countDistinct("destination_port").alias("unique_dst_ports"),
            F.avg("bytes_sent").alias("avg_bytes_sent"),
            F.coalesce(F.stddev_samp("bytes_sent"), F.lit(0.0)).alias("stddev_bytes_sent"),
        )
        .select(
            key,
            F.col("_w.end").alias("window_end"),
            "connection_count",
            "unique_dst_ips",
            "unique_dst_ports",
            "avg_bytes_sent",
            "stddev_bytes_sent",
        )
    )


def protocol_distribution(df: DataFrame, key: str = "source_ip") -> DataFrame:
    return df.groupBy(key, "protocol").agg(F.count(F.lit(1)).alias("n"))


def protocol_map(df: DataFrame, key: str = "source_ip") -> DataFrame:
    """One row per source with a protocol -> count map (at most one entry per protocol)."""
    return (
        protocol_distribution(df, key)
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("protocol", "n"))).alias("protocols"))
    )


def byte_percentiles(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return exact_quantiles(df, "bytes_sent", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by)


def pair_rate(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Requests per second of each source and destination over their common span."""
    t = micros(df, ts)
    grouped = df.groupBy("source_ip", "destination_ip").agg(
        F.count(F.lit(1)).alias("n"), ((F.max(t) - F.min(t)) / 1e6).alias("span_s")
    )
    rate = F.when(F.col("span_s") > 0, F.col("n") / F.col("span_s")).otherwise(0.0)
    return grouped.withColumn("rate", rate)


def rate_per_window(
    df: DataFrame, label: str, seconds: int, ts: str = "timestamp"
) -> DataFrame:
    """Events per second by label and window."""
    return (
        df.groupBy(label, F.window(ts, f"{seconds} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            label,
            F.col("_w.start").alias("window_start"),
            "n",
            (F.col("n") / float(seconds)).alias("rate"),
        )
    )


def ratio_per_window(
    df: DataFrame, hit: Column, seconds: int, ts: str = "timestamp"
) -> DataFrame:
    """Share of rows with `hit` per window, and its complement."""
    return (
        df.groupBy(F.window(ts, f"{seconds} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
        .select(
            F.col("_w.start").alias("window_start"),
            "n",
            "hits",
            (F.col("hits") / F.col("n")).alias("ratio"),
            (1 - F.col("hits") / F.col("n")).alias("availability"),
        )
    )
