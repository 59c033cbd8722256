"""The 25-number feature vector of network events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.functions.decisions import is_http, off_hours
from hawkframe.functions.text import entropy
from hawkframe.operators.intel import add_ioc_flag, add_reputation, peer_scores, with_country
from hawkframe.operators.rules import Rule, matched_rules, technique_list
from hawkframe.operators.sliced import fitted_slice, lookup_join
from hawkframe.operators.state import (
    latest_per_event,
    novel_in_session,
    session_distinct,
    trailing,
)
from hawkframe.schemas import FEATURES, PORT_TTL, WINDOWS
from hawkframe.session import durable

COUNTRY_TTL = 7 * 86400


def extract_features(
    events: DataFrame,
    windows: Mapping[str, int] | None = None,
    compat: bool = False,
    reputation: DataFrame | None = None,
    iocs: DataFrame | None = None,
    rules: list[Rule] | None = None,
    ranges: DataFrame | None = None,
    assets: DataFrame | None = None,
) -> DataFrame:
    """One row per event with the model input columns in `FEATURES` order.

    `windows` overrides the look-back seconds of `1min`, `5min` and `1hour`.
    With `compat` the distinct counts run over the source's session and the
    fields that need tables of their own (country, peers, techniques, byte
    deviation) stay constant; otherwise all of them are computed.  Long texts
    are reduced to numbers first and that narrow table is written once, as
    every feature family reads it.
    """
    windows = {**WINDOWS, **(windows or {})}
    matched = matched_rules(rules) if rules and not compat else None
    techniques = technique_list(matched) if matched is not None else F.array().cast("array<string>")
    rows = events.select(*NARROW, *narrowed(techniques))
    # A repeated event id of a source counts once, with its latest time.
    rows = latest_per_event(rows)
    rows = _coded(durable(rows), windows) if compat else _designed(rows, windows, ranges, assets)
    rows = add_reputation(rows, reputation) if reputation is not None else _zero(rows, "ip_reputation_score")
    rows = add_ioc_flag(rows, iocs) if iocs is not None else _zero(rows, "ioc_matches")
    return model_input(rows)


NARROW = ["event_id", "timestamp", "source_ip", "destination_ip", "destination_port", "protocol", "bytes_sent"]


def narrowed(techniques: Column) -> list[Column]:
    """What an event says by itself: long texts as numbers, flags, matched techniques."""
    return [
        entropy(F.col("payload")).alias("payload_entropy"),
        entropy(F.col("dns_query")).alias("dns_entropy"),
        entropy(F.col("http_user_agent")).alias("http_ua_entropy"),
        off_hours(F.col("timestamp")).alias("off_hours_activity"),
        is_http(F.col("protocol")).alias("is_http"),
        (F.col("protocol") == "dns").alias("is_dns"),
        (F.col("protocol") == "ssh").alias("is_ssh"),
        techniques.alias("mitre_techniques"),
        F.size(techniques).alias("mitre_technique_count"),
    ]


def model_input(rows: DataFrame) -> DataFrame:
    """The event's head and the model input in its fixed order."""
    head = [c for c in NARROW if c != "bytes_sent"]
    return rows.select(*head, "mitre_techniques", *[_as_number(rows, f) for f in FEATURES])


def session_form(rows: DataFrame, windows: Mapping[str, int]) -> DataFrame:
    """Session counts stand for those of all windows; what needs tables of its own is constant."""
    return rows.select(
        "*",
        *[F.col("unique_dst_ips").alias(f"unique_dst_ips_{w}") for w in windows],
        *[F.col("unique_dst_ports").alias(f"unique_dst_ports_{w}") for w in windows],
        F.col("unique_protocols").alias("unique_protocols_1min"),
        F.col("bytes_sent").cast("double").alias("payload_size_mean"),
        F.lit(0.0).alias("payload_size_stddev"),
        F.lit(False).alias("is_new_country"),
        F.lit(0.0).alias("peer_deviation_score"),
    )


def _zero(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(0))


def _as_number(df: DataFrame, name: str) -> Column:
    if name.startswith("is_") or name == "off_hours_activity":
        return F.col(name).cast("int").alias(name)
    return F.col(name)


def _coded(rows: DataFrame, windows: Mapping[str, int]) -> DataFrame:
    """Each family takes the rows of the one before and adds its columns; none is joined back."""
    attributes = {"unique_dst_ips": "destination_ip", "unique_dst_ports": "destination_port", "unique_protocols": "protocol"}
    out = novel_in_session(session_distinct(rows, attributes), "destination_port")
    return session_form(trailing(out, windows, slice_us=fitted_slice(rows, "source_ip", "timestamp")), windows)


def _designed(
    rows: DataFrame,
    windows: Mapping[str, int],
    ranges: DataFrame | None,
    assets: DataFrame | None,
) -> DataFrame:
    # A port is always a value, a country only where the address has one.
    out = rows.withColumn("_port", F.coalesce(F.col("destination_port").cast("string"), F.lit("none")))
    novel = {"is_novel_port": ("_port", PORT_TTL)}
    if ranges is not None:
        out = with_country(out, ranges)
        novel["is_new_country"] = ("country", COUNTRY_TTL)
    out = counted = durable(out)
    out = trailing(
        out,
        windows,
        distinct={
            "unique_dst_ips": list(windows),
            "unique_dst_ports": list(windows),
            "unique_protocols": ["1min"],
        },
        columns={
            "unique_dst_ips": "destination_ip",
            "unique_dst_ports": "destination_port",
            "unique_protocols": "protocol",
        },
        stats={"bytes_sent": "1hour"},
        novel=novel,
        slice_us=fitted_slice(out, "source_ip", "timestamp"),
    ).withColumnsRenamed(
        {"bytes_sent_mean": "payload_size_mean", "bytes_sent_stddev": "payload_size_stddev"}
    )
    if ranges is None:
        out = out.withColumn("is_new_country", F.lit(False))
    if assets is None:
        return out.withColumn("peer_deviation_score", F.lit(0.0))
    peers = peer_scores(counted, assets).select("source_ip", "peer_deviation_score")
    out = lookup_join(out, peers, ["source_ip"])
    return out.withColumn("peer_deviation_score", F.coalesce("peer_deviation_score", F.lit(0.0)))


def feature_array(features: list[str] = FEATURES) -> Column:
    """The model input as 32-bit floats."""
    return F.array(*[F.col(f).cast("float") for f in features])
