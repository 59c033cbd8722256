"""Feature, window and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkframe.catalog.registry import query, r6
from hawkframe.catalog.tables import (
    ASSET_SQL,
    INTEL_SQL,
    NET_SQL,
    RANGE_SQL,
    assets,
    network,
    ranges,
    reputation,
    table,
)
from hawkframe.operators import intel, tumbling
from hawkframe.operators.rules import Rule
from hawkframe.operators.state import (
    conn_counts,
    latest_per_event,
    not_seen_within,
    novel_in_session,
    session_distinct,
    trailing,
    window_distinct_approx,
)
from hawkframe.plans.features import extract_features, feature_array
from hawkframe.plans.scoring import batch_score, score_events, top_features
from hawkframe.schemas import FEATURES

LONG_WINDOWS = {"1min": 60, "5min": 300, "1hour": 3600, "6hour": 21600, "1day": 86400}


def _conn_sql(seconds: int) -> str:
    return (
        f"count(*) OVER (PARTITION BY source_ip ORDER BY t RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW)"
        " - (count(*) OVER (PARTITION BY source_ip, t) - row_number() OVER (PARTITION BY source_ip, t ORDER BY event_id) + 1)"
    )


def _distinct_sql(column: str, seconds: int) -> str:
    return (
        f"count(DISTINCT {column}) OVER (PARTITION BY source_ip ORDER BY t "
        f"RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW)"
    )


def _session_sql(gap: int, source: str = "net") -> str:
    """Session numbers of each source with an inactivity gap in seconds."""
    return f"""marked AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source_ip ORDER BY t, event_id) < {gap * 1_000_000} THEN 0 ELSE 1 END AS brk
  FROM {source}
), sess AS (
  SELECT *, sum(brk) OVER (PARTITION BY source_ip ORDER BY t, event_id) AS sid FROM marked
)"""


def _first_in_session(column: str) -> str:
    return f"CASE WHEN row_number() OVER (PARTITION BY source_ip, sid, {column} ORDER BY t, event_id) = 1 THEN 1 ELSE 0 END"


@query(
    "conn_counts",
    f"WITH {NET_SQL} SELECT event_id, "
    + ", ".join(f"{_conn_sql(s)} AS conn_count_{w}" for w, s in LONG_WINDOWS.items())
    + " FROM net",
)
def q_conn_counts(spark, sf):
    out = conn_counts(network(spark, sf), LONG_WINDOWS)
    return out.select("event_id", *[f"conn_count_{w}" for w in LONG_WINDOWS])


def _running_firsts(columns: dict[str, str], gap: int) -> str:
    flags = ", ".join(f"{_first_in_session(c)} AS f_{n}" for n, c in columns.items())
    sums = ", ".join(
        f"CAST(coalesce(sum(f_{n}) OVER (PARTITION BY source_ip, sid ORDER BY t, event_id "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {n}"
        for n in columns
    )
    return f"WITH {NET_SQL}, {_session_sql(gap)}, flagged AS (SELECT *, {flags} FROM sess) SELECT event_id, {sums} FROM flagged"


_SESSION_COLUMNS = {"dst_ips": "destination_ip", "dst_ports": "destination_port", "protocols": "protocol"}


@query("distinct_session", _running_firsts(_SESSION_COLUMNS, 6 * 3600))
def q_distinct_session(spark, sf):
    out = session_distinct(network(spark, sf), _SESSION_COLUMNS, gap_s=6 * 3600)
    return out.select("event_id", *_SESSION_COLUMNS)


@query(
    "distinct_window",
    f"WITH {NET_SQL} SELECT event_id, {_distinct_sql('destination_port', 3600)} AS ports_1hour, "
    f"{_distinct_sql('destination_port', 86400)} AS ports_1day, {_distinct_sql('protocol', 86400)} AS protocols_1day FROM net",
)
def q_distinct_window(spark, sf):
    out = trailing(
        network(spark, sf),
        {"1hour": 3600, "1day": 86400},
        distinct={"ports": ["1hour", "1day"], "protocols": ["1day"]},
        columns={"ports": "destination_port", "protocols": "protocol"},
        counts=False,
    )
    return out.select("event_id", "ports_1hour", "ports_1day", "protocols_1day")


@query("distinct_window_approx")
def q_distinct_window_approx(spark, sf):
    out = window_distinct_approx(network(spark, sf), "destination_port", 86400, "ports_1day")
    return out.select("event_id", "ports_1day")


@query(
    "novel_port_session",
    f"WITH {NET_SQL}, {_session_sql(30 * 86400)} SELECT event_id, {_first_in_session('destination_port')} = 1 AS is_novel_port FROM sess",
)
def q_novel_port_session(spark, sf):
    return novel_in_session(network(spark, sf), "destination_port").select("event_id", "is_novel_port")


def _unseen_sql(column: str, seconds: int, alias: str, source: str = "net") -> str:
    lag = f"lag(t) OVER (PARTITION BY source_ip, {column} ORDER BY t, event_id)"
    return f"coalesce(t - {lag} > {seconds * 1_000_000}, true) AS {alias}"


@query(
    "novel_port_30d",
    f"WITH {NET_SQL} SELECT event_id, {_unseen_sql('destination_port', 30 * 86400, 'is_novel_port')}, "
    f"{_unseen_sql('destination_port', 86400, 'is_novel_port_1d')} FROM net",
)
def q_novel_port_30d(spark, sf):
    out = not_seen_within(network(spark, sf), "destination_port", "is_novel_port", 30 * 86400)
    out = not_seen_within(out, "destination_port", "is_novel_port_1d", 86400)
    return out.select("event_id", "is_novel_port", "is_novel_port_1d")


_GEO_SQL = f"""{NET_SQL}, {RANGE_SQL}, geo AS (
  SELECT net.*, country FROM net LEFT JOIN ranges
    ON 167772160 + (user_id // 256) * 256 + user_id % 256 BETWEEN start_ip AND end_ip
)"""


@query("range_geo", f"WITH {_GEO_SQL} SELECT event_id, source_ip, country FROM geo")
def q_range_geo(spark, sf):
    out = intel.add_country(network(spark, sf), ranges(spark, sf))
    return out.select("event_id", "source_ip", "country")


@query(
    "new_country",
    f"WITH {_GEO_SQL} SELECT event_id, {_unseen_sql('country', 7 * 86400, 'is_new_country')} FROM geo WHERE country IS NOT NULL",
)
def q_new_country(spark, sf):
    out = intel.add_country(network(spark, sf), ranges(spark, sf)).filter("country is not null")
    return not_seen_within(out, "country", "is_new_country", 7 * 86400).select("event_id", "is_new_country")


def _frame(seconds: int) -> str:
    return f"OVER (PARTITION BY source_ip ORDER BY t RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW)"


@query(
    "payload_stats",
    f"WITH {NET_SQL} SELECT event_id, round(avg(bytes_sent) {_frame(86400)}, 6) AS payload_size_mean, "
    f"round(coalesce(stddev_samp(bytes_sent) {_frame(86400)}, 0), 4) AS payload_size_stddev FROM net",
)
def q_payload_stats(spark, sf):
    out = trailing(network(spark, sf), {"1day": 86400}, stats={"bytes_sent": "1day"}, counts=False)
    return out.select(
        "event_id",
        r6("bytes_sent_mean").alias("payload_size_mean"),
        F.round("bytes_sent_stddev", 4).alias("payload_size_stddev"),
    )


_PEER_SQL = f"""peers AS (
  SELECT source_ip, asset_group, conn_total,
         CASE WHEN stddev_pop(conn_total) OVER (PARTITION BY asset_group) > 0
              THEN (conn_total - avg(conn_total) OVER (PARTITION BY asset_group)) / stddev_pop(conn_total) OVER (PARTITION BY asset_group)
              ELSE 0 END AS z
  FROM (SELECT source_ip, count(*) AS conn_total FROM net GROUP BY 1) JOIN assets USING (source_ip)
)"""


@query(
    "peer_zscore",
    f"WITH {NET_SQL}, {ASSET_SQL}, {_PEER_SQL} SELECT source_ip, asset_group, conn_total, round(z, 6) AS peer_deviation_score FROM peers",
)
def q_peer_zscore(spark, sf):
    out = intel.peer_scores(network(spark, sf), assets(spark, sf))
    return out.select("source_ip", "asset_group", "conn_total", r6("peer_deviation_score"))


def _tumble_sql(interval: str) -> str:
    return f"""WITH {NET_SQL} SELECT source_ip, time_bucket(INTERVAL {interval}, ts) + INTERVAL {interval} AS window_end,
  count(*) AS connection_count, count(DISTINCT destination_ip) AS unique_dst_ips, count(DISTINCT destination_port) AS unique_dst_ports,
  round(avg(bytes_sent), 6) AS avg_bytes_sent, round(coalesce(stddev_samp(bytes_sent), 0), 4) AS stddev_bytes_sent
  FROM net GROUP BY 1, 2"""


def _tumble(name: str, length: str, interval: str) -> None:
    @query(name, _tumble_sql(interval))
    def q(spark, sf):
        out = tumbling.tumble_features(network(spark, sf), length)
        return out.withColumns(
            {"avg_bytes_sent": r6("avg_bytes_sent"), "stddev_bytes_sent": F.round("stddev_bytes_sent", 4)}
        )


_tumble("tumble_features_1m", "1 minute", "1 minute")
_tumble("tumble_features_5m", "5 minutes", "5 minutes")
_tumble("tumble_features_1h", "1 hour", "1 hour")


@query("proto_dist", f"WITH {NET_SQL} SELECT source_ip, protocol, count(*) AS n FROM net GROUP BY 1, 2")
def q_proto_dist(spark, sf):
    return tumbling.protocol_distribution(network(spark, sf))


def _pct(column: str) -> str:
    return ", ".join(f"round(quantile_cont({column}, {p}), 6) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))


@query("bytes_percentiles", f"WITH {NET_SQL} SELECT protocol, {_pct('bytes_sent')} FROM net GROUP BY 1")
def q_bytes_percentiles(spark, sf):
    out = tumbling.byte_percentiles(network(spark, sf), ("protocol",))
    return out.select("protocol", r6("p50"), r6("p90"), r6("p99"))


@query("price_percentiles", f"SELECT {_pct('l_extendedprice')} FROM lineitem")
def q_price_percentiles(spark, sf):
    from hawkframe.operators.sliced import exact_quantiles

    li = table(spark, sf, "lineitem").select("l_extendedprice")
    out = exact_quantiles(li, "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select(r6("p50"), r6("p90"), r6("p99"))


@query(
    "pair_rate",
    f"""WITH {NET_SQL}, g AS (SELECT source_ip, destination_ip, count(*) AS n, (max(t) - min(t)) / 1e6 AS span_s FROM net GROUP BY 1, 2)
    SELECT source_ip, destination_ip, n, round(CASE WHEN span_s > 0 THEN n / span_s ELSE 0 END, 9) AS rate FROM g""",
)
def q_pair_rate(spark, sf):
    out = tumbling.pair_rate(network(spark, sf))
    return out.select("source_ip", "destination_ip", "n", F.round("rate", 9).alias("rate"))


# Joins


@query(
    "join_reputation",
    f"WITH {NET_SQL}, {INTEL_SQL} SELECT event_id, greatest(-100, least(100, coalesce(score, 0))) AS ip_reputation_score FROM net LEFT JOIN intel USING (destination_ip)",
)
def q_join_reputation(spark, sf):
    out = intel.add_reputation(network(spark, sf), reputation(spark, sf))
    return out.select("event_id", "ip_reputation_score")


@query(
    "join_ioc_flag",
    f"WITH {NET_SQL}, {INTEL_SQL} SELECT event_id, CASE WHEN intel.score IS NULL THEN 0 ELSE 1 END AS ioc_matches FROM net LEFT JOIN intel ON net.destination_ip = intel.destination_ip AND intel.score < 0",
)
def q_join_ioc_flag(spark, sf):
    bad = reputation(spark, sf).filter("score < 0")
    return intel.add_ioc_flag(network(spark, sf), bad).select("event_id", "ioc_matches")


@query(
    "semi_ioc",
    f"WITH {NET_SQL}, {INTEL_SQL} SELECT event_id, source_ip, destination_ip FROM net WHERE destination_ip IN (SELECT destination_ip FROM intel WHERE score < 20)",
)
def q_semi_ioc(spark, sf):
    known = reputation(spark, sf).filter("score < 20")
    return intel.matching_events(network(spark, sf), known).select("event_id", "source_ip", "destination_ip")


@query(
    "join_ioc_multi",
    f"""WITH {NET_SQL}, {INTEL_SQL}, iocs AS (
      SELECT 'ip' AS ioc_type, destination_ip AS ioc_value FROM intel
      UNION SELECT 'domain', 'h' || CAST(p_partkey * 3 AS VARCHAR) || '.example.com' FROM part
      UNION SELECT 'hash', md5(CAST(p_partkey * 5 AS VARCHAR)) FROM part
    ), pairs AS (
      SELECT event_id, 'ip' AS ioc_type, destination_ip AS ioc_value FROM net
      UNION ALL SELECT event_id, 'domain', dns_query FROM net
      UNION ALL SELECT event_id, 'hash', md5(CAST(event_id AS VARCHAR)) FROM net
    ) SELECT event_id, count(iocs.ioc_value) AS ioc_matches FROM pairs LEFT JOIN iocs USING (ioc_type, ioc_value) GROUP BY 1""",
)
def q_join_ioc_multi(spark, sf):
    key = F.col("p_partkey")
    part = table(spark, sf, "part").select("p_partkey")
    known = (
        reputation(spark, sf)
        .select(F.lit("ip").alias("ioc_type"), F.col("destination_ip").alias("ioc_value"))
        .unionByName(
            part.select(
                F.lit("domain").alias("ioc_type"),
                F.concat(F.lit("h"), (key * 3).cast("string"), F.lit(".example.com")).alias("ioc_value"),
            )
        )
        .unionByName(
            part.select(F.lit("hash").alias("ioc_type"), F.md5((key * 5).cast("string").cast("binary")).alias("ioc_value"))
        )
    )
    events = network(spark, sf).withColumn("file_hash", F.md5(F.col("event_id").cast("string").cast("binary")))
    return intel.ioc_match_counts(
        events, {"ip": "destination_ip", "domain": "dns_query", "hash": "file_hash"}, known
    )


@query(
    "anti_known_ports",
    f"""WITH {NET_SQL}, history AS (SELECT DISTINCT source_ip, destination_port FROM net WHERE ts < TIMESTAMP '2024-01-15')
    SELECT event_id, source_ip, destination_port FROM net n WHERE ts >= TIMESTAMP '2024-01-15'
      AND NOT EXISTS (SELECT 1 FROM history h WHERE h.source_ip = n.source_ip AND h.destination_port = n.destination_port)""",
)
def q_anti_known_ports(spark, sf):
    n = network(spark, sf)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    out = intel.events_without(n.filter(F.col("timestamp") >= cut), n.filter(F.col("timestamp") < cut), ["source_ip", "destination_port"])
    return out.select("event_id", "source_ip", "destination_port")




@query(
    "join_tactic",
    f"""WITH {NET_SQL}, ev AS (
      SELECT event_id, unnest(list_distinct(['T' || CAST(1000 + destination_port AS VARCHAR), 'T' || CAST(1000 + event_id % 50 AS VARCHAR)])) AS technique FROM net
    ), tactics AS (SELECT 'T' || CAST(1000 + s_suppkey AS VARCHAR) AS technique, 'TA' || CAST(s_nationkey AS VARCHAR) AS tactic FROM supplier)
    SELECT event_id, technique, tactic FROM ev LEFT JOIN tactics USING (technique)""",
)
def q_join_tactic(spark, sf):
    name = lambda c: F.concat(F.lit("T"), (F.lit(1000) + c).cast("string"))
    events = network(spark, sf).select(
        "event_id",
        F.array_distinct(
            F.array(name(F.col("destination_port")), name(F.pmod("event_id", F.lit(50))))
        ).alias("techniques"),
    )
    tactics = table(spark, sf, "supplier").select(
        name(F.col("s_suppkey")).alias("technique"),
        F.concat(F.lit("TA"), F.col("s_nationkey").cast("string")).alias("tactic"),
    )
    return intel.add_tactics(events, "techniques", tactics).select("event_id", "technique", "tactic")


@query(
    "upsert_events",
    f"""WITH {NET_SQL}, keyed AS (SELECT source_ip, event_id // 3 AS event_id, ts, bytes_sent FROM net)
    SELECT source_ip, event_id, ts, bytes_sent FROM keyed
    QUALIFY row_number() OVER (PARTITION BY source_ip, event_id ORDER BY ts DESC) = 1""",
)
def q_upsert_events(spark, sf):
    n = network(spark, sf).select(
        "source_ip", F.expr("event_id div 3").alias("event_id"), "timestamp", "bytes_sent"
    )
    return latest_per_event(n).withColumnRenamed("timestamp", "ts")


# Feature vectors



def _event_sql(compat: bool) -> str:
    """All features of every event, as written down for the session or the window form."""
    base = f"""WITH {_GEO_SQL}, {INTEL_SQL}, {ASSET_SQL}, {_PEER_SQL},
    {_session_sql(3600, 'geo')}, long_marked AS (
      SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source_ip ORDER BY t, event_id) < {30 * 86400 * 1_000_000} THEN 0 ELSE 1 END AS lbrk FROM sess
    ), long_sess AS (SELECT *, sum(lbrk) OVER (PARTITION BY source_ip ORDER BY t, event_id) AS lsid FROM long_marked
    ), flagged AS (
      SELECT *, {_first_in_session('destination_ip')} AS f_ip, {_first_in_session('destination_port')} AS f_port,
             {_first_in_session('protocol')} AS f_proto,
             row_number() OVER (PARTITION BY source_ip, lsid, destination_port ORDER BY t, event_id) = 1 AS novel_s
      FROM long_sess
    )"""

    def sess(f: str) -> str:
        return (
            f"coalesce(sum({f}) OVER (PARTITION BY source_ip, sid ORDER BY t, event_id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        )

    spans = {"1min": 60, "5min": 300, "1hour": 3600}
    cols = {f"conn_count_{w}": _conn_sql(s) for w, s in spans.items()}
    for w, s in spans.items():
        cols[f"unique_dst_ips_{w}"] = sess("f_ip") if compat else _distinct_sql("destination_ip", s)
        cols[f"unique_dst_ports_{w}"] = sess("f_port") if compat else _distinct_sql("destination_port", s)
    cols["unique_protocols_1min"] = sess("f_proto") if compat else _distinct_sql("protocol", 60)
    cols["payload_size_mean"] = "bytes_sent" if compat else f"avg(bytes_sent) {_frame(3600)}"
    cols["payload_size_stddev"] = "0" if compat else f"coalesce(stddev_samp(bytes_sent) {_frame(3600)}, 0)"
    cols["is_novel_port"] = (
        "CAST(novel_s AS INTEGER)"
        if compat
        else "CAST(coalesce(t - lag(t) OVER (PARTITION BY source_ip, destination_port ORDER BY t, event_id) > 2592000000000, true) AS INTEGER)"
    )
    cols["is_new_country"] = (
        "0"
        if compat
        else "CASE WHEN country IS NULL THEN 0 ELSE CAST(coalesce(t - lag(t) OVER (PARTITION BY source_ip, country ORDER BY t, event_id) > 604800000000, true) AS INTEGER) END"
    )
    cols["off_hours_activity"] = "CASE WHEN hour(ts) BETWEEN 8 AND 17 THEN 0 ELSE 1 END"
    cols["peer_deviation_score"] = (
        "0" if compat else "coalesce((SELECT max(z) FROM peers p WHERE p.source_ip = flagged.source_ip), 0)"
    )
    cols["ip_reputation_score"] = (
        "coalesce((SELECT max(greatest(-100, least(100, score))) FROM intel i WHERE i.destination_ip = flagged.destination_ip), 0)"
    )
    cols["mitre_technique_count"] = (
        "0" if compat else "(CASE WHEN kind = 'error' THEN 2 ELSE 0 END + CASE WHEN destination_port < 20 THEN 1 ELSE 0 END)"
    )
    cols["ioc_matches"] = (
        "CASE WHEN EXISTS (SELECT 1 FROM intel i WHERE i.destination_ip = flagged.destination_ip AND score < 0) THEN 1 ELSE 0 END"
    )
    cols["is_http"] = "CASE WHEN protocol IN ('http', 'https') THEN 1 ELSE 0 END"
    cols["is_dns"] = "CASE WHEN protocol = 'dns' THEN 1 ELSE 0 END"
    cols["is_ssh"] = "CASE WHEN protocol = 'ssh' THEN 1 ELSE 0 END"
    for text, name in (("payload", "payload_entropy"), ("dns_query", "dns_entropy"), ("http_user_agent", "http_ua_entropy")):
        cols[name] = f"coalesce(CASE WHEN length({text}) > 0 THEN list_entropy(string_split({text}, '')) END, 0)"
    body = ", ".join(f"CAST({cols[f]} AS DOUBLE) AS {f}" for f in FEATURES)
    return f"{base}, feats AS (SELECT event_id, ts, source_ip, destination_ip, {body} FROM flagged)"


PORT_RULES = [
    Rule("exploit attempt", "high", ("T1190", "T1059"), {"kind": "ERROR"}),
    Rule("low port", "medium", ("T1021",), condition=lambda: F.col("destination_port") < 20),
]


def _features(spark, sf, compat: bool):
    bad = reputation(spark, sf).filter("score < 0")
    return extract_features(
        network(spark, sf),
        compat=compat,
        reputation=reputation(spark, sf),
        iocs=bad,
        rules=PORT_RULES,
        ranges=ranges(spark, sf),
        assets=assets(spark, sf),
    )


_ROUND = ", ".join(f"round({f}, 4) AS {f}" for f in FEATURES)


@query("extract_features", f"{_event_sql(False)} SELECT event_id, {_ROUND} FROM feats")
def q_extract_features(spark, sf):
    out = _features(spark, sf, compat=False)
    return out.select("event_id", *[F.round(F.col(f).cast("double"), 4).alias(f) for f in FEATURES])


@query(
    "feature_vector",
    f"{_event_sql(True)}, vec AS (SELECT event_id, [{', '.join(FEATURES)}] AS v FROM feats) "
    "SELECT event_id, i AS position, round(CAST(CAST(v[i] AS FLOAT) AS DOUBLE), 3) AS value FROM vec, range(1, 26) r(i)",
)
def q_feature_vector(spark, sf):
    out = _features(spark, sf, compat=True).select("event_id", feature_array().alias("v"))
    return out.select("event_id", F.posexplode("v").alias("position", "value")).select(
        "event_id",
        (F.col("position") + 1).cast("bigint").alias("position"),
        F.round(F.col("value").cast("double"), 3).alias("value"),
    )


@query(
    "score_events",
    f"""{_event_sql(False)} SELECT 'alert-' || CAST(event_id AS VARCHAR) AS alert_id, event_id, ts, source_ip, destination_ip,
      false AS is_threat, 0.1::DOUBLE AS threat_score, 'low' AS severity, 0.5::DOUBLE AS model_confidence,
      0.0::DOUBLE AS anomaly_score, 'Log for future analysis' AS recommended_action,
      CAST(ioc_matches AS INTEGER) AS ioc_matches, CAST(mitre_technique_count AS INTEGER) AS mitre_technique_count,
      conn_count_1min AS top_value_1, unique_dst_ports_1min AS top_value_2, round(payload_entropy, 6) AS top_value_3 FROM feats""",
)
def q_score_events(spark, sf):
    bad = reputation(spark, sf).filter("score < 0")
    out = score_events(
        network(spark, sf),
        reputation=reputation(spark, sf),
        iocs=bad,
        rules=PORT_RULES,
        ranges=ranges(spark, sf),
        assets=assets(spark, sf),
    )
    return out.select(
        "alert_id",
        "event_id",
        F.col("timestamp").alias("ts"),
        "source_ip",
        "destination_ip",
        "is_threat",
        "threat_score",
        "severity",
        "model_confidence",
        "anomaly_score",
        "recommended_action",
        "ioc_matches",
        "mitre_technique_count",
        *[F.round(F.get("top_features", F.lit(i))["value"], 6).alias(f"top_value_{i + 1}") for i in range(3)],
    )


@query(
    "top_features",
    f"""{_event_sql(True)} SELECT event_id, 1 AS place, 'conn_count_1min' AS feature, conn_count_1min AS value, 0.25::DOUBLE AS contribution FROM feats
    UNION ALL SELECT event_id, 2, 'unique_dst_ports_1min', unique_dst_ports_1min, 0.2 FROM feats
    UNION ALL SELECT event_id, 3, 'payload_entropy', round(payload_entropy, 6), 0.18 FROM feats""",
)
def q_top_features(spark, sf):
    out = extract_features(network(spark, sf), compat=True).select("event_id", F.posexplode(top_features()).alias("p", "f"))
    return out.select(
        "event_id",
        (F.col("p") + 1).alias("place"),
        "f.feature",
        F.round("f.value", 6).alias("value"),
        "f.contribution",
    )


@query(
    "batch_score",
    f"""WITH {NET_SQL}, checked AS (SELECT *, destination_port BETWEEN 0 AND 65535 AND bytes_sent % 70000 <= 65535 AND event_id % 97 <> 0 AS ok FROM net)
    SELECT protocol, count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed FROM checked GROUP BY 1""",
)
def q_batch_score(spark, sf):
    from hawkframe.sources.parse import batch_stats

    n = network(spark, sf).withColumns(
        {
            "source_port": F.pmod("bytes_sent", F.lit(70000)).cast("int"),
            "source_ip": F.when(F.pmod("event_id", F.lit(97)) == 0, "invalid.ip").otherwise(F.col("source_ip")),
            "source_system": F.lit("zeek"),
        }
    )
    alerts, rejected, _ = batch_score(n)
    # Totals recounted from the two outputs, so each event must end in one of them.
    done = alerts.select("event_id", F.lit(True).alias("ok")).unionByName(
        rejected.select("event_id", F.lit(False).alias("ok"))
    )
    joined = n.select("event_id", "protocol").join(done, "event_id")
    return batch_stats(joined, F.col("ok"), ("protocol",))
