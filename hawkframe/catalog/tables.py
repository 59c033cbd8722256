"""The driver's test tables seen as security events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROTOCOL_OF = {
    "click": "http",
    "view": "https",
    "error": "dns",
    "signup": "ssh",
    "purchase": "tcp",
}
STAGE_OF = {"click": "recon", "error": "exploitation", "purchase": "lateral_movement"}

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROTOCOL_OF.items())
_STAGE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items())

NET_SQL = f"""net AS (
  SELECT event_id, ts, user_id, event_type AS kind, value, k,
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS source_ip,
         '172.16.0.' || CAST(k AS VARCHAR) AS destination_ip,
         CAST(k AS INTEGER) AS destination_port,
         CASE event_type {_CASE} END AS protocol,
         CASE event_type {_STAGE} ELSE 'other' END AS stage,
         CAST(round(value * 100) AS BIGINT) AS bytes_sent,
         props AS payload,
         CASE WHEN event_type = 'error' THEN 'h' || CAST(event_id AS VARCHAR) || '.example.com' END AS dns_query,
         CASE WHEN event_type IN ('click', 'view') THEN event_type || '/' || CAST(user_id AS VARCHAR) END AS http_user_agent,
         epoch_us(ts) AS t
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the shape of network events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    kind = F.col("event_type")
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    text = lambda c: c.cast("string")
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        "user_id",
        kind.alias("kind"),
        "value",
        F.concat(
            F.lit("10.0."), text(F.expr("user_id div 256")), F.lit("."), text(F.pmod(user, F.lit(256)))
        ).alias("source_ip"),
        F.concat(F.lit("172.16.0."), text(k)).alias("destination_ip"),
        k.alias("destination_port"),
        F.try_element_at(pairs(PROTOCOL_OF), kind).alias("protocol"),
        F.coalesce(F.try_element_at(pairs(STAGE_OF), kind), F.lit("other")).alias("stage"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes_sent"),
        F.col("props").alias("payload"),
        F.when(kind == "error", F.concat(F.lit("h"), text(F.col("event_id")), F.lit(".example.com"))).alias("dns_query"),
        F.when(kind.isin("click", "view"), F.concat(kind, F.lit("/"), text(user))).alias("http_user_agent"),
    )


# Alerts derived from events: the score is the event's value scaled to 0..1.
ALERT_SQL = (
    NET_SQL
    + """, alerts AS (
  SELECT 'alert-' || CAST(event_id AS VARCHAR) AS alert_id, event_id, ts, t, source_ip, destination_ip,
         kind AS threat_type, destination_port, value,
         round(value / 500, 4) AS threat_score,
         CAST(event_id % 5 AS DOUBLE) - 0.5 AS anomaly
  FROM net
), graded AS (
  SELECT *, CASE WHEN threat_score > 0.9 OR anomaly > 3 THEN 'critical'
                 WHEN threat_score > 0.75 OR anomaly > 2 THEN 'high'
                 WHEN threat_score > 0.5 OR anomaly > 1 THEN 'medium'
                 ELSE 'low' END AS severity
  FROM alerts
)"""
)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the shape of scored alerts."""
    from hawkframe.functions.decisions import recommended_action, severity

    n = network(spark, sf_dir)
    score = F.round(F.col("value") / 500, 4)
    anomaly = F.pmod("event_id", F.lit(5)).cast("double") - 0.5
    return n.select(
        F.concat(F.lit("alert-"), F.col("event_id").cast("string")).alias("alert_id"),
        "event_id",
        "timestamp",
        "source_ip",
        "destination_ip",
        F.col("kind").alias("threat_type"),
        "destination_port",
        score.alias("threat_score"),
        anomaly.alias("anomaly"),
        severity(score, anomaly).alias("severity"),
        recommended_action(severity(score, anomaly)).alias("recommended_action"),
    )


# Documents joined with their labels: score with many ties, prediction, class.
SCORED_SQL = """scored AS (
  SELECT l.doc_id, l.quality, l.toxic AS label, (d.n_chars % 101) / 100.0 AS score,
         ((d.n_chars + l.toxic * 30) % 101) / 100.0 AS score_b,
         CAST((d.n_chars % 101) / 100.0 > 0.5 AS INTEGER) AS pred
  FROM labels l JOIN documents d USING (doc_id)
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.pmod("n_chars", F.lit(101)) / 100.0
    return l.join(d, "doc_id").select(
        "doc_id",
        "quality",
        F.col("toxic").alias("label"),
        score.alias("score"),
        (F.pmod(F.col("n_chars") + F.col("toxic") * 30, F.lit(101)) / 100.0).alias("score_b"),
        (score > 0.5).cast("int").alias("pred"),
    )


# Intel derived from part: sizes 1..50 stand for known addresses.
INTEL_SQL = """intel AS (
  SELECT '172.16.0.' || CAST(p_size AS VARCHAR) AS destination_ip,
         CAST((p_size * 13 + count(*)) % 161 - 80 AS INTEGER) AS score
  FROM part GROUP BY p_size
)"""


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    score = (F.col("p_size") * 13 + F.col("n")) % 161 - 80
    return (
        p.groupBy("p_size")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("172.16.0."), F.col("p_size").cast("string")).alias("destination_ip"),
            score.cast("int").alias("score"),
        )
    )


# Asset groups: customers' nations stand for the groups of the sources.
ASSET_SQL = """assets AS (
  SELECT '10.0.' || CAST(c_custkey // 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS source_ip,
         n_regionkey AS asset_group
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(
            F.lit("10.0."),
            F.expr("c_custkey div 256").cast("string"),
            F.lit("."),
            F.pmod("c_custkey", F.lit(256)).cast("string"),
        ).alias("source_ip"),
        F.col("n_regionkey").alias("asset_group"),
    )


# Address ranges: one block of 40 addresses per nation, with holes between.
RANGE_SQL = """ranges AS (
  SELECT 167772160 + n_nationkey * 50 AS start_ip, 167772160 + n_nationkey * 50 + 39 AS end_ip, n_name AS country
  FROM nation
)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    start = F.lit(167772160).cast("bigint") + F.col("n_nationkey") * 50
    return n.select(start.alias("start_ip"), (start + 39).alias("end_ip"), F.col("n_name").alias("country"))
