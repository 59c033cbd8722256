"""Alert dedup, correlation, priority and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkframe.catalog.registry import query, r6
from hawkframe.catalog.tables import ALERT_SQL, NET_SQL, alerts, network, table
from hawkframe.functions import decisions
from hawkframe.operators import alerts as ops
from hawkframe.operators.intel import latest_intel
from hawkframe.operators.limiter import keep_first, limit_calls
from hawkframe.operators.sliced import micros, sessionize

DAY = 86400


def _chain_sql(keys: str, gap: int, source: str) -> str:
    return f"""marked AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t, event_id) < {gap * 1_000_000} THEN 0 ELSE 1 END AS brk FROM {source}
), chained AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY t, event_id) AS sid FROM marked)"""


@query(
    "dedup_alerts",
    f"""WITH {ALERT_SQL}, {_chain_sql('source_ip, threat_type', DAY, 'graded')}
    SELECT alert_id, brk = 0 AS is_duplicate,
      CASE WHEN brk = 0 THEN first_value(alert_id) OVER (PARTITION BY source_ip, threat_type, sid ORDER BY t, event_id) END AS original_alert_id FROM chained""",
)
def q_dedup_alerts(spark, sf):
    out = ops.dedup_alerts(alerts(spark, sf), DAY)
    return out.select("alert_id", "is_duplicate", "original_alert_id")


def _walk_sql(keys: str, max_calls: int, window: int) -> str:
    """Recursive walk over each key's calls, carrying the allowed times."""
    us = window * 1_000_000
    return f"""ordered AS (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, event_id) AS rn FROM graded
    ), walk AS (
      SELECT {keys}, event_id, t, rn, true AS allowed, [t] AS log, 0::DOUBLE AS wait_s FROM ordered WHERE rn = 1
      UNION ALL
      SELECT {', '.join('o.' + k.strip() for k in keys.split(','))}, o.event_id, o.t, o.rn,
        len([x FOR x IN w.log IF o.t - x < {us}]) < {max_calls},
        CASE WHEN len([x FOR x IN w.log IF o.t - x < {us}]) < {max_calls}
             THEN list_append([x FOR x IN w.log IF o.t - x < {us}], o.t) ELSE [x FOR x IN w.log IF o.t - x < {us}] END,
        CASE WHEN len([x FOR x IN w.log IF o.t - x < {us}]) < {max_calls} THEN 0
             ELSE (list_min([x FOR x IN w.log IF o.t - x < {us}]) + {us} - o.t) / 1e6 END
      FROM walk w JOIN ordered o ON {' AND '.join(f'o.{k.strip()} = w.{k.strip()}' for k in keys.split(','))} AND o.rn = w.rn + 1
    )"""


@query(
    "dedup_keep_first",
    f"WITH RECURSIVE {ALERT_SQL}, {_walk_sql('source_ip, threat_type', 1, DAY)} SELECT 'alert-' || CAST(event_id AS VARCHAR) AS alert_id, NOT allowed AS is_duplicate FROM walk",
)
def q_dedup_keep_first(spark, sf):
    return keep_first(alerts(spark, sf), DAY).select("alert_id", "is_duplicate")


@query(
    "rate_limit",
    f"WITH RECURSIVE {ALERT_SQL}, {_walk_sql('source_ip', 3, DAY)} SELECT event_id, allowed, round(wait_s, 6) AS wait_s FROM walk",
)
def q_rate_limit(spark, sf):
    calls = network(spark, sf).select("event_id", "source_ip", "timestamp")
    out = limit_calls(calls, 3, DAY)
    return out.select("event_id", "allowed", r6("wait_s"))


@query(
    "alert_groups",
    f"""WITH {ALERT_SQL}, {_chain_sql('source_ip', 6 * 3600, 'graded')}, g AS (
      SELECT *, first_value(alert_id) OVER (PARTITION BY source_ip, sid ORDER BY t, alert_id) AS group_id FROM chained)
    SELECT source_ip, group_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_alerts, count(DISTINCT threat_type) AS n_threat_types FROM g GROUP BY 1, 2""",
)
def q_alert_groups(spark, sf):
    return ops.alert_groups(ops.alert_group_members(alerts(spark, sf), 6 * 3600))


@query(
    "alert_group_members",
    f"""WITH {ALERT_SQL}, {_chain_sql('source_ip, destination_ip', 3 * DAY, 'graded')}
    SELECT alert_id, first_value(alert_id) OVER (PARTITION BY source_ip, destination_ip, sid ORDER BY t, alert_id) AS group_id FROM chained""",
)
def q_alert_group_members(spark, sf):
    out = ops.alert_group_members(alerts(spark, sf), 3 * DAY, ("source_ip", "destination_ip"))
    return out.select("alert_id", "group_id")


@query(
    "attack_chain",
    f"""WITH {NET_SQL}, c AS (
      SELECT b.source_ip, b.event_id, b.t, min(l.t) AS lt FROM net b JOIN net l ON l.source_ip = b.source_ip AND l.stage = 'lateral_movement' AND l.t > b.t
      WHERE b.stage = 'exploitation' GROUP BY 1, 2, 3
    ) SELECT a.source_ip, a.event_id, a.t AS recon_us, min(c.t) AS exploitation_us, min(c.lt) AS lateral_us
      FROM net a JOIN c ON c.source_ip = a.source_ip AND c.t > a.t WHERE a.stage = 'recon' GROUP BY 1, 2, 3 HAVING min(c.lt) <= a.t + {DAY * 1_000_000}""",
)
def q_attack_chain(spark, sf):
    return ops.attack_chains(network(spark, sf), "stage", DAY)


@query(
    "sessions",
    f"""WITH {NET_SQL}, {_chain_sql('source_ip', 6 * 3600, 'net')}
    SELECT source_ip, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n FROM chained GROUP BY source_ip, sid""",
)
def q_sessions(spark, sf):
    n = network(spark, sf).select("event_id", "source_ip", "timestamp")
    rows = sessionize(n.withColumn("_t", micros(n, "timestamp")), ["source_ip"], "_t", "event_id", 6 * 3600 * 1_000_000)
    return (
        rows.groupBy("source_ip", F.col("session_start").alias("_s"))
        .agg(
            F.min("timestamp").alias("session_start"),
            F.max("timestamp").alias("last_event"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("_s")
    )


@query(
    "alerts_by_severity",
    f"WITH {ALERT_SQL} SELECT severity, count(*) AS n FROM graded GROUP BY 1",
)
def q_alerts_by_severity(spark, sf):
    return alerts(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "case_gate",
    f"WITH {ALERT_SQL} SELECT alert_id, severity FROM graded WHERE severity IN ('high', 'critical')",
)
def q_case_gate(spark, sf):
    return ops.case_gate(alerts(spark, sf)).select("alert_id", "severity")


@query(
    "case_rows",
    f"""WITH {ALERT_SQL} SELECT alert_id, 'AI Detected: ' || threat_type || ' - ' || source_ip AS title,
      CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE 2 END AS severity_level,
      'ai_detection,' || threat_type || ',severity_' || severity || ',T' || CAST(destination_port AS VARCHAR) AS tags,
      '# AI-Detected Threat' || chr(10) || chr(10) || '**Threat Score**: ' || printf('%.4f', threat_score) || chr(10) || '**Source IP**: ' || source_ip || chr(10)
      || '**Destination IP**: ' || destination_ip || chr(10) || '**Hostname**: N/A' || chr(10) || chr(10) || '## Top Contributing Features' || chr(10) || chr(10)
      || 'No feature information available' || chr(10) || chr(10) || '## Recommended Actions' || chr(10) || chr(10) || CASE WHEN severity IN ('critical', 'high') THEN '{decisions.ISOLATE}'
      WHEN severity = 'medium' THEN '{decisions.WATCH}' ELSE '{decisions.RECORD}' END || chr(10) || chr(10) || '## MITRE ATT&CK Techniques' || chr(10) || chr(10)
      || 'T' || CAST(destination_port AS VARCHAR) || chr(10) || chr(10) || '## Related Events' || chr(10) || chr(10) || 'None' || chr(10) || chr(10) || '---' || chr(10)
      || '*This case was automatically created by the AI Threat Detection System*' AS description
    FROM graded""",
)
def q_case_rows(spark, sf):
    a = alerts(spark, sf).withColumn(
        "mitre_techniques", F.array(F.concat(F.lit("T"), F.col("destination_port").cast("string")))
    )
    out = ops.case_rows(a)
    return out.select("alert_id", "title", "severity_level", F.array_join("tags", ",").alias("tags"), "description")


_TASKS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(ops.CASE_TASKS))


@query(
    "case_tasks",
    f"""WITH {ALERT_SQL} SELECT alert_id, CAST(no AS INTEGER) AS task_no, task, 'Waiting' AS status FROM graded, (VALUES {_TASKS}) v(no, task)
    WHERE severity IN ('high', 'critical')""",
)
def q_case_tasks(spark, sf):
    return ops.case_tasks(ops.case_gate(alerts(spark, sf)))


@query(
    "case_observables",
    f"""WITH {ALERT_SQL}, o AS (
      SELECT alert_id, 'ip' AS data_type, CASE WHEN event_id % 4 = 0 THEN '' ELSE source_ip END AS data, 'Source IP' AS message FROM graded
      UNION ALL SELECT alert_id, 'ip', destination_ip, 'Destination IP' FROM graded
      UNION ALL SELECT alert_id, 'hostname', CASE WHEN event_id % 3 = 0 THEN 'host-' || CAST(event_id AS VARCHAR) END, 'Affected Host' FROM graded)
    SELECT alert_id, data_type, data, message, 2 AS tlp, true AS ioc FROM o WHERE coalesce(data, '') <> ''""",
)
def q_case_observables(spark, sf):
    i = F.col("event_id")
    a = alerts(spark, sf).withColumns(
        {
            "source_ip": F.when(i % 4 == 0, "").otherwise(F.col("source_ip")),
            "hostname": F.when(i % 3 == 0, F.concat(F.lit("host-"), i.cast("string"))),
        }
    )
    return ops.case_observables(a)


@query(
    "siem_envelope",
    f"""WITH {ALERT_SQL} SELECT alert_id, 'ai_threat_detector' AS source, '_json' AS sourcetype, 'security' AS index_name,
      round(t / 1e6, 6) AS time_s, source_ip, severity, threat_score FROM graded""",
)
def q_siem_envelope(spark, sf):
    out = ops.siem_envelope(alerts(spark, sf))
    # Read the envelope back, as the collector would.
    field = lambda p: F.get_json_object("value", p)
    return out.select(
        "alert_id",
        field("$.source").alias("source"),
        field("$.sourcetype").alias("sourcetype"),
        field("$.index").alias("index_name"),
        F.round(field("$.time").cast("double"), 6).alias("time_s"),
        field("$.event.source_ip").alias("source_ip"),
        field("$.event.severity").alias("severity"),
        field("$.event.threat_score").cast("double").alias("threat_score"),
    )


@query(
    "ecs_alerts",
    f"""WITH {ALERT_SQL} SELECT alert_id, 'alert' AS kind, 'intrusion_detection' AS category,
      CAST(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 ELSE 2 END AS INTEGER) AS level,
      CAST(round(threat_score * 100) AS INTEGER) AS risk_score, source_ip FROM graded""",
)
def q_ecs_alerts(spark, sf):
    field = lambda p: F.get_json_object("value", p)
    return ops.ecs_alerts(alerts(spark, sf)).select(
        "alert_id",
        field("$.event.kind").alias("kind"),
        field("$.event.category[0]").alias("category"),
        field("$.event.severity").cast("int").alias("level"),
        field("$.event.risk_score").cast("int").alias("risk_score"),
        field("$.source.ip").alias("source_ip"),
    )


@query(
    "top_threats",
    f"WITH {ALERT_SQL} SELECT threat_type, count(*) AS n FROM graded GROUP BY 1",
)
def q_top_threats(spark, sf):
    return (
        alerts(spark, sf).groupBy("threat_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "threat_type")
    )


@query(
    "format_features",
    """WITH f AS (SELECT event_id, '- **bytes**: ' || CAST(event_id % 100 AS VARCHAR) || '.0 (contribution: 0.25)' AS a,
      '- **port**: ' || CAST(user_id AS VARCHAR) || '.0 (contribution: ' || printf('%.2f', (event_id % 10) / 10.0) || ')' AS b FROM events)
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'No feature information available' ELSE a || chr(10) || b || chr(10) || b || chr(10) || b || chr(10) || a END AS text FROM f""",
)
def q_format_features(spark, sf):
    i = F.col("event_id")
    item = lambda name, value, c: F.struct(
        F.lit(name).alias("feature"), value.cast("double").alias("value"), c.cast("double").alias("contribution")
    )
    a = item("bytes", i % 100, F.lit(0.25))
    b = item("port", F.col("user_id"), (i % 10) / 10.0)
    features = F.when(i % 11 != 0, F.array(a, b, b, b, a, b, a))
    return table(spark, sf, "events").select("event_id", ops.format_features(features).alias("text"))


@query(
    "latest_ioc",
    """WITH i AS (SELECT p_type AS ioc_type, p_name AS ioc_value, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * p_partkey AS ts, p_brand AS source FROM part)
    SELECT ioc_type, ioc_value, ts, source FROM i QUALIFY row_number() OVER (PARTITION BY ioc_type, ioc_value ORDER BY ts DESC) = 1""",
)
def q_latest_ioc(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_type").alias("ioc_type"),
        F.col("p_name").alias("ioc_value"),
        F.expr("timestampadd(MINUTE, cast(p_partkey as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("timestamp"),
        F.col("p_brand").alias("source"),
    )
    return latest_intel(p).withColumnRenamed("timestamp", "ts")


@query(
    "alert_priority",
    f"""WITH {ALERT_SQL} SELECT alert_id, round(threat_score * 40 + CASE WHEN destination_port < 10 THEN 30 ELSE 0 END
      + CASE WHEN event_id % 4 > 0 THEN 20 ELSE 0 END + CASE WHEN event_id % 6 > 2 THEN 10 ELSE 0 END, 6) AS priority FROM graded""",
)
def q_alert_priority(spark, sf):
    score = decisions.priority(
        F.col("threat_score"),
        F.col("destination_port") < 10,
        F.pmod("event_id", F.lit(4)),
        F.pmod("event_id", F.lit(6)),
    )
    return alerts(spark, sf).select("alert_id", r6(score).alias("priority")).orderBy(F.desc("priority"), "alert_id")
