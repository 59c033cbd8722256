"""Parsing, validation, routing, predicate and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkframe.catalog.registry import query, r6
from hawkframe.catalog.tables import ALERT_SQL, NET_SQL, alerts, network, table
from hawkframe.functions import decisions, text
from hawkframe.operators import sampling
from hawkframe.operators.rules import Rule, matched_rules, technique_count
from hawkframe.session import durable, ensure_checkpoint_dir
from hawkframe.sources import connectors, parse
from hawkframe.sources.parse import decode, partition_key, topic, union_events, validate_decoded

# Raw JSON lines: network events from `events`, application logs from
# `conversations`, endpoint events from `orders`, intel from `part`, and some
# broken ones among them.


def raw_network(spark, sf):
    n = network(spark, sf)
    i = F.col("event_id")
    kind = F.when(i % 50 == 7, "mystery").otherwise("network")
    record = F.struct(
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("net-"), i.cast("string")).alias("event_id"),
        kind.alias("event_type"),
        F.lit("zeek").alias("source_system"),
        F.when(i % 89 == 0, "invalid.ip").otherwise(F.col("source_ip")).alias("source_ip"),
        "destination_ip",
        (F.col("bytes_sent") * 2).alias("source_port"),
        "destination_port",
        F.when(i % 41 == 0, F.upper("protocol")).otherwise(F.col("protocol")).alias("protocol"),
        (F.col("bytes_sent") - 100).alias("bytes_sent"),
        F.when(F.col("protocol") == "http", F.col("destination_port") * 8).alias("http_status_code"),
    )
    line = F.to_json(record)
    return n.select(F.when(i % 73 == 0, F.concat(line, F.lit("}{"))).otherwise(line).alias("value"))


def raw_logs(spark, sf):
    c = table(spark, sf, "conversations")
    record = F.struct(
        F.concat_ws("-", F.lit("app"), "conv_id", "turn").alias("event_id"),
        F.lit("application").alias("event_type"),
        F.lit("nginx").alias("source_system"),
        F.col("role").alias("application_name"),
        F.lit("INFO").alias("log_level"),
        F.col("text").alias("message"),
        (F.length("text") - 50.0).alias("response_time_ms"),
    )
    return c.select(F.to_json(record).alias("value"))


def raw_endpoint(spark, sf):
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    md5 = F.md5(i.cast("string").cast("binary"))
    record = F.struct(
        F.concat(F.lit("ep-"), i.cast("string")).alias("event_id"),
        F.lit("endpoint").alias("event_type"),
        F.lit("sysmon").alias("source_system"),
        F.when(i % 31 == 0, "").otherwise(F.concat(F.lit("HOST-"), F.col("o_custkey").cast("string"))).alias("hostname"),
        (i - 20).alias("process_id"),
        F.when(i % 17 == 0, F.substring(md5, 1, 31)).otherwise(md5).alias("file_hash_md5"),
        F.when(i % 3 == 0, F.sha2(i.cast("string"), 256)).alias("file_hash_sha256"),
    )
    return o.select(F.to_json(record).alias("value"))


def raw_intel(spark, sf):
    p = table(spark, sf, "part")
    record = F.struct(
        F.lit("threat_intel").alias("event_type"),
        F.lit("domain").alias("ioc_type"),
        F.col("p_name").alias("ioc_value"),
        F.col("p_type").alias("threat_type"),
        F.when(F.col("p_size") % 7 == 0, "urgent").otherwise("high").alias("severity"),
        F.col("p_brand").alias("source"),
        (F.col("p_size") / 45.0).alias("confidence_score"),
    )
    return p.select(F.to_json(record).alias("value"))


def raw_mistyped(spark, sf):
    """Lines as senders write them: numbers as text, wrong types, bad times, counters beyond 64 bits."""
    s = table(spark, sf, "supplier")
    i = F.col("s_suppkey")
    form = i % 8
    number = (
        F.when(form == 0, '"abc"').when(form == 1, "10.7").when(form == 2, '"80"').when(form == 3, "12.0")
        .when(form == 4, "99999999999999999999999").when(form == 5, "null").otherwise("7")
    )
    time = F.when(i % 3 == 0, "nope").otherwise("2024-01-01T00:00:00Z")
    line = F.concat(
        F.lit('{"event_type":"network","event_id":"raw-'), i.cast("string"), F.lit('","source_system":"zeek","timestamp":"'), time,
        F.lit('","source_ip":"10.0.0.1","destination_ip":"10.0.0.2","source_port":"80","destination_port":443,"protocol":"tcp","bytes_sent":'),
        number, F.lit("}"),
    )
    return s.select(line.alias("value"))


def raw_lines(spark, sf):
    parts = [f(spark, sf) for f in (raw_network, raw_logs, raw_endpoint, raw_intel)]
    # Stored first, as raw events are text in files or topics, not expressions.
    return durable(union_events(parts))


_RAW_NET = NET_SQL + """, raw AS (
  SELECT *, event_id % 73 = 0 AS broken, event_id % 50 = 7 AS unknown,
         CASE WHEN event_id % 89 = 0 THEN 'invalid.ip' ELSE source_ip END AS sip,
         bytes_sent * 2 AS sport,
         CASE WHEN event_id % 41 = 0 THEN upper(protocol) ELSE protocol END AS proto,
         bytes_sent - 100 AS bsent,
         CASE WHEN protocol = 'http' THEN destination_port * 8 END AS status
  FROM net
)"""


@query(
    "parse_events",
    f"""WITH {_RAW_NET} SELECT event_type, reject, count(*) AS n FROM (
      SELECT CASE WHEN broken THEN 'broken' WHEN unknown THEN 'mystery' ELSE 'network' END AS event_type,
             CASE WHEN broken THEN 'malformed json' WHEN unknown THEN 'unknown event_type' END AS reject FROM raw
      UNION ALL SELECT 'application', NULL FROM conversations
      UNION ALL SELECT 'endpoint', NULL FROM orders
      UNION ALL SELECT 'threat_intel', NULL FROM part) x
    GROUP BY 1, 2""",
)
def q_parse_events(spark, sf):
    d = decode(raw_lines(spark, sf))
    kind = F.when(F.col("reject") == parse.BAD_JSON, "broken").otherwise(F.col("event_type"))
    return d.groupBy(kind.alias("event_type"), "reject").agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_events",
    f"""WITH {_RAW_NET}, failures AS (
      SELECT 'net-' || CAST(event_id AS VARCHAR) AS event_id, concat_ws(',',
        CASE WHEN sip = 'invalid.ip' THEN 'source_ip' END,
        CASE WHEN sport > 65535 THEN 'source_port' END,
        CASE WHEN proto <> lower(proto) THEN 'protocol' END,
        CASE WHEN bsent < 0 THEN 'bytes_sent' END,
        CASE WHEN status < 100 OR status > 599 THEN 'http_status_code' END) AS failed
      FROM raw WHERE NOT broken AND NOT unknown
      UNION ALL
      SELECT 'app-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), concat_ws(',',
        CASE WHEN length(text) > 10000 THEN 'message' END, CASE WHEN length(text) - 50 < 0 THEN 'response_time_ms' END)
      FROM conversations
      UNION ALL
      SELECT 'ep-' || CAST(o_orderkey AS VARCHAR), concat_ws(',',
        CASE WHEN o_orderkey % 31 = 0 THEN 'hostname' END, CASE WHEN o_orderkey < 20 THEN 'process_id' END,
        CASE WHEN o_orderkey % 17 = 0 THEN 'file_hash_md5' END)
      FROM orders
      UNION ALL
      SELECT p_name, concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'severity' END,
        CASE WHEN p_size / 45.0 > 1 THEN 'confidence_score' END) FROM part
    ) SELECT event_id, failed FROM failures""",
)
def q_validate_events(spark, sf):
    checked = validate_decoded(decode(raw_lines(spark, sf))).filter("reject is null")
    key = F.coalesce("network.event_id", "application.event_id", "endpoint.event_id", "threat_intel.ioc_value")
    return checked.select(key.alias("event_id"), F.array_join("failed_rules", ",").alias("failed"))


@query(
    "validate_types",
    """SELECT 'raw-' || CAST(s_suppkey AS VARCHAR) AS event_id, 80 AS source_port, 0::BIGINT AS packets_sent,
      CASE s_suppkey % 8 WHEN 2 THEN 80 WHEN 3 THEN 12 WHEN 5 THEN 0 WHEN 6 THEN 7 WHEN 7 THEN 7 END::BIGINT AS bytes_sent,
      concat_ws(',', CASE WHEN s_suppkey % 3 = 0 THEN 'timestamp' END, CASE WHEN s_suppkey % 8 IN (0, 1, 4) THEN 'bytes_sent' END) AS failed
    FROM supplier""",
)
def q_validate_types(spark, sf):
    checked = validate_decoded(decode(durable(raw_mistyped(spark, sf))))
    fields = [f"network.{c}" for c in ("event_id", "source_port", "packets_sent", "bytes_sent")]
    return checked.select(*fields, F.array_join("failed_rules", ",").alias("failed"))


@query(
    "src_files",
    f"WITH {NET_SQL} SELECT event_id, ts, source_ip, destination_port, bytes_sent FROM net",
)
def q_src_files(spark, sf):
    """Events written as a JSON-lines table and read back with the fixed schema."""
    n = network(spark, sf).select(
        "event_id", F.col("timestamp").alias("ts"), "source_ip", "destination_port", "bytes_sent"
    )
    path = f"{ensure_checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    connectors.write_json_lines(n.select(F.to_json(F.struct("*"), parse.JSON_TIME).alias("value")), path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in n.schema.fields])
    return connectors.read_events(spark, path, schema)


@query(
    "route_topics",
    f"""WITH {_RAW_NET} SELECT CASE WHEN kind = 'network' THEN 'security.events.network' WHEN kind = 'application' THEN 'security.events.application'
      WHEN kind = 'endpoint' THEN 'security.events.endpoint' WHEN kind = 'threat_intel' THEN 'security.threat_intelligence' END AS topic, count(*) AS n FROM (
      SELECT CASE WHEN unknown THEN 'mystery' ELSE 'network' END AS kind FROM raw WHERE NOT broken
      UNION ALL SELECT 'application' FROM conversations UNION ALL SELECT 'endpoint' FROM orders
      UNION ALL SELECT 'threat_intel' FROM part) x GROUP BY 1""",
)
def q_route_topics(spark, sf):
    d = decode(raw_lines(spark, sf)).filter(F.coalesce(F.col("reject"), F.lit("")) != parse.BAD_JSON)
    return d.groupBy(topic(F.col("event_type")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "partition_key",
    f"""WITH {NET_SQL} SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE source_ip END, ''),
      nullif(CASE WHEN event_id % 2 = 0 THEN 'host-' || CAST(user_id AS VARCHAR) ELSE '' END, ''), CAST(event_id AS VARCHAR)) AS key FROM net""",
)
def q_partition_key(spark, sf):
    i = F.col("event_id")
    ip = F.when(i % 3 == 0, "").otherwise(F.col("source_ip"))
    host = F.when(i % 2 == 0, F.concat(F.lit("host-"), F.col("user_id").cast("string"))).otherwise("")
    return network(spark, sf).select("event_id", partition_key(ip, host, i.cast("string")).alias("key"))


@query(
    "batch_stats",
    f"WITH {NET_SQL} SELECT protocol, count(*) AS total, count(*) FILTER (WHERE bytes_sent < 40000) AS successful, count(*) FILTER (WHERE bytes_sent >= 40000) AS failed FROM net GROUP BY 1",
)
def q_batch_stats(spark, sf):
    return parse.batch_stats(network(spark, sf), F.col("bytes_sent") < 40000, ("protocol",))


@query(
    "union_events",
    f"""WITH {NET_SQL} SELECT 'network' AS event_type, CAST(event_id AS VARCHAR) AS event_id, source_ip, NULL AS message FROM net
    UNION ALL SELECT 'application', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), NULL, text FROM conversations""",
)
def q_union_events(spark, sf):
    n = network(spark, sf).select(F.lit("network").alias("event_type"), F.col("event_id").cast("string").alias("event_id"), "source_ip")
    c = table(spark, sf, "conversations").select(
        F.lit("application").alias("event_type"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.col("text").alias("message")
    )
    return union_events([n, c])


# Predicates


@query("flt_high_volume", "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 20) AS BIGINT) AS bytes_sent FROM lineitem WHERE CAST(round(l_extendedprice * 20) AS BIGINT) > 1000000")
def q_flt_high_volume(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 20).cast("bigint").alias("bytes_sent")
    )
    return li.filter(decisions.high_volume(F.col("bytes_sent")))


_PROC = """proc AS (
  SELECT o_orderkey, o_orderpriority,
    CASE WHEN o_orderkey % 3 = 0 THEN 'C:\\Windows\\PowerShell.exe' ELSE 'cmd.exe' END AS process_name,
    CASE o_orderstatus WHEN 'F' THEN 'run -ExecutionPolicy Bypass -File a.ps1' WHEN 'O' THEN 'run -WindowStyle Hidden IEX x' ELSE 'DownloadString plain' END AS command_line
  FROM orders)"""


def _processes(spark, sf):
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        "o_orderkey",
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 == 0, "C:\\Windows\\PowerShell.exe").otherwise("cmd.exe").alias("process_name"),
        F.when(status == "F", "run -ExecutionPolicy Bypass -File a.ps1")
        .when(status == "O", "run -WindowStyle Hidden IEX x")
        .otherwise("DownloadString plain")
        .alias("command_line"),
    )


@query(
    "flt_powershell",
    f"""WITH {_PROC} SELECT o_orderkey, command_line FROM proc WHERE lower(process_name) LIKE '%powershell%'
    AND (lower(command_line) LIKE '%-executionpolicy bypass%' OR lower(command_line) LIKE '%-windowstyle hidden%')""",
)
def q_flt_powershell(spark, sf):
    p = _processes(spark, sf)
    return p.filter(decisions.suspicious_powershell(F.col("process_name"), F.col("command_line"))).select(
        "o_orderkey", "command_line"
    )


# Log messages: the outcome word varies, so that the near miss "error" occurs.
_LOGS = """logs AS (
  SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'Authentication FAILED: ' WHEN (conv_id + turn) % 4 = 1 THEN 'Authentication error: '
    WHEN (conv_id + turn) % 4 = 2 THEN 'Connection failed: ' ELSE '' END || text AS message FROM conversations)"""


def _logs(spark, sf):
    c = table(spark, sf, "conversations")
    m = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    head = (
        F.when(m == 0, "Authentication FAILED: ")
        .when(m == 1, "Authentication error: ")
        .when(m == 2, "Connection failed: ")
        .otherwise("")
    )
    return c.select("conv_id", "turn", F.concat(head, "text").alias("message"))


@query(
    "flt_auth_failure",
    f"WITH {_LOGS} SELECT conv_id, turn FROM logs WHERE contains(lower(message), 'authentication') AND contains(lower(message), 'failed')",
)
def q_flt_auth_failure(spark, sf):
    return _logs(spark, sf).filter(decisions.auth_failure(F.col("message"))).select("conv_id", "turn")


@query(
    "detect_labels",
    f"""WITH {NET_SQL}, {_PROC}, {_LOGS}, fired AS (
      SELECT 'network' AS event_type, CASE WHEN bytes_sent * 40 > 1000000 THEN 'high_volume_connection' END AS detection FROM net
      UNION ALL SELECT 'endpoint', CASE WHEN lower(process_name) LIKE '%powershell%'
        AND (lower(command_line) LIKE '%-executionpolicy bypass%' OR lower(command_line) LIKE '%-windowstyle hidden%') THEN 'suspicious_powershell_execution' END FROM proc
      UNION ALL SELECT 'application', CASE WHEN contains(lower(message), 'authentication') AND contains(lower(message), 'failed') THEN 'authentication_failure' END FROM logs)
    SELECT event_type, detection, count(*) AS n FROM fired GROUP BY 1, 2""",
)
def q_detect_labels(spark, sf):
    from hawkframe.operators.detect import detections

    n = network(spark, sf).select(F.lit("network").alias("event_type"), (F.col("bytes_sent") * 40).alias("bytes_sent"))
    p = _processes(spark, sf).select(F.lit("endpoint").alias("event_type"), "process_name", "command_line")
    c = _logs(spark, sf).select(F.lit("application").alias("event_type"), "message")
    both = union_events([n, p, c])
    return (
        both.select("event_type", F.explode_outer(detections()).alias("detection"))
        .groupBy("event_type", "detection")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "proto_flags",
    f"WITH {NET_SQL} SELECT event_id, protocol IN ('http', 'https') AS is_http, protocol = 'dns' AS is_dns, protocol = 'ssh' AS is_ssh FROM net",
)
def q_proto_flags(spark, sf):
    p = F.col("protocol")
    return network(spark, sf).select(
        "event_id", decisions.is_http(p).alias("is_http"), (p == "dns").alias("is_dns"), (p == "ssh").alias("is_ssh")
    )


@query("off_hours", "SELECT event_id, NOT (hour(ts) BETWEEN 8 AND 17) AS off_hours_activity FROM events")
def q_off_hours(spark, sf):
    return table(spark, sf, "events").select("event_id", decisions.off_hours(F.col("ts")).alias("off_hours_activity"))


@query("threat_decision", "SELECT event_id, (event_id % 7 = 0) OR (user_id % 5 = 0) AS is_threat FROM events")
def q_threat_decision(spark, sf):
    ens = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    anom = F.when(F.col("user_id") % 5 == 0, -1).otherwise(1)
    return table(spark, sf, "events").select("event_id", decisions.is_threat(ens, anom).alias("is_threat"))


@query("severity_ladder", f"WITH {ALERT_SQL} SELECT event_id, severity FROM graded")
def q_severity_ladder(spark, sf):
    return alerts(spark, sf).select("event_id", "severity")


@query(
    "recommended_action",
    f"""WITH {ALERT_SQL} SELECT event_id, CASE WHEN severity IN ('critical', 'high') THEN '{decisions.ISOLATE}'
    WHEN severity = 'medium' THEN '{decisions.WATCH}' ELSE '{decisions.RECORD}' END AS recommended_action FROM graded""",
)
def q_recommended_action(spark, sf):
    return alerts(spark, sf).select("event_id", "recommended_action")


@query(
    "score_fallback",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS ensemble_pred, CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE round(value / 500, 6) END AS threat_score,
    0.5::DOUBLE AS model_confidence, 1 AS anomaly_pred, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS anomaly_score FROM events""",
)
def q_score_fallback(spark, sf):
    from hawkframe.plans.scoring import with_fallback

    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(i % 2 == 1, 1).alias("ensemble_pred"),
        F.when(i % 2 == 1, F.round(F.col("value") / 500, 6)).alias("threat_score"),
        F.when(i % 3 != 0, F.col("value")).alias("anomaly_score"),
    )
    return with_fallback(e)


RULES = [
    Rule(
        "download cradle",
        "high",
        ("T1059.001", "T1105"),
        {"process_name|endswith": "\\powershell.exe", "command_line|contains": ["IEX", "Invoke-Expression", "DownloadString", "DownloadFile"]},
    ),
    Rule("hidden window", "medium", ("T1564.003",), {"command_line|contains": "-windowstyle hidden"}),
    Rule("urgent job", "low", ("T1059.001",), {"o_orderpriority|startswith": "1-"}),
]

_MATCHES = f"""{_PROC}, hit AS (
  SELECT o_orderkey,
    lower(process_name) LIKE '%powershell.exe' AND (lower(command_line) LIKE '%iex%' OR lower(command_line) LIKE '%downloadstring%') AS a,
    lower(command_line) LIKE '%-windowstyle hidden%' AS b, o_orderpriority LIKE '1-%' AS c FROM proc)"""


@query(
    "sig_match",
    f"""WITH {_MATCHES} SELECT o_orderkey, 'download cradle' AS rule, 'high' AS level FROM hit WHERE a
    UNION ALL SELECT o_orderkey, 'hidden window', 'medium' FROM hit WHERE b UNION ALL SELECT o_orderkey, 'urgent job', 'low' FROM hit WHERE c""",
)
def q_sig_match(spark, sf):
    p = _processes(spark, sf).select("o_orderkey", F.explode(matched_rules(RULES)).alias("m"))
    return p.select("o_orderkey", "m.rule", "m.level")


@query(
    "mitre_count",
    f"WITH {_MATCHES} SELECT o_orderkey, CAST(CASE WHEN a THEN 2 WHEN c THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END AS INTEGER) AS techniques FROM hit",
)
def q_mitre_count(spark, sf):
    return _processes(spark, sf).select("o_orderkey", technique_count(matched_rules(RULES)).alias("techniques"))


@query(
    "doc_rules",
    r"""SELECT doc_id, list_sort([x FOR x IN [CASE WHEN contains(lower(text), 'password') THEN 'password' END, CASE WHEN contains(lower(text), '@') THEN 'address' END,
      CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'license' END] IF x IS NOT NULL])::VARCHAR AS rules FROM documents""",
)
def q_doc_rules(spark, sf):
    rules = [
        Rule("password", "high", ("T1552",), {"text|contains": "password"}),
        Rule("address", "low", ("T1589",), {"text|contains": "@"}),
        Rule("license", "info", (), {"text|contains": ["License", "copyright"]}),
    ]
    names = F.array_sort(F.transform(matched_rules(rules), lambda m: m["rule"]))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("rules")
    )


@query(
    "redact_pii",
    f"""WITH {NET_SQL} SELECT 'net' AS kind, event_id AS id, sha256(source_ip) AS token, NULL AS masked FROM net
    UNION ALL SELECT 'doc', doc_id, NULL, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[email]', 'g') FROM documents""",
)
def q_redact_pii(spark, sf):
    n = network(spark, sf).select(F.lit("net").alias("kind"), F.col("event_id").alias("id"), text.token(F.col("source_ip")).alias("token"))
    d = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), text.mask_email(F.col("text")).alias("masked"))
    return union_events([n, d])


@query("retention", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS")
def q_retention(spark, sf):
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    return sampling.keep_days(table(spark, sf, "events"), "ts", 7, as_of).select("event_id", "ts")


@query("training_extract", "SELECT event_id, ts, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS")
def q_training_extract(spark, sf):
    return sampling.keep_days(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", 10)


@query("canary_split", "SELECT event_id, event_id % 100 < 10 AS candidate FROM events")
def q_canary_split(spark, sf):
    return table(spark, sf, "events").select("event_id", decisions.canary(F.col("event_id")).alias("candidate"))


@query(
    "stratified_split",
    """WITH h AS (SELECT doc_id, toxic, md5(CAST(doc_id AS VARCHAR)) AS h FROM labels), r AS (
      SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY toxic) AS n FROM h)
    SELECT doc_id, toxic, CASE WHEN rk * 100 < 70 * n THEN 'train' WHEN rk * 100 < 85 * n THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def q_stratified_split(spark, sf):
    return sampling.stratified_split(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query(
    "batch_ids",
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS BIGINT) AS batch_id FROM documents",
)
def q_batch_ids(spark, sf):
    return sampling.batch_ids(table(spark, sf, "documents").select("doc_id"), "doc_id", 64)


# Scalars


@query(
    "entropy_text",
    "SELECT doc_id, round(coalesce(CASE WHEN length(text) > 0 THEN list_entropy(string_split(text, '')) END, 0), 6) AS entropy FROM documents",
)
def q_entropy_text(spark, sf):
    out = text.entropy_table(table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("entropy", r6("entropy"))


@query(
    "entropy_turns",
    "SELECT conv_id, turn, round(coalesce(CASE WHEN length(text) > 0 THEN list_entropy(string_split(text, '')) END, 0), 6) AS entropy FROM conversations",
)
def q_entropy_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", r6(text.entropy(F.col("text"))).alias("entropy"))


_IPS = """ips AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN source_ip WHEN 1 THEN ' ' || source_ip || '  ' WHEN 2 THEN '10.0.' || CAST(event_id AS VARCHAR)
  WHEN 3 THEN '10.' || CAST(event_id % 400 AS VARCHAR) || '.0.1' WHEN 4 THEN '10.a.0.1' ELSE '10.0..1' END AS ip FROM net)"""
_VALID = "regexp_full_match({x}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AND list_max([CAST(p AS BIGINT) FOR p IN regexp_extract_all({x}, '[0-9]+')]) <= 255"


def _ips(spark, sf):
    i = F.pmod("event_id", F.lit(6))
    own = F.col("source_ip")
    ip = (
        F.when(i == 0, own)
        .when(i == 1, F.concat(F.lit(" "), own, F.lit("  ")))
        .when(i == 2, F.concat(F.lit("10.0."), F.col("event_id").cast("string")))
        .when(i == 3, F.concat(F.lit("10."), F.pmod("event_id", F.lit(400)).cast("string"), F.lit(".0.1")))
        .when(i == 4, "10.a.0.1")
        .otherwise("10.0..1")
    )
    return network(spark, sf).select("event_id", ip.alias("ip"))


@query("valid_ip", f"WITH {NET_SQL}, {_IPS} SELECT event_id, coalesce({_VALID.format(x='ip')}, false) AS valid FROM ips")
def q_valid_ip(spark, sf):
    return _ips(spark, sf).select("event_id", text.is_valid_ipv4(F.col("ip")).alias("valid"))


@query("sanitize_ip", f"WITH {NET_SQL}, {_IPS} SELECT event_id, CASE WHEN {_VALID.format(x='trim(ip)')} THEN trim(ip) END AS ip FROM ips")
def q_sanitize_ip(spark, sf):
    return _ips(spark, sf).select("event_id", text.sanitize_ip(F.col("ip")).alias("ip"))


@query("safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN -1 ELSE l_extendedprice / l_discount END, 4) AS ratio FROM lineitem")
def q_safe_divide(spark, sf):
    ratio = text.safe_divide(F.col("l_extendedprice"), F.col("l_discount"), -1.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(ratio, 4).alias("ratio"))


@query(
    "percentage",
    """SELECT l_orderkey, round(CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100 END, 2) AS pct
    FROM lineitem GROUP BY 1""",
)
def q_percentage(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count(F.lit(1)).alias("n")
    )
    return g.select("l_orderkey", text.percentage(F.col("r"), F.col("n")).alias("pct"))


@query("epoch_convert", "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS epoch_s, ts AS back FROM events")
def q_epoch_convert(spark, sf):
    from hawkframe.operators.sliced import micros

    e = table(spark, sf, "events")
    us = micros(e, "ts")
    back = F.expr("timestampadd(MICROSECOND, us, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return e.select("event_id", us.alias("us")).select("event_id", F.round(F.col("us") / 1e6, 6).alias("epoch_s"), back.alias("back"))


@query("truncate_str", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 97) || '...' END AS short FROM documents")
def q_truncate_str(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))
