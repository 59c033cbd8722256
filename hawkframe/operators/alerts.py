"""Alert deduplication, correlation, chains and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.functions.decisions import severity_rank
from hawkframe.sources.parse import JSON_TIME
from hawkframe.operators.sliced import US, micros, next_after, sessionize

# Fixed texts and codes of the export rows.
CASE_LEVEL = {"critical": 3, "high": 2, "medium": 1, "low": 0}
CASE_TASKS = [
    "Verify alert - check for false positive",
    "Investigate source IP/host activity",
    "Check for lateral movement",
    "Review recent authentication logs",
    "Analyze network traffic patterns",
    "Determine if containment is required",
    "Document findings and remediation steps",
]
CASE_FOOTER = "*This case was automatically created by the AI Threat Detection System*"
NO_FEATURES = "No feature information available"
SIEM_SOURCE = "ai_threat_detector"
ECS_SEVERITY = {"critical": 10, "high": 8, "medium": 5, "low": 2, "info": 1}


def dedup_alerts(
    alerts: DataFrame,
    window_s: int = 60,
    keys: tuple[str, ...] = ("source_ip", "threat_type"),
    ts: str = "timestamp",
    order_id: str = "alert_id",
) -> DataFrame:
    """Mark alerts that follow any alert of the same key by less than the window.

    `original_alert_id` is the first alert of the chain.
    """
    base = alerts.withColumn("_t", micros(alerts, ts))
    rows = sessionize(base, keys, "_t", order_id, window_s * US)
    dup = F.col("session_first_id") != F.col(order_id)
    kept = [c for c in alerts.columns if c not in ("is_duplicate", "original_alert_id")]
    return rows.select(
        *kept,
        dup.alias("is_duplicate"),
        F.when(dup, F.col("session_first_id")).alias("original_alert_id"),
    )


def alert_group_members(
    alerts: DataFrame,
    gap_s: int,
    keys: tuple[str, ...] = ("source_ip",),
    ts: str = "timestamp",
    order_id: str = "alert_id",
) -> DataFrame:
    """Each alert with the id of its correlation group (first alert of the burst).

    Related events stay in rows: a group may hold any number of alerts.
    """
    base = alerts.withColumn("_t", micros(alerts, ts))
    rows = sessionize(base, keys, "_t", order_id, gap_s * US)
    return rows.select(*alerts.columns, F.col("session_first_id").alias("group_id"))


def alert_groups(
    members: DataFrame, keys: tuple[str, ...] = ("source_ip",), ts: str = "timestamp"
) -> DataFrame:
    return members.groupBy(*keys, "group_id").agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("n_alerts"),
        F.countDistinct("threat_type").alias("n_threat_types"),
    )


def attack_chains(
    events: DataFrame,
    stage: str,
    horizon_s: int,
    stages: tuple[str, str, str] = ("recon", "exploitation", "lateral_movement"),
    key: str = "source_ip",
    ts: str = "timestamp",
    order_id: str = "event_id",
) -> DataFrame:
    """Earliest complete chain that starts at each first-stage event.

    Steps are strictly later than one another and the last lies within the
    horizon of the first.  The earliest second step followed by the earliest
    third step ends first, so two look-aheads replace the self-joins.
    """
    first, second, third = stages
    base = events.select(key, order_id, stage, micros(events, ts).alias("_t"))
    rows = base.filter(F.col(stage).isin(*stages))
    rows = next_after(rows, [key], "_t", F.when(F.col(stage) == third, F.col("_t")), "_c")
    step = F.when(F.col(stage) == second, F.struct(F.col("_t").alias("b"), F.col("_c").alias("c")))
    rows = next_after(rows, [key], "_t", step, "_bc")
    return rows.filter(
        (F.col(stage) == first) & (F.col("_bc.c") <= F.col("_t") + horizon_s * US)
    ).select(
        key,
        order_id,
        F.col("_t").alias("recon_us"),
        F.col("_bc.b").alias("exploitation_us"),
        F.col("_bc.c").alias("lateral_us"),
    )


def case_gate(alerts: DataFrame, threshold: str = "high", enabled: bool = True) -> DataFrame:
    return alerts.filter(F.lit(enabled) & (severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold))))


def _case_level() -> Column:
    pairs = [F.lit(x) for kv in CASE_LEVEL.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("severity")), F.lit(2))


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double, without an exponent from 0.0001 up to 10^16."""
    text = value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    inside = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    return F.when(text.contains("E") & inside, plain).otherwise(text)


def format_features(features: Column) -> Column:
    """Markdown lines of the first five features."""
    line = F.transform(
        F.slice(features, 1, 5),
        lambda f: F.concat(
            F.lit("- **"),
            f["feature"],
            F.lit("**: "),
            number_text(f["value"]),
            F.lit(" (contribution: "),
            F.format_string("%.2f", f["contribution"]),
            F.lit(")"),
        ),
    )
    none = F.lit(NO_FEATURES)
    return F.when(F.coalesce(F.size(features), F.lit(0)) < 1, none).otherwise(F.array_join(line, "\n"))


def _or(col: Column, text: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(text))


def _listing(name: str, columns: list[str], none: str) -> Column:
    if name not in columns:
        return F.lit(none)
    return _or(F.array_join(F.col(name), ", "), none)


def case_rows(alerts: DataFrame) -> DataFrame:
    """One case-manager row per alert."""
    cols = alerts.columns
    host = F.col("hostname") if "hostname" in cols else F.lit(None).cast("string")
    who = F.coalesce(F.nullif(F.col("source_ip"), F.lit("")), host, F.lit("None"))
    techniques = (
        F.coalesce(F.col("mitre_techniques"), F.array().cast("array<string>"))
        if "mitre_techniques" in cols
        else F.array().cast("array<string>")
    )
    features = format_features(F.col("top_features")) if "top_features" in cols else F.lit(NO_FEATURES)
    description = F.concat(
        F.lit("# AI-Detected Threat\n\n**Threat Score**: "),
        F.format_string("%.4f", F.col("threat_score")),
        F.lit("\n**Source IP**: "),
        _or(F.col("source_ip"), "N/A"),
        F.lit("\n**Destination IP**: "),
        _or(F.col("destination_ip"), "N/A"),
        F.lit("\n**Hostname**: "),
        _or(host, "N/A"),
        F.lit("\n\n## Top Contributing Features\n\n"),
        features,
        F.lit("\n\n## Recommended Actions\n\n"),
        F.col("recommended_action"),
        F.lit("\n\n## MITRE ATT&CK Techniques\n\n"),
        _listing("mitre_techniques", cols, "None identified"),
        F.lit("\n\n## Related Events\n\n"),
        _listing("related_events", cols, "None"),
        F.lit("\n\n---\n" + CASE_FOOTER),
    )
    return alerts.select(
        "alert_id",
        F.concat(F.lit("AI Detected: "), "threat_type", F.lit(" - "), who).alias("title"),
        description.alias("description"),
        _case_level().alias("severity_level"),
        _case_level().alias("tlp"),
        F.concat(
            F.array(
                F.lit("ai_detection"),
                F.col("threat_type"),
                F.concat(F.lit("severity_"), F.col("severity")),
            ),
            techniques,
        ).alias("tags"),
    )


def case_tasks(cases: DataFrame) -> DataFrame:
    tasks = F.array(*[F.lit(t) for t in CASE_TASKS])
    return cases.select(
        "alert_id", F.posexplode(tasks).alias("task_no", "task"), F.lit("Waiting").alias("status")
    )


def case_observables(alerts: DataFrame) -> DataFrame:
    spec = [
        ("ip", "source_ip", "Source IP"),
        ("ip", "destination_ip", "Destination IP"),
        ("hostname", "hostname", "Affected Host"),
    ]
    items = [
        F.struct(
            F.lit(kind).alias("data_type"),
            F.col(col).cast("string").alias("data"),
            F.lit(text).alias("message"),
        )
        for kind, col, text in spec
        if col in alerts.columns
    ]
    return (
        alerts.select("alert_id", F.explode(F.array(*items)).alias("_o"))
        .select("alert_id", "_o.*", F.lit(2).alias("tlp"), F.lit(True).alias("ioc"))
        .filter(F.coalesce(F.col("data"), F.lit("")) != "")
    )


def siem_envelope(
    alerts: DataFrame, ts: str = "timestamp", index: str = "security", sourcetype: str = "_json"
) -> DataFrame:
    """JSON text per alert for the SIEM collector."""
    return alerts.select(
        "alert_id",
        F.to_json(
            F.struct(
                F.struct(*alerts.columns).alias("event"),
                F.lit(SIEM_SOURCE).alias("source"),
                F.lit(sourcetype).alias("sourcetype"),
                F.lit(index).alias("index"),
                (micros(alerts, ts).cast("decimal(26,6)") / 1_000_000).cast("decimal(20,6)").alias("time"),
            ),
            JSON_TIME,
        ).alias("value"),
    )


def ecs_alerts(alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Alert in the common schema of the search stack, as JSON text."""
    pairs = [F.lit(x) for kv in ECS_SEVERITY.items() for x in kv]
    level = F.try_element_at(F.create_map(*pairs), F.col("severity"))
    extra = []
    if "mitre_techniques" in alerts.columns:
        threat = F.struct(
            F.lit("MITRE ATT&CK").alias("framework"),
            F.struct(F.col("mitre_techniques").alias("id")).alias("technique"),
        )
        extra.append(threat.alias("threat"))
    detector = [F.col(c) for c in ("threat_score", "model_confidence", "top_features") if c in alerts.columns]
    doc = F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"),
        F.struct(
            F.lit("alert").alias("kind"),
            F.array(F.lit("intrusion_detection")).alias("category"),
            F.array(F.lit("indicator")).alias("type"),
            level.alias("severity"),
            F.round(F.col("threat_score") * 100).cast("int").alias("risk_score"),
        ).alias("event"),
        *extra,
        F.struct(F.col("source_ip").alias("ip")).alias("source"),
        F.struct(*detector).alias("ai_detector"),
    )
    return alerts.select("alert_id", F.to_json(doc).alias("value"))
