"""From features to scored alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.functions.decisions import is_threat, recommended_action, severity
from hawkframe.plans.features import extract_features, feature_array
from hawkframe.sources.parse import batch_stats, validate

# Fixed contributions reported when no model explains the score.
FIXED_CONTRIBUTIONS = {
    "conn_count_1min": 0.25,
    "unique_dst_ports_1min": 0.20,
    "payload_entropy": 0.18,
}


def top_features(contributions: dict[str, float] | None = None, limit: int = 5) -> Column:
    """Array of (feature, value, contribution), strongest first."""
    given = contributions or FIXED_CONTRIBUTIONS
    ranked = sorted(given.items(), key=lambda kv: (-kv[1], kv[0]))[:limit]
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(name).cast("double").alias("value"),
                F.lit(float(share)).alias("contribution"),
            )
            for name, share in ranked
        ]
    )


def with_fallback(scored: DataFrame) -> DataFrame:
    """Fill the outputs of models that are absent or gave nothing."""
    defaults = {
        "ensemble_pred": F.lit(0),
        "threat_score": F.lit(0.1),
        "model_confidence": F.lit(0.5),
        "anomaly_pred": F.lit(1),
        "anomaly_score": F.lit(0.0),
    }
    return scored.withColumns(
        {
            name: F.coalesce(F.col(name), value) if name in scored.columns else value
            for name, value in defaults.items()
        }
    )


def score_features(
    features: DataFrame,
    ensemble=None,
    anomaly=None,
    contributions: dict[str, float] | None = None,
) -> DataFrame:
    """Apply the models given and turn scores into alert rows."""
    rows = features.withColumn("features", feature_array())
    if ensemble is not None:
        rows = ensemble.transform(rows)
    if anomaly is not None:
        rows = anomaly.transform(rows)
    rows = with_fallback(rows)
    sev = severity(F.col("threat_score"), F.col("anomaly_score"))
    details = [
        F.col(c)
        for c in (
            "random_forest_score",
            "boosted_a_score",
            "boosted_b_score",
            "isolation_forest_score",
            "one_class_svm_score",
            "lof_score",
        )
        if c in rows.columns
    ]
    return rows.withColumn("severity", sev).select(
        F.concat(F.lit("alert-"), F.col("event_id").cast("string")).alias("alert_id"),
        "event_id",
        "timestamp",
        "source_ip",
        "destination_ip",
        is_threat(F.col("ensemble_pred"), F.col("anomaly_pred")).alias("is_threat"),
        "threat_score",
        "severity",
        "model_confidence",
        "ensemble_pred",
        "anomaly_pred",
        "anomaly_score",
        top_features(contributions).alias("top_features"),
        recommended_action(F.col("severity")).alias("recommended_action"),
        "mitre_techniques",
        "ioc_matches",
        "mitre_technique_count",
        *details,
    )


def score_events(events: DataFrame, ensemble=None, anomaly=None, **feature_options) -> DataFrame:
    """Events to alert rows: features, models, decision."""
    return score_features(extract_features(events, **feature_options), ensemble, anomaly)


def batch_score(
    events: DataFrame, ensemble=None, anomaly=None, **feature_options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alerts of the valid events, the rejected events, and the totals.

    One bad event fails alone.
    """
    checked = validate(events, "network")
    ok = F.size("failed_rules") == 0
    alerts = score_events(checked.filter(ok), ensemble, anomaly, **feature_options)
    return alerts, checked.filter(~ok), batch_stats(checked, ok)
