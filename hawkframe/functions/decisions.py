"""Predicates and decision columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hawkframe.schemas import SEVERITY_RANK

HIGH_VOLUME_BYTES = 1_000_000
POWERSHELL_FLAGS = ["-executionpolicy bypass", "-windowstyle hidden"]

# Fixed action texts by severity.
ISOLATE = "Isolate host immediately, investigate payload, check for lateral movement"
WATCH = "Monitor closely, investigate if pattern continues"
RECORD = "Log for future analysis"


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def high_volume(bytes_sent: Column) -> Column:
    return bytes_sent > HIGH_VOLUME_BYTES


def suspicious_powershell(process_name: Column, command_line: Column) -> Column:
    cmd = F.lower(command_line)
    hit = F.lower(process_name).contains("powershell") & any_of(
        [cmd.contains(flag) for flag in POWERSHELL_FLAGS]
    )
    return F.coalesce(hit, F.lit(False))


def auth_failure(message: Column) -> Column:
    m = F.lower(message)
    return F.coalesce(m.contains("authentication") & m.contains("failed"), F.lit(False))


def off_hours(ts: Column) -> Column:
    """Outside 08:00 to 17:59 UTC, whatever the session's time zone; a time without zone is UTC."""
    utc = F.pmod(F.floor(F.unix_micros(ts.cast("timestamp")) / 3_600_000_000), F.lit(24))
    hour = F.when(F.typeof(ts) == "timestamp_ntz", F.hour(ts)).otherwise(utc)
    return ~hour.between(8, 17)


def is_http(protocol: Column) -> Column:
    return protocol.isin("http", "https")


def is_threat(ensemble_pred: Column, anomaly_pred: Column) -> Column:
    return (ensemble_pred == 1) | (anomaly_pred == -1)


def severity(score: Column, anomaly: Column) -> Column:
    return (
        F.when((score > 0.9) | (anomaly > 3.0), "critical")
        .when((score > 0.75) | (anomaly > 2.0), "high")
        .when((score > 0.5) | (anomaly > 1.0), "medium")
        .otherwise("low")
    )


def recommended_action(sev: Column) -> Column:
    return (
        F.when(sev.isin("critical", "high"), ISOLATE)
        .when(sev == "medium", WATCH)
        .otherwise(RECORD)
    )


def severity_rank(sev: Column) -> Column:
    pairs = [F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), sev)


def canary(key: Column, percent: int = 10, numeric: bool = True) -> Column:
    """True for the share of traffic that goes to the candidate model."""
    bucket = F.pmod(key, F.lit(100)) if numeric else F.pmod(F.xxhash64(key), F.lit(100))
    return bucket < percent


def soft_vote(probs: list[Column], weights: list[float]) -> Column:
    total = sum(weights)
    return sum((p * w for p, w in zip(probs, weights)), F.lit(0.0)) / F.lit(total)


def majority_vote(flags: list[Column]) -> Column:
    """-1 when at least two members say -1, else 1."""
    votes = sum(((f == -1).cast("int") for f in flags), F.lit(0))
    return F.when(votes >= 2, F.lit(-1)).otherwise(F.lit(1))


def anomaly_score(decisions: list[Column]) -> Column:
    return sum((-d for d in decisions), F.lit(0.0)) / F.lit(float(len(decisions)))


def priority(
    threat_score: Column, critical_asset: Column, ioc_matches: Column, techniques: Column
) -> Column:
    return (
        threat_score * 40
        + F.when(critical_asset, 30).otherwise(0)
        + F.when(ioc_matches > 0, 20).otherwise(0)
        + F.when(techniques > 2, 10).otherwise(0)
    )
