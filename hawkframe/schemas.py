"""Record types, enumerations and defaults of the event model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values of the event model.
EVENT_TYPES = ["network", "endpoint", "application", "threat_intel"]
PROTOCOLS = ["tcp", "udp", "icmp", "http", "https", "dns", "ssh", "other"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
TOPICS = {
    "network": "security.events.network",
    "endpoint": "security.events.endpoint",
    "application": "security.events.application",
    "threat_intel": "security.threat_intelligence",
}

# Fixed order of the model input.
FEATURES = [
    "conn_count_1min",
    "unique_dst_ips_1min",
    "unique_dst_ports_1min",
    "unique_protocols_1min",
    "conn_count_5min",
    "unique_dst_ips_5min",
    "unique_dst_ports_5min",
    "conn_count_1hour",
    "unique_dst_ips_1hour",
    "unique_dst_ports_1hour",
    "payload_size_mean",
    "payload_size_stddev",
    "payload_entropy",
    "dns_entropy",
    "http_ua_entropy",
    "is_novel_port",
    "is_new_country",
    "off_hours_activity",
    "peer_deviation_score",
    "ip_reputation_score",
    "mitre_technique_count",
    "ioc_matches",
    "is_http",
    "is_dns",
    "is_ssh",
]

WINDOWS = {"1min": 60, "5min": 300, "1hour": 3600}
SESSION_TTL = 3600
PORT_TTL = 30 * 86400


def _struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_S, _I, _L, _D, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)

BASE = [
    ("timestamp", _TS),
    ("event_id", _S),
    ("event_type", _S),
    ("source_system", _S),
    ("metadata", T.MapType(_S, _S)),
]

NETWORK_SCHEMA = _struct(
    *BASE,
    ("source_ip", _S),
    ("destination_ip", _S),
    ("source_port", _I),
    ("destination_port", _I),
    ("protocol", _S),
    ("bytes_sent", _L),
    ("bytes_received", _L),
    ("packets_sent", _L),
    ("packets_received", _L),
    ("flags", _S),
    ("payload", _S),
    ("dns_query", _S),
    ("http_method", _S),
    ("http_uri", _S),
    ("http_user_agent", _S),
    ("http_status_code", _I),
)

ENDPOINT_SCHEMA = _struct(
    *BASE,
    ("hostname", _S),
    ("username", _S),
    ("process_name", _S),
    ("process_id", _L),
    ("parent_process_name", _S),
    ("parent_process_id", _L),
    ("command_line", _S),
    ("file_path", _S),
    ("file_hash_md5", _S),
    ("file_hash_sha256", _S),
    ("registry_key", _S),
    ("registry_value", _S),
    ("network_connections", T.ArrayType(T.MapType(_S, _S))),
    ("event_code", _I),
)

APPLICATION_SCHEMA = _struct(
    *BASE,
    ("application_name", _S),
    ("log_level", _S),
    ("message", _S),
    ("source_ip", _S),
    ("user_id", _S),
    ("session_id", _S),
    ("http_method", _S),
    ("http_status_code", _I),
    ("response_time_ms", _D),
    ("error_trace", _S),
)

INTEL_SCHEMA = _struct(
    ("timestamp", _TS),
    ("ioc_type", _S),
    ("ioc_value", _S),
    ("threat_type", _S),
    ("severity", _S),
    ("source", _S),
    ("confidence_score", _D),
    ("description", _S),
    ("mitre_techniques", T.ArrayType(_S)),
    ("tags", T.ArrayType(_S)),
)

ALERT_SCHEMA = _struct(
    ("alert_id", _S),
    ("timestamp", _TS),
    ("severity", _S),
    ("threat_score", _D),
    ("threat_type", _S),
    ("source_ip", _S),
    ("destination_ip", _S),
    ("hostname", _S),
    ("model_confidence", _D),
    (
        "top_features",
        T.ArrayType(_struct(("feature", _S), ("value", _D), ("contribution", _D))),
    ),
    ("recommended_action", _S),
    ("mitre_techniques", T.ArrayType(_S)),
    ("related_events", T.ArrayType(_S)),
    ("is_duplicate", T.BooleanType()),
    ("original_alert_id", _S),
)

SCHEMAS = {
    "network": NETWORK_SCHEMA,
    "endpoint": ENDPOINT_SCHEMA,
    "application": APPLICATION_SCHEMA,
    "threat_intel": INTEL_SCHEMA,
}


@dataclass(frozen=True)
class Settings:
    """Model and alert defaults; every one can be overridden by the caller."""

    random_forest_weight: float = 0.40
    boosted_a_weight: float = 0.35
    boosted_b_weight: float = 0.25
    contamination: float = 0.02
    decision_threshold: float = 0.5
    dedup_window_s: int = 60
    case_severity_threshold: str = "high"
    auto_create_cases: bool = True
    batch_size: int = 128
    windows: dict = field(default_factory=lambda: dict(WINDOWS))
