"""JSON event parsing, routing and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkframe.functions.text import MD5_PATTERN, SHA256_PATTERN, is_valid_ipv4
from hawkframe.schemas import EVENT_TYPES, PROTOCOLS, SCHEMAS, SEVERITIES, TOPICS

UNKNOWN_TYPE = "unknown event_type"
# JSON text keeps the microseconds of timestamps.
JSON_TIME = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
BAD_JSON = "malformed json"
# Counters that are 0 unless given.
ZERO_BY_DEFAULT = ("bytes_sent", "bytes_received", "packets_sent", "packets_received")


def _numeric_text(raw: Column, kind: T.DataType) -> Column:
    """A number given as text, or a whole number written with a fraction of zero."""
    whole = not isinstance(kind, T.DoubleType)
    return (F.regexp_replace(raw, r"\.0+$", "") if whole else raw).try_cast(kind)


def _completed(record: str, field: T.StructField, document: str) -> tuple[Column, Column | None]:
    """Value of a field with coercion and default, and the field's name where its text has another type."""
    typed, name, kind = F.col(f"{record}.{field.name}"), field.name, field.dataType
    if not isinstance(kind, (T.IntegerType, T.LongType, T.DoubleType, T.TimestampType)):
        return typed.alias(name), None
    raw = F.try_variant_get(F.col(document), f"$.{name}", "string")
    if not isinstance(kind, T.TimestampType):
        typed = F.coalesce(typed, _numeric_text(raw, kind))
    wrong = F.when(raw.isNotNull() & typed.isNull(), F.lit(name))
    if name == "timestamp":
        typed = F.when(raw.isNull(), F.current_timestamp()).otherwise(typed)
    elif name in ZERO_BY_DEFAULT:
        typed = F.when(raw.isNull(), F.lit(0).cast(kind)).otherwise(typed)
    return typed.alias(name), wrong


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON text; adds `event_type`, one struct per type, `mistyped` and `reject`.

    A row keeps only the struct of its own type.  Numbers given as text are
    read, absent or null counters become 0 and absent timestamps the time of
    reading.  `mistyped` names the fields whose text is not of their type (the
    field is NULL).  `reject` names why a row is not an event, else it is NULL.
    """
    kind = F.get_json_object(F.col(value), "$.event_type")
    parsed = [
        F.when(
            kind == name, F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"})
        ).alias(name)
        for name, schema in SCHEMAS.items()
    ]
    staged = raw.select("*", kind.alias("event_type"), *parsed, F.try_parse_json(F.col(value)).alias("_document"))
    # The JSON functions stop after the first value, so text behind it is
    # noticed by the missing closing brace.
    closed = F.endswith(F.rtrim(F.col(value)), F.lit("}"))
    broken = ~F.coalesce(closed, F.lit(False)) | F.col("_document").isNull()
    kind = F.col("event_type")
    reject = F.when(broken, BAD_JSON).when(kind.isNull() | ~kind.isin(*EVENT_TYPES), UNKNOWN_TYPE)
    records, mistyped = [], F.lit(None).cast("array<string>")
    for name, schema in SCHEMAS.items():
        pairs = [_completed(name, f, "_document") for f in schema.fields]
        there = F.col(name).isNotNull()
        records.append(F.when(there, F.struct(*[p[0] for p in pairs])).alias(name))
        mistyped = F.when(there, F.array_compact(F.array(*[p[1] for p in pairs if p[1] is not None]))).otherwise(mistyped)
    return staged.select(*raw.columns, "event_type", *records, mistyped.alias("mistyped"), reject.alias("reject"))


def events_of(decoded: DataFrame, event_type: str) -> DataFrame:
    """Rows of one type as flat columns; other columns of the frame are dropped."""
    return decoded.filter(
        (F.col("event_type") == event_type) & F.col("reject").isNull()
    ).select(f"{event_type}.*")


def quarantine(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.filter(F.col("reject").isNotNull()).select(value, "reject")


def union_events(frames: list[DataFrame]) -> DataFrame:
    """One frame from several event types; missing fields become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def topic(event_type: Column) -> Column:
    """Topic of an event type, NULL when unknown."""
    pairs = [F.lit(x) for kv in TOPICS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), event_type)


def partition_key(source_ip: Column, hostname: Column, event_id: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(source_ip, empty), F.nullif(hostname, empty), event_id)


def _required(col: Column) -> Column:
    return col.isNull()


def _blank(col: Column) -> Column:
    return F.coalesce(F.length(col), F.lit(0)) < 1


def _outside(col: Column, low, high=None) -> Column:
    bad = col < low
    return bad if high is None else bad | (col > high)


def _too_long(col: Column, limit: int) -> Column:
    return F.length(col) > limit


def _not_in(col: Column, allowed: list[str]) -> Column:
    return col.isNull() | ~col.isin(*allowed)


def _no_match(col: Column, pattern: str) -> Column:
    return ~col.rlike(pattern)


# Each rule takes a function from field name to column and is true on a breach.
_BASE = {"event_id": lambda c: _blank(c("event_id")), "source_system": lambda c: _blank(c("source_system"))}

RULES = {
    "network": {
        **_BASE,
        "source_ip": lambda c: ~is_valid_ipv4(c("source_ip")),
        "destination_ip": lambda c: ~is_valid_ipv4(c("destination_ip")),
        "source_port": lambda c: _required(c("source_port")) | _outside(c("source_port"), 0, 65535),
        "destination_port": lambda c: _required(c("destination_port"))
        | _outside(c("destination_port"), 0, 65535),
        "protocol": lambda c: _not_in(c("protocol"), PROTOCOLS),
        "bytes_sent": lambda c: _outside(c("bytes_sent"), 0),
        "bytes_received": lambda c: _outside(c("bytes_received"), 0),
        "packets_sent": lambda c: _outside(c("packets_sent"), 0),
        "packets_received": lambda c: _outside(c("packets_received"), 0),
        "payload": lambda c: _too_long(c("payload"), 10000),
        "http_status_code": lambda c: _outside(c("http_status_code"), 100, 599),
    },
    "endpoint": {
        **_BASE,
        "hostname": lambda c: _blank(c("hostname")),
        "process_id": lambda c: _outside(c("process_id"), 0),
        "parent_process_id": lambda c: _outside(c("parent_process_id"), 0),
        "command_line": lambda c: _too_long(c("command_line"), 5000),
        "file_hash_md5": lambda c: _no_match(c("file_hash_md5"), MD5_PATTERN),
        "file_hash_sha256": lambda c: _no_match(c("file_hash_sha256"), SHA256_PATTERN),
    },
    "application": {
        **_BASE,
        "application_name": lambda c: _blank(c("application_name")),
        "log_level": lambda c: _required(c("log_level")),
        "message": lambda c: _required(c("message")) | _too_long(c("message"), 10000),
        "http_status_code": lambda c: _outside(c("http_status_code"), 100, 599),
        "response_time_ms": lambda c: _outside(c("response_time_ms"), 0),
    },
    "threat_intel": {
        "ioc_type": lambda c: _required(c("ioc_type")),
        "ioc_value": lambda c: _required(c("ioc_value")),
        "threat_type": lambda c: _required(c("threat_type")),
        "severity": lambda c: _not_in(c("severity"), SEVERITIES),
        "source": lambda c: _required(c("source")),
        "confidence_score": lambda c: _required(c("confidence_score"))
        | _outside(c("confidence_score"), 0, 1),
    },
    "alert": {
        "alert_id": lambda c: _required(c("alert_id")),
        "severity": lambda c: _not_in(c("severity"), SEVERITIES),
        "threat_score": lambda c: _required(c("threat_score")) | _outside(c("threat_score"), 0, 1),
        "threat_type": lambda c: _required(c("threat_type")),
        "model_confidence": lambda c: _required(c("model_confidence"))
        | _outside(c("model_confidence"), 0, 1),
        "recommended_action": lambda c: _required(c("recommended_action")),
    },
}


def failed_rules(event_type: str, columns: list[str], record: str | None = None) -> Column:
    """Names of the fields that break a rule; absent optional columns pass.

    With `record` the fields are read from the struct column of that name.
    """
    prefix = f"{record}." if record else ""
    field = lambda name: F.col(f"{prefix}{name}")
    checks = [
        F.when(F.coalesce(rule(field), F.lit(False)), F.lit(name))
        for name, rule in RULES[event_type].items()
        if name in columns
    ]
    missing = [
        F.lit(n)
        for n in ("event_id", "source_ip", "destination_ip", "hostname")
        if n in RULES[event_type] and n not in columns
    ]
    return F.filter(F.array(*checks, *missing), lambda x: x.isNotNull())


def validate(df: DataFrame, event_type: str) -> DataFrame:
    return df.withColumn("failed_rules", failed_rules(event_type, df.columns))


def validate_decoded(decoded: DataFrame) -> DataFrame:
    """Add `failed_rules` to decoded rows of all types in the same pass; NULL for rejects.

    Fields whose text is not of their type fail too.
    """
    verdict = F.lit(None).cast("array<string>")
    for name, schema in SCHEMAS.items():
        mine = F.col("reject").isNull() & (F.col("event_type") == name)
        failed = F.array_union(failed_rules(name, schema.fieldNames(), name), F.col("mistyped"))
        verdict = F.when(mine, failed).otherwise(verdict)
    return decoded.withColumn("failed_rules", verdict)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("failed_rules") == 0
    return validated.filter(ok).drop("failed_rules"), validated.filter(~ok)


def batch_stats(df: DataFrame, ok: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
    )
