"""Reading and writing events: files, Kafka frames, alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hawkframe.operators.sliced import micros
from hawkframe.sources.parse import JSON_TIME, partition_key, topic


def read_events(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", stream: bool = False
) -> DataFrame:
    """Files with an explicit schema; nothing is inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).load(path)


def read_json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw JSON lines in a `value` column, ready for `decode`."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path)


def kafka_source_options(
    servers: str,
    topics: list[str],
    group_id: str | None = None,
    starting: str = "earliest",
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
    }
    if group_id:
        options["kafka.group.id"] = group_id
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_sink_options(servers: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.compression.type": "snappy",
        "kafka.acks": "1",
    }


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    """Stream of the subscribed topics as text values; needs the Kafka connector."""
    frame = spark.readStream.format("kafka").options(**kafka_source_options(**options)).load()
    return kafka_values(frame)


def kafka_values(frame: DataFrame) -> DataFrame:
    """Decode the binary key and value of a Kafka frame."""
    keep = [c for c in frame.columns if c not in ("key", "value")]
    return frame.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), *keep
    )


def kafka_rows(df: DataFrame) -> DataFrame:
    """topic, key and JSON value per event, as the Kafka sink expects them.

    Rows with an unknown event type get a NULL topic; the caller counts them
    as failed before writing.
    """
    def col(name: str):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    event_type = F.lit("threat_intel") if "event_type" not in df.columns else F.col("event_type")
    fallback = F.col("event_id") if "event_id" in df.columns else col("ioc_value")
    return df.select(
        topic(event_type).alias("topic"),
        partition_key(col("source_ip"), col("hostname"), fallback.cast("string")).alias("key"),
        F.to_json(F.struct(*df.columns), JSON_TIME).alias("value"),
    )


def write_kafka(df: DataFrame, servers: str) -> None:
    rows = kafka_rows(df).filter("topic is not null")
    rows.write.format("kafka").options(**kafka_sink_options(servers)).save()


def utc_day(df: DataFrame, ts: str = "timestamp") -> Column:
    """Day of a timestamp in UTC, whatever the session's zone; a zone-free one is taken as UTC."""
    return F.date_from_unix_date(F.floor(micros(df, ts) / F.lit(86_400_000_000)).cast("int"))


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Alert table partitioned by day, so retention and reports prune by folder."""
    alerts.withColumn("alert_date", utc_day(alerts)).write.mode(mode).partitionBy("alert_date").parquet(path)


def write_alert_batch(alerts: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch below its days, so that a retried batch replaces itself and readers prune by day."""
    out = alerts.withColumn("alert_date", utc_day(alerts)).withColumn("batch_id", F.lit(batch_id))
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("alert_date", "batch_id")
        .parquet(path)
    )


def compact_alerts(spark: SparkSession, path: str, archive: str, day: str, file_rows: int = 1_000_000) -> None:
    """One day's micro-batches as few large files of the archive, one row per alert (that of the latest batch).

    Only that day is read, and only its folder of the archive is replaced, so repeating it changes nothing. Run it for days
    that get no more alerts; `path` may then drop them by its own expiry rule.
    """
    rows = spark.read.parquet(path).where(F.col("alert_date") == F.lit(day).cast("date"))
    data = [c for c in rows.columns if c != "alert_id"]
    latest = rows.groupBy("alert_id").agg(F.max_by(F.struct(*data), F.struct("batch_id", F.xxhash64(*data))).alias("_row"))
    latest = latest.select("alert_id", *[F.col(f"_row.{c}").alias(c) for c in data if c != "batch_id"])
    (
        latest.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy("alert_date")
        .parquet(archive)
    )


def write_json_lines(rows: DataFrame, path: str, column: str = "value", mode: str = "append") -> None:
    rows.select(column).write.mode(mode).text(path)
