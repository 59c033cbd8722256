"""Consuming raw events and scoring them end to end on a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hawkframe.operators.intel import add_ioc_flag, add_reputation, with_country
from hawkframe.operators.rules import Rule, matched_rules, technique_list
from hawkframe.plans.features import NARROW, model_input, narrowed, session_form
from hawkframe.plans.scoring import score_features
from hawkframe.schemas import SCHEMAS, WINDOWS
from hawkframe.sources.connectors import write_alert_batch
from hawkframe.sources.parse import decode, events_of, quarantine, split_valid, validate
from hawkframe.streaming.state import WATERMARK, history_features, window_features


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Run `on_batch` per micro-batch; without `every` take what is there and stop.

    Offsets and state are kept in the checkpoint folder, so a restart goes on
    where the last finished batch ended.
    """
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


class _Enough(Exception):
    """Raised at a micro-batch that must not be taken any more, so that its offsets are not committed."""


class Consumption:
    """A running consumer: its query, and how many messages were handed on and how many rejected so far."""

    def __init__(self, max_messages: int | None = None) -> None:
        self.max_messages = max_messages
        self.processed = self.rejected = 0
        self.query: StreamingQuery | None = None

    @property
    def enough(self) -> bool:
        return self.max_messages is not None and self.processed >= self.max_messages

    def wait(self, timeout_s: float | None = None) -> int:
        """Wait until the query ends, `max_messages` are reached or the time is up; the number of messages processed."""
        end = None if timeout_s is None else time.monotonic() + timeout_s
        try:
            while not self.query.awaitTermination(0.5):
                if self.enough:
                    self.query.stop()
                elif end is not None and time.monotonic() >= end:
                    break
        except StreamingQueryException:
            if not self.enough:
                raise
        return self.processed

    def stop(self) -> int:
        self.query.stop()
        return self.processed

    def awaitTermination(self) -> None:  # noqa: N802  (named as in the query it stands for)
        self.wait()


def consume(
    raw: DataFrame,
    handlers: Mapping[str, Callable[[DataFrame, int], None]],
    quarantine_path: str,
    checkpoint: str,
    every: str | None = None,
    max_messages: int | None = None,
) -> Consumption:
    """Decode raw JSON and hand the valid events of each type to its callback.

    Rejected lines and events that break a rule go to the quarantine table with the reason; they never stop the stream,
    and do not count as processed. Messages are taken and committed by micro-batch: with `max_messages` no further
    batch is begun once that many were processed, so a run exceeds it by less than a batch (bound those at the source, by
    `maxOffsetsPerTrigger` or `maxFilesPerTrigger`), and a later run goes on with the next message.
    """
    run = Consumption(max_messages)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if run.enough:
            raise _Enough
        decoded = decode(batch.select("value")).persist()
        try:
            total = decoded.count()
            bad = quarantine(decoded)
            for kind in SCHEMAS:
                valid, invalid = split_valid(validate(events_of(decoded, kind), kind))
                data = [c for c in invalid.columns if c != "failed_rules"]
                bad = bad.unionByName(
                    invalid.select(
                        F.to_json(F.struct(*data)).alias("value"),
                        F.concat(F.lit("failed: "), F.array_join("failed_rules", ",")).alias("reject"),
                    )
                )
                if kind in handlers:
                    handlers[kind](valid, batch_id)
            # Counted while it is written, in no job of its own.
            refused = Observation()
            (
                bad.observe(refused, F.count(F.lit(1)).alias("n"))
                .withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(quarantine_path)
            )
            n = refused.get["n"]
            run.rejected += n
            run.processed += total - n
        finally:
            decoded.unpersist()

    run.query = start(raw, on_batch, checkpoint, every)
    return run


def stream_features(
    events: DataFrame,
    windows: Mapping[str, int] | None = None,
    compat: bool = False,
    reputation: DataFrame | None = None,
    iocs: DataFrame | None = None,
    rules: list[Rule] | None = None,
    ranges: DataFrame | None = None,
    peers: DataFrame | None = None,
    expire: str = "event",
    watermark: str = WATERMARK,
) -> DataFrame:
    """The feature vector on a stream of network events: the columns and, for input in time order, the numbers of `extract_features`.

    `compat` gives the session form. Deviations from peers need whole groups, so they come from `peers` (source_ip,
    peer_deviation_score), the table that `peer_scores` makes of the last finished period; unknown sources get 0.
    `expire` and `watermark` say how state goes, see `streaming.state`.
    """
    windows = {**WINDOWS, **(windows or {})}
    matched = matched_rules(rules) if rules and not compat else None
    techniques = technique_list(matched) if matched is not None else F.array().cast("array<string>")
    rows = events.select(*NARROW, *narrowed(techniques))
    if compat:
        rows = history_features(rows, windows, expire=expire, watermark=watermark)
        rows = session_form(rows, windows)
    else:
        rows = with_country(rows, ranges) if ranges is not None else rows
        rows = window_features(rows, windows, expire=expire, watermark=watermark)
        rows = rows if ranges is not None else rows.withColumn("is_new_country", F.lit(False))
        if peers is None:
            rows = rows.withColumn("peer_deviation_score", F.lit(0.0))
        else:
            known = peers.select("source_ip", "peer_deviation_score")
            rows = rows.join(known, "source_ip", "left").withColumn("peer_deviation_score", F.coalesce("peer_deviation_score", F.lit(0.0)))
    rows = add_reputation(rows, reputation) if reputation is not None else rows.withColumn("ip_reputation_score", F.lit(0))
    rows = add_ioc_flag(rows, iocs) if iocs is not None else rows.withColumn("ioc_matches", F.lit(0))
    return model_input(rows)


def score_stream(
    events: DataFrame,
    alert_path: str,
    checkpoint: str,
    ensemble=None,
    anomaly=None,
    every: str | None = None,
    **feature_options,
) -> StreamingQuery:
    """Events to an alert table: stateful features, then models per micro-batch."""
    features = stream_features(events, **feature_options)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_alert_batch(score_features(batch, ensemble, anomaly), alert_path, batch_id)

    return start(features, on_batch, checkpoint, every)
