"""Repeated ids, hot slices, number texts and time zones."""

import pytest
from pyspark.sql import functions as F

from hawkframe.functions.decisions import off_hours
from hawkframe.ml.ensemble import EnsembleDetector
from hawkframe.operators.alerts import attack_chains, number_text
from hawkframe.operators.sliced import lookup_join
from hawkframe.operators.state import latest_per_event
from hawkframe.schemas import Settings
from hawkframe.sources import parse


def test_number_text(spark):
    values = [12345678.0, 12345678.125, 0.0001, 1.5, -25000000.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == ["12345678.0", "12345678.125", "0.0001", "1.5", "-25000000.5"]


def test_off_hours_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.range(1).select(F.timestamp_seconds(F.lit(12 * 3600)).alias("t"), F.expr("TIMESTAMP_NTZ '2024-01-01 07:59:00'").alias("n"))
        r = df.select(off_hours(F.col("t")).alias("t"), off_hours(F.col("n")).alias("n")).first()
        assert (r.t, r.n) == (False, True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_lookup_join_starts_no_job(spark):
    group = "lookup-join-plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        lookup_join(spark.range(10), spark.range(5), ["id"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_busy_slice_of_one_source_stays_linear(spark):
    step = F.element_at(F.array(*map(F.lit, ("recon", "exploitation", "lateral_movement"))), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit("s").alias("source_ip"), F.timestamp_micros(F.col("id") * 500).alias("timestamp"), step.alias("stage"))
    assert attack_chains(events, "stage", 200).count() == 20_000


def test_latest_row_of_a_repeated_id(spark):
    rows = [("a", 1, 10, 5), ("a", 1, 20, 6), ("b", 1, 5, 7)]
    df = spark.createDataFrame(rows, "source_ip string, event_id long, s long, bytes_sent long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = latest_per_event(df).select("source_ip", "bytes_sent").collect()
    assert sorted((r[0], r[1]) for r in got) == [("a", 6), ("b", 7)]


def test_ensemble_keeps_weights_and_threshold(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5)], int(i % 7 > 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    small = {"random_forest": {"numTrees": 4, "maxDepth": 3}, "boosted_a": {"maxIter": 2, "maxDepth": 2}, "boosted_b": {"maxIter": 2, "maxDepth": 2}}
    model = EnsembleDetector(Settings(random_forest_weight=0.2, boosted_a_weight=0.2, boosted_b_weight=0.6, decision_threshold=0.3)).fit(df, **small)
    model.save(str(tmp_path / "m"))
    again = EnsembleDetector.load(str(tmp_path / "m"))
    assert again.weights == [0.2, 0.2, 0.6] and again.settings.decision_threshold == 0.3
    lost = {r["feature"]: r["importance"] for r in model.permutation_importance(df, "id", "label", ["a", "b"], 3).collect()}
    assert set(lost) == {"a", "b"} and lost["a"] > 0.2 > abs(lost["b"])
    three = df.withColumn("label", F.col("id") % 3)
    with pytest.raises(ValueError):
        EnsembleDetector().fit(three, **small)


def test_decoding_defaults_and_types(spark):
    line = '{"event_type":"network","event_id":"%s","source_system":"z","source_ip":"10.0.0.1","destination_ip":"10.0.0.2","source_port":"80","destination_port":1,"protocol":"tcp"%s}'
    tails = {"plain": "", "text": ',"bytes_sent":"abc"', "part": ',"bytes_sent":10.7', "time": ',"timestamp":"nope"', "large": ',"packets_sent":99999999999999999999'}
    raw = spark.createDataFrame([(line % (k, t),) for k, t in tails.items()], "value string")
    got = {r["network"]["event_id"]: r for r in parse.validate_decoded(parse.decode(raw)).collect()}
    assert {k: r["failed_rules"] for k, r in got.items()} == {
        "plain": [], "text": ["bytes_sent"], "part": ["bytes_sent"], "time": ["timestamp"], "large": ["packets_sent"]
    }
    plain = got["plain"]["network"]
    assert (plain["source_port"], plain["bytes_sent"], plain["packets_received"]) == (80, 0, 0) and plain["timestamp"] is not None
    assert got["time"]["network"]["timestamp"] is None
