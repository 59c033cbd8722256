"""Sources, sinks, scoring with trained models, and plan shapes."""

import pytest
from pyspark.sql import functions as F

from hawkframe.catalog.tables import network, table
from hawkframe.ml.detector import AnomalyDetector
from hawkframe.ml.ensemble import EnsembleDetector
from hawkframe.operators.sliced import running_sums, slice_of
from hawkframe.operators.state import trailing
from hawkframe.operators.tumbling import protocol_map, tumble_features
from hawkframe.plans.features import extract_features, feature_array
from hawkframe.plans.scoring import batch_score, score_events, score_features
from hawkframe.schemas import FEATURES, NETWORK_SCHEMA
from hawkframe.session import durable, ensure_checkpoint_dir
from hawkframe.sources import connectors
from test_models import SMALL


@pytest.fixture(scope="module")
def net(spark, sf):
    return network(spark, sf).withColumns({"source_port": F.lit(50000), "source_system": F.lit("zeek")})


def test_files_need_no_inference(spark, net, tmp_path):
    rows = net.select("event_id", "source_ip", "destination_port")
    connectors.write_json_lines(rows.select(F.to_json(F.struct("*")).alias("value")), str(tmp_path / "j"))
    back = connectors.read_events(spark, str(tmp_path / "j"), NETWORK_SCHEMA)
    assert back.schema == NETWORK_SCHEMA and back.filter("source_ip is not null").count() == rows.count()


def test_kafka_frame_and_options(spark, net):
    df = net.select(F.col("event_id").cast("string"), "source_ip", F.lit("network").alias("event_type"))
    row = connectors.kafka_rows(df).first()
    assert row["topic"] == "security.events.network" and row["key"].startswith("10.0.")
    assert '"source_ip"' in row["value"]
    frame = spark.createDataFrame([(bytearray(b"k"), bytearray(b"{}"), "t")], "key binary, value binary, topic string")
    assert tuple(connectors.kafka_values(frame).first()) == ("k", "{}", "t")
    options = connectors.kafka_source_options("h:1", ["a", "b"], "g", max_per_trigger=500)
    assert options["subscribe"] == "a,b" and options["maxOffsetsPerTrigger"] == "500"
    intel = spark.createDataFrame([("domain", "x.com")], "ioc_type string, ioc_value string")
    out = connectors.kafka_rows(intel).first()
    assert (out["topic"], out["key"]) == ("security.threat_intelligence", "x.com")


def test_alert_table_prunes_days(spark, net, tmp_path):
    path = str(tmp_path / "alerts")
    connectors.write_alerts(score_events(net), path)
    day = spark.read.parquet(path).filter("alert_date = date'2024-01-05'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(alert_date" in plan
    assert day.count() == net.filter("to_date(timestamp) = date'2024-01-05'").count()


def test_batch_score_isolates_bad_events(spark, net):
    bad = net.withColumn("source_port", F.when(F.col("event_id") % 10 == 0, 99999).otherwise(1))
    alerts, rejected, stats = batch_score(bad)
    r = stats.first()
    assert (r["total"], r["failed"]) == (bad.count(), bad.filter("source_port > 65535").count())
    assert alerts.count() == r["successful"] and rejected.count() == r["failed"]
    none = batch_score(net.limit(0))[2].first()
    assert (none["total"], none["successful"], none["failed"]) == (0, 0, 0)


def test_windows_can_be_overridden(net):
    wide = extract_features(net, {"1min": 86400}, compat=True)
    assert wide.agg(F.max("conn_count_1min")).first()[0] > extract_features(net, compat=True).agg(F.max("conn_count_1min")).first()[0]
    assert len(FEATURES) == 25 and wide.select(F.size(feature_array())).first()[0] == 25


def test_compat_keeps_constants(net):
    out = extract_features(net, compat=True)
    r = out.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in ("payload_size_stddev", "peer_deviation_score", "is_new_country", "mitre_technique_count")]).first()
    assert tuple(r) == (0, 0, 0, 0)


def test_scoring_with_trained_models(spark, net):
    features = durable(extract_features(net, compat=True)).withColumn("features", feature_array())
    labelled = features.withColumn("label", (F.col("is_dns") == 1).cast("int"))
    ensemble = EnsembleDetector().fit(labelled, **SMALL)
    anomaly = AnomalyDetector().fit(features, trees=20, k=5)
    out = score_features(features.drop("features"), ensemble, anomaly).cache()
    assert out.count() == net.count()
    hit = out.join(labelled.select("event_id", "label"), "event_id")
    assert hit.filter("label = 1 and ensemble_pred = 1").count() == hit.filter("label = 1").count()
    assert out.filter("is_threat <> (ensemble_pred = 1 or anomaly_pred = -1)").count() == 0
    assert {"random_forest_score", "lof_score"} <= set(out.columns)
    assert out.select("severity").distinct().count() > 1


def test_protocol_map(net):
    total = protocol_map(net).select(F.explode("protocols")).agg(F.sum("value")).first()[0]
    assert total == net.count()


# Plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 40").select("l_orderkey")
    plan = _plan(li)
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "html" not in _plan(tumble_features(network(spark, sf), "1 hour"))


def test_hot_source_is_windowed_in_slices(spark):
    """A third of all rows in one source: no window task may hold that source."""
    rows = spark.range(30000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("source_ip"),
        F.timestamp_micros(F.col("id") * 2_000_000).alias("timestamp"),
    )
    assert trailing(rows, {"1min": 60}).filter("source_ip = 'hot' and event_id >= 30").agg(F.min("conn_count_1min"), F.max("conn_count_1min")).first() == (10, 10)
    t = rows.withColumn("t", F.unix_micros("timestamp")).withColumn("slice", slice_of(F.col("t"), 600_000_000))
    largest = t.groupBy("source_ip", "slice").count().agg(F.max("count")).first()[0]
    assert largest <= 100
    summed = running_sums(t, ["source_ip"], "slice", ["t"], {"n": F.lit(1)})
    assert summed.filter("source_ip = 'hot'").agg(F.max("n")).first()[0] == 9999
    windows = [l for l in _plan(summed).split("\n") if "Window [sum(1)" in l or "Window [" in l]
    assert any("slice" in l for l in windows)


def test_durable_uses_the_sessions_folder(spark, tmp_path):
    folder = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == folder
    assert durable(spark.range(3)).count() == 3
