"""Detectors on small planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hawkframe.ml.detector import AnomalyDetector
from hawkframe.ml.ensemble import EnsembleDetector
from hawkframe.ml.iforest import IsolationForest
from hawkframe.ml.neighbors import LocalOutlierFactor, NeighborIndex, distinct_points
from hawkframe.ml.ocsvm import OneClassSVM
from hawkframe.ml.scale import Scaler

SMALL = {
    "random_forest": {"numTrees": 10, "maxDepth": 5},
    "boosted_a": {"maxIter": 4, "maxDepth": 3},
    "boosted_b": {"maxIter": 4, "maxDepth": 3},
}


@pytest.fixture(scope="module")
def blobs(spark):
    """300 normal points and 6 far ones."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 5)), rng.normal(9, 0.5, (6, 5)) * rng.choice([-1, 1], (6, 5))])
    rows = [(i, [float(v) for v in p], int(i >= 300)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "event_id long, features array<double>, label int").repartition(3).cache()


def _worst(df, score, n=6):
    return {r["event_id"] for r in df.orderBy(F.asc(score)).limit(n).collect()}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    s = Scaler.fit(df)
    assert (s.mean, s.std) == ([2.0, 5.0], [1.0, 1.0])
    assert [r[0] for r in df.select(s.apply()).collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_isolation_forest_ranks_outliers(blobs):
    model = IsolationForest.fit(blobs.filter("label = 0"), "event_id")
    assert model.nodes["tree"].nunique() == 100
    out = blobs.select("event_id", "label", model.decision().alias("d"))
    assert _worst(out, "d") == set(range(300, 306))
    share = out.filter("label = 0 and d < 0").count()
    assert share == 6  # two per cent of the training rows
    again = IsolationForest.fit(blobs.filter("label = 0"), "event_id")
    assert again.offset == model.offset


def test_one_class_svm_ranks_outliers(blobs):
    model = OneClassSVM.fit(blobs.filter("label = 0"), nu=0.1)
    out = blobs.select("event_id", "label", model.decision().alias("d"))
    assert _worst(out, "d") == set(range(300, 306))
    assert out.filter("label = 0 and d < 0").count() == 30


def _lof(train, k, query=None):
    """Brute force; copies are separate points, the query itself is left out."""
    d = np.sqrt(((train[:, None] - train[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, 1)[:, k - 1]
    order = np.argsort(d, 1, kind="stable")[:, :k]
    reach = np.maximum(np.take_along_axis(d, order, 1), kd[order])
    lrd = 1 / (reach.mean(1) + 1e-10)
    own = lrd[order].mean(1) / lrd
    if query is None:
        return own
    q = np.sqrt(((query[:, None] - train[None]) ** 2).sum(2))
    order = np.argsort(q, 1, kind="stable")[:, :k]
    mine = 1 / (np.maximum(np.take_along_axis(q, order, 1), kd[order]).mean(1) + 1e-10)
    return lrd[order].mean(1) / mine


def test_lof_equals_brute_force(spark, blobs):
    rows = sorted(blobs.collect(), key=lambda r: r["event_id"])
    x = np.array([r["features"] for r in rows])
    train = x[:300]
    model = LocalOutlierFactor.fit(blobs.filter("label = 0"), "event_id", k=10)
    assert model.offset == pytest.approx(np.percentile(-_lof(train, 10), 2), rel=1e-9)
    got = {r["event_id"]: r["lof"] for r in model.score(blobs, "event_id").collect()}
    expected = _lof(train, 10, x)
    assert [got[i] for i in range(306)] == pytest.approx(list(expected), rel=1e-9)
    assert set(sorted(got, key=got.get)[-6:]) == set(range(300, 306))


def test_lof_with_a_third_of_copies(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (80, 3)), np.tile([[0.5, 0.5, 0.5]], (40, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "event_id long, features array<double>")
    points = distinct_points(df, "event_id", "features")
    assert points.count() == 81 and points.agg(F.max("weight")).first()[0] == 40
    # Fewer neighbours than copies: the copies' density is the ceiling of the formula.
    model = LocalOutlierFactor.fit(df, "event_id", k=5)
    out = {r["event_id"]: r["lof"] for r in model.score(df, "event_id").collect()}
    expected = _lof(x, 5, x)
    assert [out[i] for i in range(120)] == pytest.approx(list(expected), rel=1e-6)


@pytest.mark.parametrize("block_rows, pivots", [(7, 3), (1000, 1), (16, 20)])
def test_nearest_is_exact_for_any_blocks(spark, blobs, block_rows, pivots):
    points = distinct_points(blobs, "event_id", "features")
    index = NeighborIndex.build(points, pivots, block_rows)
    queries = points.select(F.col("pid").alias("qid"), "vec")
    got = {}
    for r in index.nearest(queries, 4, skip_self=True).collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["pid"]))
    x = np.array([r["features"] for r in sorted(blobs.collect(), key=lambda r: r["event_id"])])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [p for _, p in sorted(got[i])] == list(np.argsort(d[i])[:4])


def test_blocks_prune_far_points(spark):
    """Well separated clusters: a query visits its own cluster only."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(100 * (i % 8) + rng.normal()), float(rng.normal())]) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, features array<double>")
    points = distinct_points(df, "event_id", "features")
    index = NeighborIndex.build(points, pivots=16, block_rows=20)
    visited = points.select(F.size(index._route(5)).alias("n")).agg(F.avg("n")).first()[0]
    assert visited < len(index.blocks) / 4


def test_detector_votes_and_reloads(spark, blobs, tmp_path):
    fresh = AnomalyDetector(contamination=0.05)
    with pytest.raises(ValueError):
        fresh.transform(blobs)
    model = fresh.fit(blobs.filter("label = 0"), trees=40, k=10)
    out = model.transform(blobs).select("event_id", "label", "anomaly_pred", "anomaly_score").cache()
    normal = out.filter("label = 0").agg(F.avg((F.col("anomaly_pred") == -1).cast("int"))).first()[0]
    assert out.filter("label = 1 and anomaly_pred = -1").count() == 6 and normal < 0.1
    stats = model.training_stats(blobs.filter("label = 0")).first()
    assert stats["isolation_forest_anomalies"] == 15 and stats["ensemble_anomalies"] <= 30
    model.save(spark, str(tmp_path / "m"))
    again = AnomalyDetector.load(spark, str(tmp_path / "m")).transform(blobs)
    pairs = again.select("event_id", F.col("anomaly_score").alias("s")).join(out, "event_id")
    assert pairs.agg(F.max(F.abs(F.col("s") - F.col("anomaly_score")))).first()[0] < 1e-9


def test_ensemble(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        y = int(i % 10 == 0)
        rows.append((i, y, [float(rng.normal(3.0 * y)), float(rng.normal()), float(rng.normal(1.0 * y))]))
    df = spark.createDataFrame(rows, "event_id long, label int, features array<double>")
    model = EnsembleDetector()
    with pytest.raises(ValueError):
        model.transform(df)
    model.fit(df, **SMALL)
    assert sum(model.weights) == pytest.approx(1.0)
    out = model.transform(df).cache()
    r = out.agg(F.min("threat_score"), F.max("threat_score"), F.min("model_confidence")).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] >= 0
    bad = out.filter("ensemble_pred <> cast(threat_score > 0.5 as int)").count()
    assert bad == 0
    report = model.evaluate(df).first()
    assert report["auc"] > 0.9 and report["tp"] + report["fn"] == 40
    both = {r["split"]: r for r in model.training_report(df, df.filter("event_id >= 200")).collect()}
    assert both["train"]["auc"] == report["auc"] and 0 <= both["validation"]["accuracy"] <= 1
    names = ["a", "b", "c"]
    assert set(model.importances(names)) == {"random_forest", "boosted_a", "boosted_b"}
    top = model.top_importances(spark, names, 2).collect()
    assert len(top) == 2 and top[0]["feature"] == "a"
    perm = {r["feature"]: r["importance"] for r in model.permutation_importance(df, "event_id", "label", names, repeats=1).collect()}
    assert perm["a"] > perm["b"]
    model.save(str(tmp_path / "e"))
    again = EnsembleDetector.load(str(tmp_path / "e")).transform(df)
    diff = again.select("event_id", F.col("threat_score").alias("t")).join(out, "event_id").agg(F.max(F.abs(F.col("t") - F.col("threat_score")))).first()[0]
    assert diff < 1e-9
