"""Exact neighbours: what is written, sessions without Arrow conversion, ties and odd scales."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hawkframe.ml.detector import AnomalyDetector
from hawkframe.ml.neighbors import NeighborIndex, _Search, distinct_points
from hawkframe.session import ensure_checkpoint_dir


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "event_id long, features array<double>")


def test_written_bytes_grow_with_the_rows(spark):
    """In many dimensions every query visits every block; those pairs must not be written."""
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    x = np.random.default_rng(5).normal(size=(3200, 24))
    written = []
    for n in (800, 3200):
        points = distinct_points(_frame(spark, x[:n]), "event_id", "features")
        before = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
        index = NeighborIndex.build(points, pivots=8, block_rows=40)
        assert index.nearest(points.select(F.col("pid").alias("qid"), "vec"), 3).count() == 3 * n
        written.append(sum(f.stat().st_size for f in folder.rglob("*.parquet")) - before)
    assert written[1] < 6 * written[0] and written[1] < 3200 * 24 * 8 * 4


@pytest.mark.parametrize("arrow", ["true", "false"])
def test_nearest_in_sessions_with_and_without_arrow(spark, arrow):
    names = {"spark.sql.execution.arrow.pyspark.enabled": arrow, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {name: spark.conf.get(name) for name in names}
    x = np.random.default_rng(6).normal(size=(300, 12))
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        points = distinct_points(_frame(spark, x), "event_id", "features")
        index = NeighborIndex.build(points, pivots=5, block_rows=20)
        got = {}
        for r in index.nearest(points.select(F.col("pid").alias("qid"), "vec"), 6, skip_self=True).collect():
            got.setdefault(r["qid"], []).append((r["dist"], r["pid"]))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {i: [p for _, p in sorted(v)] for i, v in got.items()} == {i: np.argsort(d[i])[:6].tolist() for i in range(300)}


def test_nearest_of_text_ids_that_tie(spark):
    """Equal distances go by id, also across blocks and packs."""
    grid = [(f"p{i % 7}-{i}", [float(i % 5), float(i // 5 % 5), float(i // 25)]) for i in range(100)]
    df = spark.createDataFrame(grid, "event_id string, features array<double>")
    points = distinct_points(df, "event_id", "features")
    index = NeighborIndex.build(points, pivots=4, block_rows=9)
    got = {}
    for r in index.nearest(points.select(F.col("pid").alias("qid"), "vec"), 5).collect():
        got.setdefault(r["qid"], []).append((r["dist"], r["pid"]))
    for qid, v in grid:
        true = sorted((float(np.sqrt(((np.array(v) - w) ** 2).sum())), pid) for pid, w in ((p, np.array(u)) for p, u in grid))[:5]
        assert [p for _, p in sorted(got[qid])] == [p for _, p in true]


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-30, 0.0), (1e25, 0.0), (1e-3, 1e6), (1e-6, 1.0), (1e160, 0.0)])
def test_products_rule_out_no_neighbour(scale, offset):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(900, 16)) * scale + offset
    y[-3:] = offset + 1e4 * scale
    q, none = y[:60].copy(), np.full(60, np.inf)
    for centre in (np.zeros(16), y.mean(axis=0)):
        with np.errstate(all="ignore"):
            s = _Search(pa.array(range(60)), q, none, y[:1], centre, 8)
            for at in range(0, 900, 300):
                s.visit(pa.array(range(at, at + 300)), y[at : at + 300], np.ones(300, np.int64), [(0, 100, 0.0, np.inf), (0, 200, 0.0, np.inf)])
            rows = [r for b in s.result(False) for r in b.to_pylist()]
            d = np.sqrt(((q[:, None] - y[None]) ** 2).sum(2))
        for i in range(60):
            true = np.lexsort((np.arange(900), d[i]))[:8]
            assert sorted(d[i][[r["pid"] for r in rows if r["qid"] == i]]) == pytest.approx(d[i][true].tolist())


def test_detector_counts_in_a_session_without_arrow(spark):
    """The members' counts of `anomaly_stats` and `anomaly_flags`; every query visits every block, and nothing is written per visit."""
    names = {"spark.sql.execution.arrow.pyspark.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {name: spark.conf.get(name) for name in names}
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    x = np.random.default_rng(8).normal(size=(2500, 24)) * np.arange(1, 25)
    before = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        df = _frame(spark, x)
        model = AnomalyDetector().fit(df, trees=5, samples=64, k=5)
        got = model.training_stats(df).first()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sum(f.stat().st_size for f in folder.rglob("*.parquet")) - before < 2500 * 24 * 8 * 12
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(np.maximum((z**2).sum(1)[:, None] + (z**2).sum(1) - 2 * z @ z.T, 0.0))

    def factors(own, lrd, kd):
        e = d.copy()
        np.fill_diagonal(e, 0.0 if own else np.inf)
        near = np.argsort(e, axis=1, kind="stable")[:, :5]
        dist = np.take_along_axis(e, near, axis=1)
        kd = dist[:, -1] if kd is None else kd
        mine = 1 / (np.maximum(dist, kd[near]).mean(axis=1) + 1e-10)
        return mine, kd, (mine if lrd is None else lrd)[near].mean(axis=1) / mine

    lrd, kd, train = factors(False, None, None)
    assert model.lof.offset == pytest.approx(np.percentile(-train, 2), rel=1e-6)
    again = factors(True, lrd, kd)[2]
    assert got["lof_anomalies"] == (-again < model.lof.offset).sum() > 0
