"""Repeated event ids, one sweep for all windows, and range search."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hawkframe.ml.neighbors import LocalOutlierFactor, ProjectionIndex, distinct_points
from hawkframe.operators.intel import ioc_match_counts, with_country
from hawkframe.operators.limiter import keep_first, limit_calls
from hawkframe.operators.monitor import unusual_rates, volume_spikes
from hawkframe.operators.sampling import row_numbers, stratified_split
from hawkframe.operators.sliced import fitted_slice, ordered_counts, ordered_slices
from hawkframe.operators.state import latest_per_event, novel_in_session, trailing
from hawkframe.plans.features import extract_features


def _events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, source_ip string, destination_port int, bytes_sent long, sec long")
    return df.withColumn("timestamp", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec")


# An id three times at other times, equal rows, one id and time with two ports, a null source and a null port.
REPEATS = [(1, "a", 80, 10, 0), (1, "a", 80, 10, 20), (1, "a", 443, 30, 40), (2, "a", 80, 5, 50), (2, "a", 80, 5, 50)]
REPEATS += [(3, "a", 22, 1, 60), (3, "a", 23, 1, 60), (4, None, None, 7, 0), (4, None, None, 7, 10), (5, "b", 80, 1, 0)]


def test_rows_in_are_rows_out_with_repeated_ids(spark):
    df = _events(spark, REPEATS)
    out = trailing(df, {"w": 30}, {"ports": ["w"]}, {"bytes_sent": "w"}, {"ports": "destination_port"}, {"novel": ("destination_port", 30)})
    got = sorted((r.source_ip or "", r.event_id, r.destination_port or 0, r.conn_count_w, r.ports_w, r.novel, r.bytes_sent_mean) for r in out.collect())
    assert len(got) == len(REPEATS)
    assert [g for g in got if g[1] == 1] == [("a", 1, 80, 0, 1, True, 10.0), ("a", 1, 80, 1, 1, False, 10.0), ("a", 1, 443, 1, 2, True, 20.0)]
    assert sorted(g[3] for g in got if g[1] == 2) == [2, 3] and [g[3:6] for g in got if g[0] == ""] == [(0, 1, False), (1, 1, False)]
    novel = novel_in_session(df, "destination_port").collect()
    assert len(novel) == len(REPEATS)
    first = sorted((r.source_ip or "", r.event_id, r.destination_port or 0) for r in novel if r.is_novel_port)
    assert first == [("", 4, 0), ("a", 1, 80), ("a", 1, 443), ("a", 3, 22), ("a", 3, 23), ("b", 5, 80)]


@pytest.mark.parametrize("most, window", [(1, 7), (3, 20), (40, 60)])
def test_one_hot_burst_over_many_slices(spark, most, window):
    """One client and a null one never pause for a window; the slices decide as one walk over all calls does."""
    rng = np.random.default_rng(most)
    start = datetime(2024, 1, 1)
    seconds = {"hot": np.sort(rng.integers(0, 1500, 6000)) / 2, None: np.arange(400) * 2.5, "calm": np.arange(5) * 500.0}
    rows, expected, i = [], {}, 0
    for source, times in seconds.items():
        log = []
        for t in times.tolist():
            log = [x for x in log if t - x < window]
            expected[i] = (len(log) < most, 0.0 if len(log) < most else log[0] + window - t)
            if expected[i][0]:
                log.append(t)
            rows.append((i, source, start + timedelta(seconds=t)))
            i += 1
    df = spark.createDataFrame(rows, "event_id long, source_ip string, timestamp timestamp").repartition(5)
    out = limit_calls(df, most, window, slice_rows=250)
    got = {r["event_id"]: (r["allowed"], r["wait_s"]) for r in out.collect()}
    assert got == expected and not all(a for a, _ in got.values())


def test_limits_with_repeated_ids(spark):
    df = _events(spark, REPEATS)
    for most in (1, 2, 100):
        out = limit_calls(df, most, 30)
        assert out.count() == len(REPEATS) and out.columns == [*df.columns, "allowed", "wait_s"]
    one = limit_calls(df, 1, 30).where("event_id = 1").orderBy("timestamp").collect()
    assert [r.allowed for r in one] == [True, False, True]
    alerts = df.withColumnsRenamed({"event_id": "alert_id"}).withColumn("threat_type", F.lit("x"))
    kept = keep_first(alerts, 30)
    assert kept.count() == len(REPEATS) and kept.columns == [*alerts.columns, "is_duplicate"]


def test_latest_of_rows_with_one_time_is_settled(spark):
    df = _events(spark, REPEATS)
    picks = {latest_per_event(df.repartition(n)).where("event_id = 3").first().destination_port for n in (1, 2, 3, 5, 7)}
    assert len(picks) == 1


def test_all_windows_come_from_few_shuffles(spark, sf):
    from hawkframe.catalog.tables import network, ranges

    n = network(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = extract_features(n, ranges=ranges(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") <= 8


def test_slices_follow_the_busiest_hour(spark):
    df = _events(spark, [(i, "hot", 1, 1, i % 3600) for i in range(7200)] + [(i, f"s{i}", 1, 1, i * 5000) for i in range(50)])
    assert fitted_slice(df, "source_ip", "timestamp", rows=1200) == 600 * 1_000_000
    assert fitted_slice(df, "source_ip", "timestamp", rows=10) == 120 * 1_000_000
    assert fitted_slice(df.limit(0), "source_ip", "timestamp") == 86400 * 1_000_000


def test_range_search_equals_a_scan(spark):
    rng = np.random.default_rng(9)
    cuts = np.unique(rng.integers(0, 1 << 20, 400))
    some = [(int(a), int(b) - 1, f"c{a}") for a, b in zip(cuts[::2], cuts[1::2], strict=False)] + [(5 << 16, (9 << 16) + 7, "wide")]
    some = [r for r in some if r[2] == "wide" or not (r[0] <= (9 << 16) + 7 and r[1] >= 5 << 16)]
    text = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    asked = [int(x) for x in rng.integers(0, 1 << 21, 3000)] + [r[0] for r in some] + [r[1] for r in some] + [r[1] + 1 for r in some]
    events = spark.createDataFrame([(text(a), a) for a in asked] + [("no address", None), (None, None)], "source_ip string, n long")
    ranges = spark.createDataFrame(some, "start_ip long, end_ip long, country string")
    got = {r.n: r.country for r in with_country(events, ranges).collect()}
    assert got == {a: next((c for lo, hi, c in some if lo <= a <= hi), None) for a in asked} | {None: None}
    assert with_country(events, ranges.limit(0)).where("country is not null").count() == 0


def test_ranks_use_as_many_slices_as_rows_ask_for(spark):
    from pyspark.sql import Window

    df = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"), "id")
    assert ordered_slices(df, "x", 10_000).select("_vs").distinct().count() > 64
    some = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(997)).alias("x"), (F.col("id") % 3).alias("g"))
    for descending in (False, True):
        got = ordered_counts(some, "x", ["g"], descending=descending, rows=100).select("g", "x", "n", "n_before")
        order = F.col("x").desc() if descending else F.col("x").asc()
        counts = some.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counts.withColumn("n_before", earlier).select("g", "x", "n", "n_before").collect()))
    numbered = row_numbers(df.limit(3000), "id", rows=50)
    assert numbered.where("row_no <> id").count() == len([0 for r in numbered.collect() if r.row_no != r.id])
    assert [r.row_no for r in numbered.orderBy("id").collect()] == list(range(3000))
    split = stratified_split(some.withColumn("id", F.monotonically_increasing_id()), "id", "g", rows=100)
    assert {(r.g, r.split): r["count"] for r in split.groupBy("g", "split").count().collect()}[(0, "train")] == 1167


def test_noise_after_silence_is_seen(spark):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [("a", at(0), 5), ("a", at(5), 5), ("a", at(120), 50), ("a", at(180), 40), ("b", at(0), 1), ("b", at(60), 3), (None, at(0), 1), (None, at(60), 4)]
    counts = spark.createDataFrame(rows, "k string, t string, n long").select("k", F.col("t").cast("timestamp_ntz").alias("window_start"), "n")
    got = sorted((r.k or "", str(r.window_start)[11:16], r.n, r.n_before, r.ratio) for r in volume_spikes(counts, by=["k"]).collect())
    assert got == [("", "01:00", 4, 1, 4.0), ("a", "02:00", 50, 0, float("inf")), ("b", "01:00", 3, 1, 3.0)]
    rates = counts.withColumn("rate", F.col("n") / 300.0)
    unusual = sorted((r.k or "", str(r.window_start)[11:16]) for r in unusual_rates(rates, ["k"], 3.0, 3600).collect())
    # One loud window in an otherwise silent hour stands out; the first ones of a label are their own average.
    assert ("a", "02:00") in unusual and ("b", "01:00") in unusual and ("a", "00:00") not in unusual


def test_indicator_hits_keep_rows(spark):
    events = spark.createDataFrame([(1, "x", "y"), (1, "x", None), (2, "q", "y"), (3, None, None)], "event_id long, a string, b string")
    intel = spark.createDataFrame([("t1", "x"), ("t1", "x"), ("t2", "y"), ("t2", "x")], "ioc_type string, ioc_value string")
    got = sorted((r.event_id, r.ioc_matches) for r in ioc_match_counts(events, {"t1": "a", "t2": "b"}, intel).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (3, 0)]


def test_projection_neighbours_reach_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12)) * 3
    x = centres[rng.integers(30, size=6000)] + rng.normal(size=(6000, 12))
    x[-5:] += 40
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(6000 + i, x[0].tolist()) for i in range(5)], "id long, features array<double>").repartition(8)
    points = distinct_points(df, "id", "features").persist()
    index = ProjectionIndex.build(points, leaf_rows=500)
    assert index.points.groupBy("block").count().agg(F.max("count")).first()[0] <= 1000
    queries = points.where("pid % 10 = 0").select(F.col("pid").alias("qid"), "vec")
    got = {}
    for r in index.nearest(queries, 10, skip_self=True).collect():
        got.setdefault(r.qid, set()).add(r.pid)
    hits = wanted = 0
    for i in range(10, 6000, 10):
        true = [j for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable") if j != i][:10]
        hits, wanted = hits + len(got[i] & {*true}), wanted + 10
    assert hits >= 0.9 * wanted
    model = LocalOutlierFactor.fit(df.where("id not between 5995 and 5999"), "id", k=10, contamination=0.002, method="lsh")
    model.save(spark, str(tmp_path / "lof"))
    again = LocalOutlierFactor.load(spark, str(tmp_path / "lof"))
    assert again.method == "lsh"
    worst = {r.id for r in again.score(df, "id").orderBy(F.desc("lof")).limit(5).collect()}
    assert worst == {*range(5995, 6000)}
