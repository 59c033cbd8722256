"""Window and session features against a per-event simulation."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hawkframe.operators.alerts import alert_group_members, attack_chains, dedup_alerts
from hawkframe.operators.limiter import keep_first, limit_calls
from hawkframe.operators.state import (
    conn_counts,
    latest_per_event,
    not_seen_within,
    novel_in_session,
    session_distinct,
    trailing,
    window_distinct_approx,
)

WINDOWS = {"1min": 60, "5min": 300, "1hour": 3600}


def events(spark, rows):
    """Rows of (id, source, second, port)."""
    df = spark.createDataFrame(rows, "event_id long, source_ip string, s double, destination_port int")
    return df.withColumn("timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).withColumn(
        "bytes_sent", F.col("event_id") * 7 % 1000
    )


def simulate(rows, windows, gap, port_ttl):
    """One event after another over plain Python state."""
    out = {}
    log, seen, ports, last = defaultdict(list), defaultdict(set), defaultdict(set), {}
    for i, src, s, port in sorted(rows, key=lambda r: (r[2], r[0])):
        if src in last and s - last[src] >= gap:
            seen[src].clear()
        if src in last and s - last[src] >= port_ttl:
            ports[src].clear()
        counts = [sum(s - w <= t <= s for t, _ in log[src]) for w in windows.values()]
        distinct = [len({p for t, p in [*log[src], (s, port)] if s - w <= t}) for w in windows.values()]
        recent = [t for t, p in log[src] if p == port and s - t <= port_ttl]
        out[i] = (*counts, len(seen[src]), port not in ports[src], not recent, *distinct)
        log[src].append((s, port))
        seen[src].add(port)
        ports[src].add(port)
        last[src] = s
    return out


@pytest.fixture(scope="module")
def rows():
    """A hot source with a third of the rows, ties, and gaps of exactly the limits."""
    rng = random.Random(3)
    out, clock = [], defaultdict(float)
    for i in range(900):
        src = "hot" if i % 3 == 0 else f"s{rng.randrange(12)}"
        clock[src] += rng.choice([0, 0, 1, 20, 60, 240, 300, 3599, 3600, 3601, 40000])
        out.append((i, src, clock[src], rng.choice([22, 22, 80, 443, rng.randrange(50)])))
    return out


def test_features_equal_simulation(spark, rows):
    df = events(spark, rows)
    out = trailing(df, WINDOWS, slice_us=7_000_000)
    out = session_distinct(out, {"ports": "destination_port"}, 3600)
    out = novel_in_session(out, "destination_port", "novel_s", gap_s=36000)
    out = not_seen_within(out, "destination_port", "novel_w", 36000)
    cols = [*[f"conn_count_{w}" for w in WINDOWS], "ports", "novel_s", "novel_w"]
    got = {r["event_id"]: tuple(r[c] for c in cols) for r in out.collect()}
    expected = {i: v[:6] for i, v in simulate(rows, WINDOWS, 3600, 36000).items()}
    assert got == expected


def test_slices_do_not_change_results(spark, rows):
    df = events(spark, rows)
    results = []
    for slice_us in (1_000_000, 900_000_000, 10**12):
        out = trailing(
            df, WINDOWS, {"ports": list(WINDOWS)}, {"bytes_sent": "1hour"}, {"ports": "destination_port"}, slice_us=slice_us
        )
        results.append(sorted(map(tuple, out.drop("timestamp", "s").collect())))
    assert results[0] == results[1] == results[2]


def test_window_distinct_equals_simulation(spark, rows):
    out = trailing(events(spark, rows), WINDOWS, {"ports": list(WINDOWS)}, columns={"ports": "destination_port"})
    got = {r["event_id"]: tuple(r[f"ports_{w}"] for w in WINDOWS) for r in out.collect()}
    assert got == {i: v[6:] for i, v in simulate(rows, WINDOWS, 3600, 36000).items()}
    for r in out.collect():
        assert all(1 <= r[f"ports_{w}"] <= r[f"conn_count_{w}"] + 1 for w in WINDOWS)


def test_hand_checked_state(spark):
    rows = [(1, "a", 0.0, 80), (2, "a", 30.0, 443), (3, "a", 60.0, 80), (4, "a", 61.0, 22), (5, "a", 3700.0, 80)]
    df = events(spark, rows)
    out = trailing(df, WINDOWS, {"w": ["1hour"]}, columns={"w": "destination_port"})
    out = session_distinct(out, {"ports": "destination_port"}, 3600)
    out = novel_in_session(out, "destination_port").orderBy("event_id").collect()
    assert [r["conn_count_1min"] for r in out] == [0, 1, 2, 2, 0]
    assert [r["conn_count_5min"] for r in out] == [0, 1, 2, 3, 0]
    assert [r["ports"] for r in out] == [0, 1, 2, 2, 0]
    assert [r["w_1hour"] for r in out] == [1, 2, 2, 3, 1]
    assert [r["is_novel_port"] for r in out] == [True, True, False, True, False]


def test_window_distinct_approx_counts_whole_slices(spark, rows):
    got = window_distinct_approx(events(spark, rows), "destination_port", 3600, "n", parts=12)
    part = lambda s: s // 300
    for r in got.select("event_id", "source_ip", "s", "n").collect():
        near = {p for _, src, s, p in rows if src == r["source_ip"] and part(r["s"]) - 12 <= part(s) <= part(r["s"])}
        assert abs(r["n"] - len(near)) <= 0.05 * len(near)


def test_repeated_event_counts_once_with_latest_time(spark):
    df = events(spark, [(1, "a", 10.0, 80), (1, "a", 50.0, 81), (2, "a", 20.0, 80)])
    got = {r["event_id"]: r["destination_port"] for r in latest_per_event(df).collect()}
    assert got == {1: 81, 2: 80}
    assert conn_counts(latest_per_event(df), WINDOWS).filter("event_id = 1").first()["conn_count_1min"] == 1


def _alerts(spark, seconds):
    df = spark.createDataFrame([(f"a{i}", float(s)) for i, s in enumerate(seconds)], "alert_id string, s double")
    return df.select(
        "alert_id",
        F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("timestamp"),
        F.lit("x").alias("source_ip"),
        F.lit("scan").alias("threat_type"),
    )


def test_dedup_modes(spark):
    df = _alerts(spark, [0, 59, 118, 178])
    any_mode = dedup_alerts(df).orderBy("timestamp").collect()
    assert [r["is_duplicate"] for r in any_mode] == [False, True, True, False]
    assert [r["original_alert_id"] for r in any_mode] == [None, "a0", "a0", None]
    first = keep_first(df).orderBy("timestamp").collect()
    assert [r["is_duplicate"] for r in first] == [False, True, False, False]


def test_dedup_keeps_originals(spark):
    df = _alerts(spark, [0, 10, 200, 215, 300])
    originals = dedup_alerts(df).filter("not is_duplicate").drop("is_duplicate", "original_alert_id")
    assert dedup_alerts(originals).filter("is_duplicate").count() == 0


def test_groups_span_bursts(spark):
    out = alert_group_members(_alerts(spark, [0, 50, 90, 500]), 60).orderBy("timestamp").collect()
    assert [r["group_id"] for r in out] == ["a0", "a0", "a0", "a3"]


def test_rate_limit_vector(spark):
    df = events(spark, [(i, "a", float(s), 1) for i, s in enumerate([0, 1, 5, 10, 11, 12])])
    out = limit_calls(df, 2, 10).orderBy("event_id").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True, True, False]
    assert [r["wait_s"] for r in out] == [0, 0, 5, 0, 0, 8]


def test_rate_limit_equals_simulation(spark, rows):
    df = events(spark, rows)
    log, expected = defaultdict(list), {}
    for i, src, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        log[src] = [t for t in log[src] if s - t < 600]
        expected[i] = len(log[src]) < 3
        if expected[i]:
            log[src].append(s)
    got = {r["event_id"]: r["allowed"] for r in limit_calls(df, 3, 600).collect()}
    assert got == expected and not all(got.values())


def test_attack_chain_equals_brute_force(spark):
    rng = random.Random(5)
    kinds = ["recon", "exploitation", "lateral_movement", "other"]
    rows = [(i, f"s{i % 3}", float(rng.randrange(3000)), rng.choice(kinds)) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id long, source_ip string, s double, stage string").withColumn(
        "timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))
    )
    expected = {}
    for i, src, s, kind in rows:
        if kind != "recon":
            continue
        pairs = [
            (b[2], c[2])
            for b in rows
            for c in rows
            if b[1] == c[1] == src and b[3] == kinds[1] and c[3] == kinds[2] and s < b[2] < c[2] <= s + 200
        ]
        if pairs:
            expected[i] = (min(p[0] for p in pairs) * 1e6, min(p[1] for p in pairs) * 1e6)
    got = {r["event_id"]: (r["exploitation_us"], r["lateral_us"]) for r in attack_chains(df, "stage", 200).collect()}
    assert got == expected and got
