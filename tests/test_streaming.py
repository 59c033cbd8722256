"""Streams over small file sources, compared with the batch functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hawkframe.catalog.feature_queries import PORT_RULES
from hawkframe.catalog.tables import alerts, assets, network, ranges
from hawkframe.operators.intel import peer_scores
from hawkframe.operators.limiter import limit_calls
from hawkframe.operators.state import not_seen_within, novel_in_session, session_distinct, trailing
from hawkframe.operators.tumbling import tumble_features
from hawkframe.plans.features import extract_features
from hawkframe.schemas import FEATURES
from hawkframe.sources.connectors import compact_alerts, read_json_lines, utc_day, write_alert_batch
from hawkframe.streaming.pipeline import consume, score_stream, stream_features
from hawkframe.streaming.state import history_features, limit_stream, window_features
from hawkframe.streaming.windows import late_rows, session_stream, suppress_repeats, tumbling_stream

WINDOWS = {"1min": 60, "5min": 300, "1hour": 3600, "1day": 86400}


def _stream(spark, df, path, files=3):
    """The rows in time order as several files, one per micro-batch."""
    ordered = df.withColumn("_b", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy("timestamp", "event_id"))).persist()
    for b in range(1, files + 1):
        ordered.filter(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").parquet(path)
    schema = df.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_history_features_equal_batch(spark, sf, tmp_path):
    n = network(spark, sf).select("event_id", "timestamp", "source_ip", "destination_ip", "destination_port", "protocol", "bytes_sent")
    stream = history_features(_stream(spark, n, str(tmp_path / "in")), WINDOWS, session_s=6 * 3600)
    _run(stream, "history")
    cols = ["event_id", *[f"conn_count_{w}" for w in WINDOWS], "unique_dst_ips", "unique_dst_ports", "unique_protocols", "is_novel_port"]
    batch = trailing(n, WINDOWS)
    batch = session_distinct(
        batch, {"unique_dst_ips": "destination_ip", "unique_dst_ports": "destination_port", "unique_protocols": "protocol"}, 6 * 3600
    )
    batch = novel_in_session(batch, "destination_port")
    got = _rows(spark.table("history"), *cols)
    assert got == _rows(batch, *cols) and len(got) == n.count()


def test_stream_vector_equals_batch_vector(spark, sf, tmp_path):
    n = network(spark, sf).drop("user_id", "kind", "value", "stage")
    _run(stream_features(_stream(spark, n, str(tmp_path / "in"), 2), compat=True), "vector")
    expected = extract_features(n, compat=True)
    show = ["event_id", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in FEATURES]]
    assert _rows(spark.table("vector"), *show) == _rows(expected, *show)


def test_stream_vector_equals_designed_vector(spark, sf, tmp_path):
    n = network(spark, sf).drop("user_id", "value", "stage")
    ips = n.select("destination_ip").distinct().limit(20).persist()
    given = {"iocs": ips, "rules": PORT_RULES, "ranges": ranges(spark, sf)}
    windows = {"1min": 3600, "5min": 6 * 3600, "1hour": 86400}
    peers = peer_scores(n, assets(spark, sf))
    stream = stream_features(_stream(spark, n, str(tmp_path / "in"), 4), windows, peers=peers, **given)
    _run(stream, "designed")
    expected = extract_features(n, windows, assets=assets(spark, sf), **given)
    assert stream.columns == expected.columns
    show = ["event_id", "mitre_techniques", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in FEATURES]]
    got = _rows(spark.table("designed"), *show)
    assert got == _rows(expected, *show) and len(got) == n.count()
    assert len({r[2 + FEATURES.index("unique_dst_ips_1hour")] for r in got}) > 2


def _timed_rows(spark, path, rows):
    """One file, and so one micro-batch, per row or list of rows of (event_id, source, port, time)."""
    schema = "event_id long, source_ip string, destination_ip string, destination_port int, protocol string, bytes_sent long, ts string"
    for some in rows:
        df = spark.createDataFrame([(i, s, f"d{p}", p, "tcp", b, t) for i, s, p, b, t in some], schema)
        df = df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


STATES = {"window": ["ring", "uses", "is_novel_port"], "history": ["times", "seen", "ports"], "limit": ["log"]}


@pytest.mark.parametrize("kind", list(STATES))
def test_state_of_a_silent_source_goes(spark, tmp_path, kind):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    rows = [[(1, "silent", 80, 10, day(1)), (2, "silent", 81, None, day(1)), (3, "busy", 80, 5, day(1))]]
    rows += [[(10 + d, "busy", 80 + d, d, day(d))] for d in (2, 3, 4, 5)] + [[(20, "silent", 80, 7, day(6))]]
    stream = _timed_rows(spark, str(tmp_path / "in"), rows[:-1])
    windows = {"1min": 60, "5min": 300, "1hour": 3600}
    made = {
        "window": lambda: window_features(stream, windows, port_s=86400),
        "history": lambda: history_features(stream, windows, port_s=86400),
        "limit": lambda: limit_stream(stream, 1, 3600),
    }[kind]
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def go():
        q = made().writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    for name in STATES[kind]:
        left = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        keys = {r[0].source_ip if hasattr(r[0], "source_ip") else r[0][0] for r in left.load().select("key").collect()}
        assert keys <= {"busy"}, name
    # After its silence the source starts anew.
    _timed_rows(spark, str(tmp_path / "in"), rows[-1:])
    go()
    back = spark.read.parquet(sink).where("event_id = 20").first()
    assert spark.read.parquet(sink).count() == 8
    if kind == "limit":
        assert back.allowed
    else:
        assert back.is_novel_port and back.conn_count_1hour == 0


@pytest.mark.parametrize("compat", [False])
def test_state_with_a_time_to_live(spark, sf, tmp_path, compat):
    n = network(spark, sf).drop("user_id", "kind", "value", "stage")
    stream = stream_features(_stream(spark, n, str(tmp_path / "in"), 2), compat=compat, expire="processing")
    name = f"lives_{compat}".lower()
    # Without this, entries that may expire at any time keep an `availableNow` query running for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        _run(stream, name)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    expected = extract_features(n, compat=compat)
    show = ["event_id", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in FEATURES]]
    assert _rows(spark.table(name), *show) == _rows(expected, *show)
    with pytest.raises(ValueError):
        stream_features(n, expire="never")


def test_window_features_at_edges(spark, tmp_path):
    """Equal moments, window bounds, nulls and repeated values against sets."""
    rng = np.random.default_rng(6)
    rows, t = [], 0
    for i in range(240):
        t += int(rng.choice([0, 0, 1, 29, 30, 61, 400]))
        b = None if rng.random() < 0.1 else int(rng.integers(1 << 40))
        port = None if rng.random() < 0.1 else int(rng.integers(6))
        rows.append((i, "ab"[int(rng.random() < 0.3)], port, b, str(np.datetime64("2024-01-01") + np.timedelta64(t, "s")).replace("T", " ")))
    windows = {"1min": 60, "5min": 300, "1hour": 1200}
    stream = _timed_rows(spark, str(tmp_path / "in"), [rows[k : k + 60] for k in range(0, 240, 60)])
    _run(window_features(stream, windows, port_s=400), "edges")
    batch = spark.read.schema(stream.schema).parquet(str(tmp_path / "in")).persist()
    want = trailing(
        batch, windows, {"unique_dst_ports": list(windows), "unique_protocols": ["1min"]}, {"bytes_sent": "1hour"}, {"unique_dst_ports": "destination_port", "unique_protocols": "protocol"}
    )
    want = not_seen_within(want, "destination_port", "is_novel_port", 400)
    names = [*[f"conn_count_{w}" for w in windows], *[f"unique_dst_ports_{w}" for w in windows], "unique_protocols_1min", "is_novel_port"]
    assert _rows(spark.table("edges"), "event_id", *names) == _rows(want, "event_id", *names)
    near = lambda df, m, s: {r[0]: (None if r[1] is None else round(r[1], 3), None if r[2] is None else round(r[2], 2)) for r in df.select("event_id", m, s).collect()}
    assert near(spark.table("edges"), "payload_size_mean", "payload_size_stddev") == near(want, "bytes_sent_mean", "bytes_sent_stddev")


def test_limit_stream_equals_batch(spark, sf, tmp_path):
    calls = network(spark, sf).select("event_id", "source_ip", "timestamp")
    _run(limit_stream(_stream(spark, calls, str(tmp_path / "in")), 2, 86400), "limited")
    got = _rows(spark.table("limited"), "event_id", "allowed")
    assert got == _rows(limit_calls(calls, 2, 86400), "event_id", "allowed")
    assert any(not r[1] for r in got)


def _closed(spark, df, path, ts="timestamp"):
    """Append one far later row, so that the watermark passes all others."""
    last = df.limit(1).withColumn(ts, F.lit("2025-01-01").cast("timestamp_ntz")).withColumn("source_ip", F.lit("9.9.9.9"))
    for part in (df, last):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tumbling_stream_equals_batch(spark, sf, tmp_path):
    n = network(spark, sf).select("event_id", "timestamp", "source_ip", "destination_ip", "destination_port", "bytes_sent")
    stream = tumbling_stream(_closed(spark, n, str(tmp_path / "in")), "1 hour", exact=True)
    _run(stream, "tumbling")
    cols = ["source_ip", "window_end", "connection_count", "unique_dst_ips", "unique_dst_ports", F.round("avg_bytes_sent", 4)]
    got = _rows(spark.table("tumbling").filter("source_ip <> '9.9.9.9'"), *cols)
    assert got == _rows(tumble_features(n, "1 hour"), *cols)


def test_session_stream(spark, sf, tmp_path):
    from hawkframe.catalog import all_queries

    n = network(spark, sf).select("event_id", "timestamp", "source_ip")
    _run(session_stream(_closed(spark, n, str(tmp_path / "in")), "6 hours"), "sess")
    got = _rows(spark.table("sess").filter("source_ip <> '9.9.9.9'"), "source_ip", "session_start", "last_event", "n")
    assert got == _rows(all_queries()["sessions"](spark, sf), "source_ip", "session_start", "last_event", "n")


def test_suppress_repeats_keeps_first(spark, tmp_path):
    rows = [("a", "x", "2024-01-01 00:00:00"), ("a", "x", "2024-01-01 00:00:30"), ("b", "x", "2024-01-01 00:00:31")]
    df = spark.createDataFrame(rows, "source_ip string, threat_type string, timestamp string")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    path = str(tmp_path / "in")
    for i in range(3):
        df.filter(F.col("timestamp") == F.lit(rows[i][2]).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _run(suppress_repeats(stream), "kept")
    assert _rows(spark.table("kept"), "source_ip") == [("a",), ("b",)]


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "event_id long, source_ip string, destination_ip string, destination_port int, bytes_sent long, ts string"
    for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-01 00:00:01"]):
        df = spark.createDataFrame([(i, "a", "b", 1, 2, t)], schema)
        df = df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert late_rows(_run(tumbling_stream(stream, "1 minute", "1 minute"), "late")) == 1


def test_consume_routes_and_quarantines(spark, tmp_path):
    lines = [
        '{"event_type":"network","event_id":"n1","source_system":"zeek","source_ip":"10.0.0.1","destination_ip":"10.0.0.2","source_port":1,"destination_port":80,"protocol":"tcp"}',
        '{"event_type":"network","event_id":"n2","source_system":"zeek","source_ip":"invalid.ip","destination_ip":"10.0.0.2","source_port":99999,"destination_port":80,"protocol":"TCP"}',
        '{"event_type":"application","event_id":"a1","source_system":"nginx","application_name":"w","log_level":"INFO","message":"hi"}',
        '{"event_type":"other"}',
        "not json",
    ]
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(lines))
    seen = {}
    handlers = {k: (lambda df, i, k=k: seen.setdefault(k, [r["event_id"] for r in df.select("event_id").collect()])) for k in ("network", "application")}
    q = consume(read_json_lines(spark, str(folder), stream=True), handlers, str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen == {"network": ["n1"], "application": ["a1"]}
    reasons = sorted(r["reject"] for r in spark.read.parquet(str(tmp_path / "bad")).collect())
    assert reasons == ["failed: source_ip,source_port,protocol", "malformed json", "unknown event_type"]


def test_consume_stops_after_enough_messages(spark, tmp_path):
    good = '{{"event_type":"application","event_id":"a{}","source_system":"nginx","application_name":"w","log_level":"INFO","message":"hi"}}'
    folder = tmp_path / "raw"
    folder.mkdir()
    for f in range(4):
        (folder / f"{f}.txt").write_text("\n".join([good.format(10 * f + i) for i in range(3)] + ["not json"]))
    source = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(folder))
    seen = []
    handlers = {"application": lambda df, i: seen.extend(r["event_id"] for r in df.select("event_id").collect())}
    where = (handlers, str(tmp_path / "bad"), str(tmp_path / "ck"))
    first = consume(source, *where, max_messages=5)
    assert first.wait() == 6 and first.rejected == 2 and len(seen) == 6
    # The next run goes on behind it; without a bound it takes the rest.
    rest = consume(source, *where)
    assert rest.wait() == 6 and len(seen) == len({*seen}) == 12
    assert spark.read.parquet(where[1]).count() == 4
    assert consume(source, *where, max_messages=1).wait() == 0


def test_alert_table_by_day(spark, tmp_path):
    rows = [(f"a{i}", f"2024-01-0{1 + i % 2} 23:59:59", i) for i in range(6)]
    df = spark.createDataFrame(rows, "alert_id string, ts string, n int").withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")
    path, archive = str(tmp_path / "alerts"), str(tmp_path / "archive")
    for _ in range(2):
        write_alert_batch(df.where("n < 4"), path, 0)
        write_alert_batch(df.where("n >= 3"), path, 1)
    assert sorted(d.name for d in (tmp_path / "alerts").iterdir() if d.is_dir()) == ["alert_date=2024-01-01", "alert_date=2024-01-02"]
    assert spark.read.parquet(path).count() == 7
    for _ in range(2):
        compact_alerts(spark, path, archive, "2024-01-02")
    kept = spark.read.parquet(archive)
    assert sorted(r.alert_id for r in kept.collect()) == ["a1", "a3", "a5"] and "batch_id" not in kept.columns
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        zoned = df.withColumn("timestamp", F.timestamp_micros(F.lit(1_704_067_199_000_000)))
        assert str(zoned.select(utc_day(zoned).alias("d")).first().d) == "2023-12-31"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_score_stream_restarts_without_repeats(spark, sf, tmp_path):
    n = network(spark, sf).drop("user_id", "kind", "value", "stage")
    stream = _stream(spark, n, str(tmp_path / "in"), 2)
    for _ in range(2):
        score_stream(stream, str(tmp_path / "alerts"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "alerts"))
    assert out.count() == n.count() == out.select("alert_id").distinct().count()
    assert _rows(out.select("severity").distinct(), "severity") == [("low",)]


def test_alert_source_shape(spark, sf):
    assert alerts(spark, sf).filter("severity is null").count() == 0
