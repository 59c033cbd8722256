"""Scalars, decisions, rules, reports and metrics on hand-checked vectors."""

import math

import pytest
from pyspark.sql import functions as F

from hawkframe.functions import decisions, text
from hawkframe.operators import alerts as alert_ops
from hawkframe.operators import metrics, monitor, sampling
from hawkframe.operators.rules import Rule, matched_rules, technique_count
from hawkframe.operators.sliced import exact_quantiles, lookup_join
from hawkframe.sources.parse import failed_rules


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, bits",
    [("", 0.0), (None, 0.0), ("a" * 16, 0.0), ("abcdefghijklmnop", 4.0), ("google.com", 2.6464393446710153), ("\U0001f600\U0001f600ab", 1.5)],
)
def test_entropy(spark, value, bits):
    assert one(spark, text.entropy(F.lit(value).cast("string"))) == pytest.approx(bits, abs=1e-12)
    df = spark.createDataFrame([(1, value)], "id int, t string")
    assert text.entropy_table(df, "id", "t").first()["entropy"] == pytest.approx(bits, abs=1e-12)


@pytest.mark.parametrize("ip, ok", [("1.2.3.4", True), ("256.1.1.1", False), ("1.2.3", False), ("a.b.c.d", False), ("1..2.3", False), (None, False), ("001.2.3.4", True), ("1.2.3.99999999999999999999", False)])
def test_ipv4(spark, ip, ok):
    assert one(spark, text.is_valid_ipv4(F.lit(ip).cast("string"))) is ok


def test_small_scalars(spark):
    assert one(spark, text.sanitize_ip(F.lit(" 1.2.3.4 "))) == "1.2.3.4"
    assert one(spark, text.sanitize_ip(F.lit("x"))) is None
    assert one(spark, text.truncate(F.lit("abcdefgh"), 5)) == "ab..."
    assert one(spark, text.truncate(F.lit("abcdefgh"), 2)) == "..."
    assert one(spark, text.truncate(F.lit("abc"), 5)) == "abc"
    assert one(spark, text.safe_divide(F.lit(1), F.lit(0), 7.0)) == 7.0
    assert one(spark, text.percentage(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, text.percentage(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, text.ipv4_to_long(F.lit("10.0.1.2"))) == 10 * 2**24 + 258


@pytest.mark.parametrize(
    "score, anomaly, level",
    [(0.9, 0, "high"), (0.901, 0, "critical"), (0.75, 0, "medium"), (0.5, 0, "low"), (0, 3.0, "high"), (0, 3.01, "critical"), (0, 1.0, "low")],
)
def test_severity_edges(spark, score, anomaly, level):
    assert one(spark, decisions.severity(F.lit(score), F.lit(anomaly))) == level


def test_off_hours_edges(spark):
    stamp = lambda s: F.lit(f"2024-01-01 {s}:00").cast("timestamp_ntz")
    got = [one(spark, decisions.off_hours(stamp(s))) for s in ("07:59", "08:00", "17:59", "18:00")]
    assert got == [True, False, False, True]


def test_votes(spark):
    flags = [(1, 1, 1), (-1, -1, -1), (-1, 1, -1), (1, -1, -1)]
    df = spark.createDataFrame(flags, "a int, b int, c int")
    assert [r[0] for r in df.select(decisions.majority_vote([F.col(c) for c in "abc"])).collect()] == [1, -1, -1, -1]
    assert one(spark, decisions.soft_vote([F.lit(0.8), F.lit(0.6), F.lit(0.4)], [0.4, 0.35, 0.25])) == pytest.approx(0.63)
    assert one(spark, decisions.anomaly_score([F.lit(1.0), F.lit(-3.0), F.lit(0.5)])) == pytest.approx(0.5)
    assert one(spark, decisions.priority(F.lit(0.9), F.lit(True), F.lit(1), F.lit(3))) == pytest.approx(96)


def test_auth_failure_near_misses(spark):
    texts = ["Authentication error: Invalid credentials", "Authentication FAILED for bob", "Database connection failed", None]
    got = [one(spark, decisions.auth_failure(F.lit(t).cast("string"))) for t in texts]
    assert got == [False, True, False, False]


def test_validation_of_bad_events(spark):
    schema = "event_id string, source_system string, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, http_status_code int"
    rows = [
        ("e1", "zeek", "1.1.1.1", "2.2.2.2", 1, 80, "tcp", None),
        ("e2", "zeek", "invalid.ip", "2.2.2.2", 99999, 80, "TCP", 99),
        ("", "zeek", None, None, None, 80, "tcp", 100),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(failed_rules("network", df.columns)).collect()]
    assert got == [[], ["source_ip", "source_port", "protocol", "http_status_code"], ["event_id", "source_ip", "destination_ip", "source_port"]]
    md5 = spark.createDataFrame([("e", "s", "h", "a" * 31)], "event_id string, source_system string, hostname string, file_hash_md5 string")
    assert md5.select(failed_rules("endpoint", md5.columns)).first()[0] == ["file_hash_md5"]
    bare = spark.createDataFrame([("e",)], "event_id string")
    assert set(bare.select(failed_rules("network", bare.columns)).first()[0]) == {"source_ip", "destination_ip"}


def test_rules(spark):
    rules = [
        Rule("r1", "high", ("T1", "T2"), {"image|endswith": "\\powershell.exe", "cmd|contains": ["IEX", "DownloadFile"]}),
        Rule("r2", "low", ("T2",), {"cmd|startswith": "run"}),
        Rule("r3", "low", ("T9",), condition=lambda: F.col("cmd").isNull()),
    ]
    df = spark.createDataFrame([("C:\\PowerShell.EXE", "run iex"), ("cmd.exe", "run IEX"), ("x\\powershell.exe", None)], "image string, cmd string")
    m = matched_rules(rules)
    got = df.select(F.transform(m, lambda x: x["rule"]), technique_count(m)).collect()
    assert [tuple(r) for r in got] == [(["r1", "r2"], 2), (["r2"], 1), (["r3"], 1)]


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == 0.75
    neg = df.withColumn("s", -F.col("s"))
    assert metrics.roc_auc(neg, "s", "y").first()["auc"] == 0.25
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert metrics.roc_auc(tied, "s", "y").first()["auc"] == 0.5
    assert metrics.roc_auc(tied.filter("y = 1"), "s", "y").first()["auc"] is None


def test_confusion_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = metrics.confusion_metrics(df, "y", "p").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["fpr"]) == (1.0, 0, 0, 0, 0)


def test_kl(spark):
    cur = spark.createDataFrame([(0.0,)] * 5 + [(1.0,)] * 5, "v double")
    base = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "v double")
    r = monitor.kl_drift(cur, base, "v", bins=2).first()
    assert r["kl"] == pytest.approx(0.510826, abs=1e-6) and r["drift"]
    empty = monitor.kl_drift(cur, base.filter("v = 0"), "v", bins=2).first()
    assert math.isinf(empty["kl"]) and empty["drift"]
    assert math.isfinite(monitor.kl_drift(cur, base.filter("v = 0"), "v", bins=2, smoothing=0.5).first()["kl"])


def test_quantiles(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    r = exact_quantiles(df, "v", {"m": 0.5, "lo": 0.0, "hi": 1.0}, exclusive={"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert (r["a"], r["b"], r["c"], r["m"], r["lo"], r["hi"]) == (1.25, 2.5, 3.75, 2.5, 1.0, 4.0)
    single = exact_quantiles(df.filter("v = 3"), "v", {"m": 0.9}, exclusive={"x": 0.99}).first()
    assert (single["m"], single["x"]) == (3.0, 3.0)
    weighted = spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, w int")
    assert exact_quantiles(weighted, "v", {"m": 0.75}, weight="w").first()["m"] == pytest.approx(2.0)


def test_histogram_quantile(spark):
    hist = spark.createDataFrame([(0.01, 10), (0.05, 60), (0.1, 95), (float("inf"), 100)], "le double, cumulative long")
    assert monitor.histogram_quantile(hist, 0.5).first()["value"] == pytest.approx(0.042)
    assert monitor.histogram_quantile(hist, 0.95).first()["value"] == pytest.approx(0.1)
    assert monitor.histogram_quantile(hist, 0.99).first()["value"] == pytest.approx(0.1)


def test_latency_summary_of_whole_table(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "s double")
    r = monitor.latency_summary(df, "s").first()
    assert (r["n"], r["mean"], r["median"], r["p50"]) == (100, 50.5, 50.5, 50.5)
    assert r["p95"] == pytest.approx(95.95) and r["p99"] == pytest.approx(99.99)
    assert monitor.latency_summary(df.filter("s = 1"), "s").first()["stdev"] == 0.0


def test_sustained(spark):
    rows = [(i, ok) for i, ok in enumerate([1, 1, 1, 0, 1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "i int, ok int").withColumn(
        "window_start", F.expr("timestampadd(MINUTE, i, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    )
    got = [r["i"] for r in monitor.sustained(df, F.col("ok") == 1, 120).orderBy("i").collect()]
    assert got == [2, 6, 7]


def test_split_shares_are_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    counts = {(r["y"], r["split"]): r["count"] for r in sampling.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 630, (0, "validation"): 135, (0, "test"): 135, (1, "train"): 70, (1, "validation"): 15, (1, "test"): 15}


def test_batches(spark):
    out = sampling.batch_ids(spark.range(100, 350).toDF("id"), "id", 100)
    assert [(r["batch_id"], r["count"]) for r in out.groupBy("batch_id").count().orderBy("batch_id").collect()] == [(0, 100), (1, 100), (2, 50)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_large_lookup_equals_broadcast(spark, how):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 70).alias("k"))
    table = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup_join(big, table, ["k"], how)
    rows = sorted(map(tuple, small.select(*sorted(small.columns)).collect()), key=str)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = lookup_join(big, table, ["k"], how)
        assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
        assert rows == sorted(map(tuple, large.select(*sorted(large.columns)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_case_text(spark):
    df = spark.createDataFrame(
        [("a1", "high", 0.91234, "scan", "", "2.2.2.2", "h1", "act", ["T1"], [("f", 3.0, 0.25)])],
        "alert_id string, severity string, threat_score double, threat_type string, source_ip string, destination_ip string, hostname string, "
        "recommended_action string, mitre_techniques array<string>, top_features array<struct<feature:string,value:double,contribution:double>>",
    )
    r = alert_ops.case_rows(df).first()
    assert r["title"] == "AI Detected: scan - h1" and r["severity_level"] == 2
    assert r["tags"] == ["ai_detection", "scan", "severity_high", "T1"]
    assert "**Threat Score**: 0.9123" in r["description"] and "- **f**: 3.0 (contribution: 0.25)" in r["description"]
    assert [o["data"] for o in alert_ops.case_observables(df).collect()] == ["2.2.2.2", "h1"]
    assert alert_ops.case_tasks(df).count() == 7
    assert alert_ops.case_gate(df, enabled=False).count() == 0
