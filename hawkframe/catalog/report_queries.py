"""Volume, latency, drift, data quality and model quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkframe.catalog.registry import query, r6
from hawkframe.catalog.tables import ALERT_SQL, NET_SQL, SCORED_SQL, alerts, network, scored, table
from hawkframe.operators import metrics, monitor, tumbling
from hawkframe.schemas import Settings

HOUR, DAY = 3600, 86400


@query("event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_event_counts(spark, sf):
    return monitor.count_by(table(spark, sf, "events"), "event_type")


# Latencies: line prices scaled to 0..~1.2 seconds.
_LAT = "lat AS (SELECT l_returnflag AS endpoint, l_extendedprice / 90000 AS s FROM lineitem)"


def _latencies(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("endpoint"), (F.col("l_extendedprice") / 90000).alias("s")
    )


_BUCKETS = "(VALUES (0.01::DOUBLE), (0.05), (0.1), (0.5), (1.0), ('Infinity'::DOUBLE)) b(le)"
_HIST = f"""hist AS (SELECT endpoint, le, count(*) FILTER (WHERE s <= le) AS cumulative, sum(s) AS total, count(*) AS n FROM lat, {_BUCKETS} GROUP BY 1, 2)"""


@query(
    "latency_hist",
    f"WITH {_LAT}, {_HIST} SELECT endpoint, le, cumulative, round(total, 4) AS sum, n AS count FROM hist",
)
def q_latency_hist(spark, sf):
    out = monitor.latency_histogram(_latencies(spark, sf), "s", ["endpoint"])
    return out.withColumn("sum", F.round("sum", 4))


@query(
    "hist_quantile",
    f"""WITH {_LAT}, {_HIST}, w AS (SELECT *, lag(le, 1, 0) OVER (PARTITION BY endpoint ORDER BY le) AS low,
      lag(cumulative, 1, 0) OVER (PARTITION BY endpoint ORDER BY le) AS below, n * 0.95 AS rnk FROM hist)
    SELECT endpoint, round(CASE WHEN le = 'Infinity'::DOUBLE THEN low ELSE low + (le - low) * (rnk - below) / (cumulative - below) END, 6) AS p95
    FROM w WHERE below < rnk AND rnk <= cumulative""",
)
def q_hist_quantile(spark, sf):
    hist = monitor.latency_histogram(_latencies(spark, sf), "s", ["endpoint"])
    return monitor.histogram_quantile(hist, 0.95, ["endpoint"], "p95").withColumn("p95", r6("p95"))


def _excl(p: float) -> str:
    """Exclusive quantile by ranks."""
    pos = f"{p} * (n + 1)"
    lo = f"greatest(1, least(floor({pos}), n - 1))"
    return (
        f"round(max(CASE WHEN rk = {lo} THEN s END) + (max({pos}) - max({lo})) * "
        f"(max(CASE WHEN rk = {lo} + 1 THEN s END) - max(CASE WHEN rk = {lo} THEN s END)), 6)"
    )


@query(
    "latency_summary",
    f"""WITH {_LAT}, r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY s) AS rk, count(*) OVER (PARTITION BY endpoint) AS n FROM lat)
    SELECT endpoint, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, {_excl(0.5)} AS p50, {_excl(0.95)} AS p95, {_excl(0.99)} AS p99,
      round(min(s), 6) AS min, round(max(s), 6) AS max, round(coalesce(stddev_samp(s), 0), 6) AS stdev FROM r GROUP BY 1""",
)
def q_latency_summary(spark, sf):
    out = monitor.latency_summary(_latencies(spark, sf), "s", ["endpoint"])
    return out.select("endpoint", "n", *[r6(c) for c in ("mean", "median", "p50", "p95", "p99", "min", "max", "stdev")])


@query(
    "throughput",
    """SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value < 200) AS successful, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed_s,
      round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second, round(100.0 * count(*) FILTER (WHERE value < 200) / count(*), 6) AS success_rate FROM events GROUP BY 1""",
)
def q_throughput(spark, sf):
    from hawkframe.operators.sliced import micros

    e = table(spark, sf, "events")
    t = micros(e, "ts")
    out = monitor.throughput(e, F.col("value") < 200, (F.max(t) - F.min(t)) / 1e6, ["event_type"])
    return out.select("event_type", "total", "successful", r6("elapsed_s"), F.round("per_second", 9).alias("per_second"), r6("success_rate"))


@query(
    "mttr_daily",
    """WITH a AS (SELECT o_orderdate AS created, l_shipdate AS closed, o_orderpriority AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate)
    SELECT CAST(created AS DATE) AS date, round(avg(epoch(closed) - epoch(created)) / 60, 4) AS mttr_minutes, count(*) AS n FROM a
    WHERE p IN ('1-URGENT', '2-HIGH') AND created >= (SELECT max(created) FROM a) - INTERVAL 365 DAYS GROUP BY 1 HAVING avg(epoch(closed) - epoch(created)) / 60 < 2000000""",
)
def q_mttr_daily(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("created"), "o_orderpriority")
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("closed"))
    a = o.join(l, o.o_orderkey == l.l_orderkey).filter("closed >= created")
    out = monitor.mttr_daily(a, "created", "closed", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 365, 2_000_000)
    return out.withColumn("mttr_minutes", F.round("mttr_minutes", 4))


@query(
    "null_rates",
    f"""WITH {NET_SQL}, r AS (SELECT count(*) AS n, count(dns_query) AS a, count(http_user_agent) AS b, count(source_ip) AS c FROM net)
    SELECT 'dns_query' AS column_name, round(1 - a / n, 6) AS null_rate, a / n >= 0.95 AS complete FROM r
    UNION ALL SELECT 'http_user_agent', round(1 - b / n, 6), b / n >= 0.95 FROM r UNION ALL SELECT 'source_ip', round(1 - c / n, 6), c / n >= 0.95 FROM r""",
)
def q_null_rates(spark, sf):
    out = monitor.null_rates(network(spark, sf).select("dns_query", "http_user_agent", "source_ip"))
    return out.withColumn("null_rate", r6("null_rate"))


@query(
    "kl_drift",
    """WITH x AS (SELECT value AS x, ts >= TIMESTAMP '2024-01-20' AS cur FROM events), b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM x),
    h AS (SELECT least(floor((x - lo) / w), 19) AS bin, count(*) FILTER (WHERE cur) AS c, count(*) FILTER (WHERE NOT cur) AS q FROM x, b GROUP BY 1),
    p AS (SELECT c / sum(c) OVER () AS p, q / sum(q) OVER () AS q FROM h)
    SELECT round(sum(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN 'Infinity'::DOUBLE ELSE p * ln(p / q) END), 6) AS kl,
      sum(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN 'Infinity'::DOUBLE ELSE p * ln(p / q) END) > 0.1 AS drift FROM p""",
)
def q_kl_drift(spark, sf):
    e = table(spark, sf, "events").select("ts", "value")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    out = monitor.kl_drift(e.filter(F.col("ts") >= cut), e.filter(F.col("ts") < cut), "value")
    return out.withColumn("kl", r6("kl"))


def _bucket(seconds: int, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL {seconds} SECONDS, {ts})"


@query(
    "rate_by_severity",
    f"WITH {ALERT_SQL} SELECT severity, {_bucket(300)} AS window_start, count(*) AS n, round(count(*) / 300, 6) AS rate FROM graded GROUP BY 1, 2",
)
def q_rate_by_severity(spark, sf):
    return tumbling.rate_per_window(alerts(spark, sf), "severity", 300).withColumn("rate", r6("rate"))


@query(
    "error_ratio",
    f"""SELECT {_bucket(HOUR)} AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS hits,
      round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio, round(1 - count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS availability FROM events GROUP BY 1""",
)
def q_error_ratio(spark, sf):
    e = table(spark, sf, "events")
    out = tumbling.ratio_per_window(e, F.col("event_type") == "error", HOUR, "ts")
    return out.withColumns({"ratio": r6("ratio"), "availability": r6("availability")})


def _counts(spark, sf, seconds: int):
    return (
        table(spark, sf, "events")
        .groupBy(F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "n")
    )


def _counts_sql(seconds: int) -> str:
    return f"counts AS (SELECT {_bucket(seconds)} AS window_start, count(*) AS n FROM events GROUP BY 1)"


@query(
    "volume_spike",
    f"""WITH {_counts_sql(300)}, grid AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL 300 SECONDS)) AS window_start FROM counts),
    filled AS (SELECT window_start, coalesce(n, 0)::BIGINT AS n FROM grid LEFT JOIN counts USING (window_start))
    SELECT a.window_start, a.n, b.n AS n_before, CASE WHEN b.n = 0 THEN 'Infinity'::DOUBLE ELSE round(a.n / b.n, 6) END AS ratio
    FROM filled a JOIN filled b ON a.window_start = b.window_start + INTERVAL 1 HOUR WHERE a.n > 2 * b.n""",
)
def q_volume_spike(spark, sf):
    return monitor.volume_spikes(_counts(spark, sf, 300)).withColumn("ratio", r6("ratio"))


_RATES = f"rates AS (SELECT event_type, {_bucket(900)} AS window_start, count(*) AS n, count(*) / 900 AS rate FROM events GROUP BY 1, 2)"


@query(
    "unusual_pattern",
    f"""WITH {_RATES}, grid AS (SELECT event_type, unnest(generate_series(min(window_start), max(window_start), INTERVAL 900 SECONDS)) AS window_start FROM rates GROUP BY 1),
    filled AS (SELECT event_type, window_start, coalesce(n, 0)::BIGINT AS n, coalesce(rate, 0) AS rate FROM grid LEFT JOIN rates USING (event_type, window_start)),
    w AS (SELECT *, avg(rate) OVER (PARTITION BY event_type ORDER BY window_start RANGE BETWEEN INTERVAL 14399 SECONDS PRECEDING AND CURRENT ROW) AS trailing_avg FROM filled)
    SELECT event_type, window_start, n, round(rate, 6) AS rate, round(trailing_avg, 6) AS trailing_avg FROM w WHERE rate > 1.5 * trailing_avg""",
)
def q_unusual_pattern(spark, sf):
    rates = tumbling.rate_per_window(table(spark, sf, "events"), "event_type", 900, "ts")
    out = monitor.unusual_rates(rates, ["event_type"], 1.5, 4 * HOUR, 900)
    return out.withColumns({"rate": r6("rate"), "trailing_avg": r6("trailing_avg")})


_RATIOS = f"ratios AS (SELECT {_bucket(HOUR)} AS window_start, count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1)"


def _ratios(spark, sf):
    e = table(spark, sf, "events")
    return tumbling.ratio_per_window(e, F.col("event_type") == "error", HOUR, "ts").select("window_start", "ratio")


@query(
    "metric_offset",
    f"""WITH {_RATIOS} SELECT a.window_start, round(a.ratio, 6) AS ratio, round(b.ratio, 6) AS before, round(abs(a.ratio - b.ratio), 6) AS change
    FROM ratios a JOIN ratios b ON a.window_start = b.window_start + INTERVAL 24 HOURS WHERE abs(a.ratio - b.ratio) > 0.05""",
)
def q_metric_offset(spark, sf):
    out = monitor.metric_drift(_ratios(spark, sf), "ratio", DAY, 0.05)
    return out.withColumns({c: r6(c) for c in ("ratio", "before", "change")})


@query(
    "avg_over_time",
    f"""WITH {_RATIOS}, w AS (SELECT window_start, avg(1 - ratio) OVER (ORDER BY window_start RANGE BETWEEN INTERVAL 86399 SECONDS PRECEDING AND CURRENT ROW) AS sla FROM ratios)
    SELECT window_start, round(sla, 6) AS sla FROM w WHERE sla < 0.95""",
)
def q_avg_over_time(spark, sf):
    r = _ratios(spark, sf).withColumn("availability", 1 - F.col("ratio"))
    out = monitor.trailing_average(r, "availability", DAY, (), "sla").filter("sla < 0.95")
    return out.select("window_start", r6("sla"))


@query(
    "low_volume",
    f"""WITH {_counts_sql(300)}, grid AS (SELECT unnest(generate_series((SELECT min(window_start) FROM counts), (SELECT max(window_start) FROM counts), INTERVAL 300 SECONDS)) AS window_start)
    SELECT grid.window_start, coalesce(n, 0) AS n, round(coalesce(n, 0) / 300, 6) AS rate FROM grid LEFT JOIN counts USING (window_start) WHERE coalesce(n, 0) / 300 < 0.005""",
)
def q_low_volume(spark, sf):
    return monitor.low_volume(_counts(spark, sf, 300), 300, 0.005).withColumn("rate", r6("rate"))


@query(
    "sustained_for",
    f"""WITH {_counts_sql(HOUR)}, grid AS (SELECT unnest(generate_series((SELECT min(window_start) FROM counts), (SELECT max(window_start) FROM counts), INTERVAL 1 HOUR)) AS window_start),
    g AS (SELECT grid.window_start, coalesce(n, 0) AS n, coalesce(n, 0) < (SELECT avg(n) + 2 FROM counts) AS ok FROM grid LEFT JOIN counts USING (window_start)),
    i AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (ORDER BY window_start) AS island FROM g),
    s AS (SELECT *, epoch(window_start) - min(epoch(window_start)) FILTER (WHERE ok) OVER (PARTITION BY island) AS active_s FROM i)
    SELECT window_start, n, CAST(active_s AS BIGINT) AS active_s FROM s WHERE ok AND active_s >= 7200""",
)
def q_sustained_for(spark, sf):
    counts = _counts(spark, sf, HOUR)
    limit = counts.agg(F.avg("n") + 2).scalar()
    grid = monitor.fill_grid(counts, HOUR).withColumn("_limit", limit)
    return monitor.sustained(grid, F.col("n") < F.col("_limit"), 7200).drop("_limit")


# Model quality


@query(
    "confusion_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT quality, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
      count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM scored GROUP BY 1)
    SELECT quality, tp, fp, tn, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
      round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
      round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS tpr FROM c""",
)
def q_confusion_metrics(spark, sf):
    out = metrics.confusion_metrics(scored(spark, sf), "label", "pred", ["quality"])
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "tpr")})


def _auc_sql(score: str, extra: str = "") -> str:
    return f"""(SELECT (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
      / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))
      FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2 AS rk FROM scored))"""


@query(
    "roc_auc",
    f"WITH {SCORED_SQL} SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, round({_auc_sql('score')}, 6) AS auc FROM scored",
)
def q_roc_auc(spark, sf):
    return metrics.roc_auc(scored(spark, sf), "score", "label").withColumn("auc", r6("auc"))


@query(
    "roc_curve",
    f"""WITH {SCORED_SQL}, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM scored GROUP BY 1)
    SELECT CAST(score AS DOUBLE) AS threshold, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr FROM g
    UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""",
)
def q_roc_curve(spark, sf):
    out = metrics.roc_curve(scored(spark, sf), "score", "label")
    return out.select("threshold", r6("fpr"), r6("tpr"))


@query(
    "class_report",
    f"""WITH {SCORED_SQL}, c AS (SELECT cls, count(*) FILTER (WHERE label = cls) AS support, count(*) FILTER (WHERE pred = cls) AS predicted,
      count(*) FILTER (WHERE label = cls AND pred = cls) AS hit FROM scored, (VALUES (0), (1)) v(cls) GROUP BY 1)
    SELECT cls AS class, round(hit / predicted, 6) AS precision, round(hit / support, 6) AS recall, round(2 * hit / (predicted + support), 6) AS f1, support FROM c""",
)
def q_class_report(spark, sf):
    out = metrics.class_report(scored(spark, sf), "label", "pred")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("class_dist", "SELECT toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1")
def q_class_dist(spark, sf):
    return metrics.class_distribution(table(spark, sf, "labels"), "toxic").withColumn("share", r6("share"))


@query(
    "class_weights",
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS pos FROM labels)
    SELECT toxic, count(*) AS n_class, round(max(t.n) / (2 * count(*)), 6) AS balanced, CASE WHEN toxic = 1 THEN 10.0::DOUBLE ELSE 1.0 END AS fixed,
      round(CASE WHEN toxic = 1 THEN (max(t.n) - max(t.pos)) / max(t.pos) ELSE 1.0 END, 6) AS ratio FROM labels, t GROUP BY 1""",
)
def q_class_weights(spark, sf):
    out = metrics.class_weights(table(spark, sf, "labels"), "toxic")
    return out.withColumns({"balanced": r6("balanced"), "ratio": r6("ratio")})


@query(
    "model_compare",
    f"""WITH {SCORED_SQL}, m AS (SELECT round({_auc_sql('score_b')}, 6) AS ca, round({_auc_sql('score')}, 6) AS ba,
      round(avg(CAST(CAST(score_b > 0.5 AS INTEGER) = label AS INTEGER)), 6) AS cc, round(avg(CAST(CAST(score > 0.5 AS INTEGER) = label AS INTEGER)), 6) AS bc FROM scored)
    SELECT ca AS candidate_auc, ba AS baseline_auc, cc AS candidate_accuracy, bc AS baseline_accuracy, ca > ba AS promote, bc - cc > 0.05 AS roll_back FROM m""",
)
def q_model_compare(spark, sf):
    s = scored(spark, sf)
    both = s.select(F.lit("a").alias("model_version"), "score", "label").unionByName(
        s.select(F.lit("b").alias("model_version"), F.col("score_b").alias("score"), "label")
    )
    out = metrics.compare_models(both, "b", "a")
    return out.withColumns(
        {c: r6(c) for c in ("candidate_auc", "baseline_auc", "candidate_accuracy", "baseline_accuracy")}
    )


# Votes over given scores


@query(
    "soft_vote",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS a, l_tax * 12 AS b, l_quantity / 50 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(a * 0.4 + b * 0.35 + c * 0.25, 6) AS threat_score, round(greatest(a, b, c), 6) AS confidence,
      CASE WHEN round(a * 0.4 + b * 0.35 + c * 0.25, 6) > 0.5 THEN 1 ELSE 0 END AS label FROM p""",
)
def q_soft_vote(spark, sf):
    from hawkframe.functions.decisions import soft_vote

    s = Settings()
    li = table(spark, sf, "lineitem")
    a, b, c = F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50
    vote = r6(soft_vote([a, b, c], [s.random_forest_weight, s.boosted_a_weight, s.boosted_b_weight]))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        vote.alias("threat_score"),
        r6(F.greatest(a, b, c)).alias("confidence"),
        F.when(vote > s.decision_threshold, 1).otherwise(0).alias("label"),
    )


_DECISIONS = "d AS (SELECT event_id, value / 100 - 1 AS a, (event_id % 7) - 3 AS b, (user_id % 5) - 1.5 AS c FROM events)"


def _decisions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        (F.col("value") / 100 - 1).alias("a"),
        (F.pmod("event_id", F.lit(7)) - 3).cast("double").alias("b"),
        (F.pmod("user_id", F.lit(5)) - 1.5).cast("double").alias("c"),
    )


@query(
    "majority_vote",
    f"WITH {_DECISIONS} SELECT event_id, CASE WHEN CAST(a < 0 AS INTEGER) + CAST(b < 0 AS INTEGER) + CAST(c < 0 AS INTEGER) >= 2 THEN -1 ELSE 1 END AS anomaly_pred FROM d",
)
def q_majority_vote(spark, sf):
    from hawkframe.functions.decisions import majority_vote

    flag = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    return _decisions(spark, sf).select("event_id", majority_vote([flag("a"), flag("b"), flag("c")]).alias("anomaly_pred"))


@query("anomaly_score", f"WITH {_DECISIONS} SELECT event_id, round(-(a + b + c) / 3, 6) AS anomaly_score FROM d")
def q_anomaly_score(spark, sf):
    from hawkframe.functions.decisions import anomaly_score

    return _decisions(spark, sf).select("event_id", r6(anomaly_score([F.col(x) for x in "abc"])).alias("anomaly_score"))
