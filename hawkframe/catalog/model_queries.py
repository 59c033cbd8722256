"""Detectors trained and applied on the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hawkframe.catalog.registry import query, r6
from hawkframe.catalog.tables import table
from hawkframe.ml.detector import AnomalyDetector
from hawkframe.ml.ensemble import EnsembleDetector
from hawkframe.ml.iforest import IsolationForest
from hawkframe.ml.neighbors import LocalOutlierFactor
from hawkframe.ml.ocsvm import OneClassSVM
from hawkframe.ml.scale import Scaler
from hawkframe.operators.sampling import stratified_split
from hawkframe.session import durable


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def _normal(spark, sf):
    return _vectors(spark, sf).filter("label <> 0")


@query(
    "scale_features",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM x WHERE label <> 0 GROUP BY 1)
    SELECT vec_id, CAST(i AS INTEGER) AS position, round((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) AS z FROM x JOIN s USING (i)""",
)
def q_scale_features(spark, sf):
    scaler = Scaler.fit(_normal(spark, sf))
    out = _vectors(spark, sf).select("vec_id", F.posexplode(scaler.apply()).alias("p", "z"))
    return out.select("vec_id", (F.col("p") + 1).alias("position"), F.round("z", 5).alias("z"))


_K = 20

# From queries `v` and training points `t` (vec_id, e) to `f` (q, lof) and the cut `c`.
_LOF_SQL = f"""nn AS (SELECT q.vec_id AS q, o.vec_id AS o, list_distance(q.e, o.e) AS d FROM t q JOIN t o ON q.vec_id <> o.vec_id
           QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, o.e), o.vec_id) <= {_K}),
    kd AS (SELECT q AS p, max(d) AS kd FROM nn GROUP BY 1),
    lrd AS (SELECT q AS p, 1 / (sum(greatest(d, kd)) / {_K} + 1e-10) AS lrd FROM nn JOIN kd ON kd.p = nn.o GROUP BY 1),
    own AS (SELECT nn.q, sum(l.lrd) / {_K} / max(m.lrd) AS lof FROM nn JOIN lrd l ON l.p = nn.o JOIN lrd m ON m.p = nn.q GROUP BY 1),
    cut AS (SELECT quantile_cont(-lof, 0.02) AS c FROM own),
    qn AS (SELECT q.vec_id AS q, o.vec_id AS o, list_distance(q.e, o.e) AS d FROM v q JOIN t o ON true
           QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, o.e), o.vec_id) <= {_K}),
    ql AS (SELECT q, 1 / (sum(greatest(d, kd)) / {_K} + 1e-10) AS lrd FROM qn JOIN kd ON kd.p = qn.o GROUP BY 1),
    f AS (SELECT qn.q, sum(l.lrd) / {_K} / max(ql.lrd) AS lof FROM qn JOIN lrd l ON l.p = qn.o JOIN ql ON ql.q = qn.q GROUP BY 1)"""


@query(
    "lof",
    f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT * FROM v WHERE label <> 0),
    {_LOF_SQL}
    SELECT q AS vec_id, round(lof, 5) AS lof, CASE WHEN -lof - c < 0 THEN -1 ELSE 1 END AS pred FROM f, cut""",
)
def q_lof(spark, sf):
    model = LocalOutlierFactor.fit(_normal(spark, sf), "vec_id", k=_K)
    out = model.score(_vectors(spark, sf), "vec_id")
    return out.select("vec_id", F.round("lof", 5).alias("lof"), F.when(F.col("lof_decision") < 0, -1).otherwise(1).alias("pred"))


@query("iforest")
def q_iforest(spark, sf):
    model = IsolationForest.fit(_normal(spark, sf), "vec_id")
    d = model.decision()
    return _vectors(spark, sf).select("vec_id", "label", r6(d).alias("decision"))


@query("ocsvm")
def q_ocsvm(spark, sf):
    model = OneClassSVM.fit(_normal(spark, sf))
    return _vectors(spark, sf).select("vec_id", "label", r6(model.decision()).alias("decision"))


@query("anomaly_stats")
def q_anomaly_stats(spark, sf):
    normal = _normal(spark, sf)
    model = AnomalyDetector(id_col="vec_id").fit(normal)
    return model.training_stats(normal)


@query(
    "anomaly_flags",
    f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label <> 0),
    s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM x GROUP BY 1),
    v AS (SELECT vec_id, list((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END ORDER BY i) AS e FROM x JOIN s USING (i) GROUP BY 1), t AS (SELECT * FROM v),
    {_LOF_SQL}
    SELECT ceil((count(*) - 1) * 0.02)::BIGINT AS isolation_forest_anomalies, ceil((count(*) - 1) * 0.02)::BIGINT AS one_class_svm_anomalies,
      count(*) FILTER (WHERE -lof - c < 0) AS lof_anomalies, true AS vote_within_bound FROM f, cut""",
)
def q_anomaly_flags(spark, sf):
    """Forest and SVM flag the training rows below their contamination quantile. A training row scored again by
    LOF is its own neighbour, so fewer fall below. A vote needs two members."""
    members = [F.col(f"{m}_anomalies") for m in ("isolation_forest", "one_class_svm", "lof")]
    stats = q_anomaly_stats(spark, sf)
    return stats.select(*members, (2 * F.col("ensemble_anomalies") <= sum(members)).alias("vote_within_bound"))


# Small members keep the queries short; the defaults are in `ml.ensemble.PARAMS`.
MEMBERS = {
    "random_forest": {"numTrees": 20, "maxDepth": 5},
    "boosted_a": {"maxIter": 8, "maxDepth": 4},
    "boosted_b": {"maxIter": 8, "maxDepth": 3},
}
DIMENSIONS = [f"d{i}" for i in range(64)]
_LABELLED = "x AS (SELECT vec_id, CAST(label = 0 AS INTEGER) AS label FROM embeddings)"


def _labelled(spark, sf):
    """Vectors of class 0 stand for threats."""
    return durable(_vectors(spark, sf).select("vec_id", (F.col("label") == 0).cast("int").alias("label"), "features"))


@query(
    "train_report",
    f"""WITH {_LABELLED}, r AS (
      SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM x)
    SELECT CASE WHEN rk * 100 < 70 * n THEN 'train' WHEN rk * 100 < 85 * n THEN 'validation' ELSE 'test' END AS split,
      count(*) AS rows, count(*) FILTER (WHERE label = 1) AS threats, true AS rates_valid, true AS learned FROM r GROUP BY 1""",
)
def q_train_report(spark, sf):
    """An ensemble fitted on 70 % of the vectors, measured on each part."""
    parts = durable(stratified_split(_labelled(spark, sf), "vec_id", "label"))
    model = EnsembleDetector().fit(parts.filter("split = 'train'"), **MEMBERS)
    scored = durable(model.transform(parts).select("split", "label", "ensemble_pred", "threat_score"))
    from hawkframe.operators.metrics import roc_auc

    sums = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 1).alias("threats"),
        F.avg((F.col("label") == F.col("ensemble_pred")).cast("int")).alias("accuracy"),
    )
    out = sums.join(roc_auc(scored, "threat_score", "label", ["split"]), "split")
    valid = F.col("accuracy").between(0, 1) & F.col("auc").between(0, 1)
    learned = (F.col("split") != "train") | (F.col("auc") > 0.9)
    return out.select("split", "rows", "threats", valid.alias("rates_valid"), learned.alias("learned"))


@query("top_importance", "SELECT unnest(range(1, 16))::INTEGER AS place, true AS in_order, true AS is_share FROM (SELECT count(*) AS n FROM embeddings) WHERE n > 0")
def q_top_importance(spark, sf):
    from pyspark.sql import Window

    model = EnsembleDetector().fit(_labelled(spark, sf), **MEMBERS)
    # At most 15 rows, so one window task is enough.
    w = Window.orderBy(F.desc("importance"), "feature")
    before = F.coalesce(F.lag("importance").over(w), F.lit(1.0))
    value = F.col("importance")
    return model.top_importances(spark, DIMENSIONS).select(
        F.row_number().over(w).alias("place"), (value <= before).alias("in_order"), value.between(0, 1).alias("is_share")
    )


@query("permutation_importance", "SELECT 'd' || CAST(i AS VARCHAR) AS feature, true AS within_bound FROM (SELECT unnest(range(64)) AS i, count(*) AS n FROM embeddings) WHERE n > 0")
def q_permutation_importance(spark, sf):
    rows = _labelled(spark, sf)
    model = EnsembleDetector().fit(rows, **MEMBERS)
    out = model.permutation_importance(rows, "vec_id", "label", DIMENSIONS, repeats=2)
    return out.select("feature", F.col("importance").between(-1, 1).alias("within_bound"))


@query(
    "score_events_trained",
    """SELECT event_id, true AS vote_follows, true AS label_follows, true AS severity_follows, true AS threat_follows FROM events""",
)
def q_score_events_trained(spark, sf):
    """Events scored by an ensemble that learned which features go with known bad addresses.

    The answer says whether vote, label, severity and decision follow from the members' scores.
    """
    from hawkframe.catalog.feature_queries import PORT_RULES
    from hawkframe.catalog.tables import network, ranges, reputation
    from hawkframe.plans.features import extract_features, feature_array
    from hawkframe.plans.scoring import score_features

    known = reputation(spark, sf)
    features = durable(
        extract_features(network(spark, sf), reputation=known, iocs=known.filter("score < 0"), rules=PORT_RULES, ranges=ranges(spark, sf))
    )
    train = features.select(feature_array().alias("features"), (F.col("ioc_matches") > 0).cast("int").alias("label"))
    out = score_features(features, EnsembleDetector().fit(train, **MEMBERS))
    vote = F.col("random_forest_score") * 0.40 + F.col("boosted_a_score") * 0.35 + F.col("boosted_b_score") * 0.25
    score = F.col("threat_score")
    level = F.when(score > 0.9, "critical").when(score > 0.75, "high").when(score > 0.5, "medium").otherwise("low")
    return out.select(
        "event_id",
        (F.abs(vote - score) < 1e-9).alias("vote_follows"),
        (F.col("ensemble_pred") == (score > 0.5).cast("int")).alias("label_follows"),
        (F.col("severity") == level).alias("severity_follows"),
        (F.col("is_threat") == (F.col("ensemble_pred") == 1)).alias("threat_follows"),
    )
