"""Model quality from (score, label) tables, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.operators.sliced import null_safe_join, ordered_counts


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / F.nullif(den, F.lit(0))).otherwise(0.0)


def confusion_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of binary predictions; 0 where a denominator is 0."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    c = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(tp, tp + fn).alias("tpr"),
    )


def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str], desc: bool) -> DataFrame:
    weights = {
        "pos": F.when(F.col(label) == 1, 1).otherwise(0),
        "neg": F.when(F.col(label) == 1, 0).otherwise(1),
    }
    return ordered_counts(df.filter(F.col(score).isNotNull()), score, by, weights, desc)


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counted half.

    NULL when only one class is present.
    """
    big = "decimal(38,0)"
    ranked = _by_score(df, score, label, by, desc=False)
    twice = F.col("pos").cast("decimal(18,0)") * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(19,0)")
    wins = ranked.groupBy(*by).agg(
        F.sum(twice).cast(big).alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return wins.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(pairs > 0, F.col("_w").cast("double") / 2 / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score, highest first, plus the origin at +Infinity."""
    ranked = _by_score(df, score, label, (), desc=True)
    totals = df.filter(F.col(score).isNotNull()).agg(
        F.struct(
            F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
        ).alias("t")
    )
    points = ranked.withColumn("_t", totals.scalar()).select(
        F.col(score).cast("double").alias("threshold"),
        _ratio(F.col("neg_before") + F.col("neg"), F.col("_t.n")).alias("fpr"),
        _ratio(F.col("pos_before") + F.col("pos"), F.col("_t.p")).alias("tpr"),
    )
    origin = totals.select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, f1 and support per class."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = F.array(
        F.struct(
            F.col("l").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("p").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("hit"),
        ),
    )
    sums = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    )
    return sums.select(
        "class",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total)


def class_weights(df: DataFrame, label: str, fixed_positive: float = 10.0) -> DataFrame:
    """Weight per class: balanced n/(k*n_c), fixed, and negatives per positive."""
    totals = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct(label).alias("k"),
            F.count_if(F.col(label) == 1).alias("pos"),
        ).alias("t")
    )
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")).withColumn("_t", totals.scalar())
    positive = F.col(label) == 1
    return counts.select(
        label,
        "n_class",
        (F.col("_t.n") / (F.col("_t.k") * F.col("n_class"))).alias("balanced"),
        F.when(positive, fixed_positive).otherwise(1.0).alias("fixed"),
        F.when(positive, (F.col("_t.n") - F.col("_t.pos")) / F.col("_t.pos")).otherwise(1.0).alias("ratio"),
    )


def compare_models(
    scored: DataFrame,
    candidate: str,
    baseline: str,
    version: str = "model_version",
    score: str = "score",
    label: str = "label",
    threshold: float = 0.5,
    max_accuracy_drop: float = 0.05,
) -> DataFrame:
    """AUC and accuracy of two versions with the promote / roll back decision."""
    auc = roc_auc(scored, score, label, [version])
    preds = scored.withColumn("_pred", (F.col(score) > threshold).cast("int"))
    acc = confusion_metrics(preds, label, "_pred", [version]).select(version, "accuracy")
    both = null_safe_join(auc, acc, [version])
    pick = lambda v, c: F.max(F.when(F.col(version) == v, F.col(c)))
    row = both.agg(
        pick(candidate, "auc").alias("candidate_auc"),
        pick(baseline, "auc").alias("baseline_auc"),
        pick(candidate, "accuracy").alias("candidate_accuracy"),
        pick(baseline, "accuracy").alias("baseline_accuracy"),
    )
    return row.select(
        "*",
        (F.col("candidate_auc") > F.col("baseline_auc")).alias("promote"),
        (F.col("baseline_accuracy") - F.col("candidate_accuracy") > max_accuracy_drop).alias("roll_back"),
    )
