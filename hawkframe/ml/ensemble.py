"""Supervised detector: weighted soft vote of three tree ensembles.

The two boosted members stand for gradient boosting libraries outside Spark.
They differ in depth, rounds and class weight; column sampling is per node and
trees grow by level, so probabilities differ from those libraries while the
vote, labels and reports are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkframe.functions.decisions import soft_vote
from hawkframe.operators.metrics import class_weights, confusion_metrics, roc_auc
from hawkframe.operators.sampling import row_numbers
from hawkframe.operators.sliced import running_sums
from hawkframe.schemas import FEATURES, Settings
from hawkframe.session import durable, ensure_checkpoint_dir

MEMBERS = ("random_forest", "boosted_a", "boosted_b")
_LOADERS = (RandomForestClassificationModel, GBTClassificationModel, GBTClassificationModel)

_META = (
    "random_forest_weight double, boosted_a_weight double, boosted_b_weight double, "
    "decision_threshold double, features string"
)

# Fixed member settings; override any of them in `fit`.
PARAMS = {
    "random_forest": {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"},
    "boosted_a": {"maxIter": 150, "maxDepth": 10, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "boosted_b": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "featureSubsetStrategy": "0.8"},
}


@dataclass
class EnsembleDetector:
    settings: Settings = field(default_factory=Settings)
    members: dict = field(default_factory=dict)
    features: str = "features"

    @property
    def is_trained(self) -> bool:
        return len(self.members) == len(MEMBERS)

    @property
    def weights(self) -> list[float]:
        s = self.settings
        return [s.random_forest_weight, s.boosted_a_weight, s.boosted_b_weight]

    def fit(self, df: DataFrame, label: str = "label", seed: int = 42, **overrides: dict) -> "EnsembleDetector":
        """Fit the members on the same rows with their own class weights."""
        ensure_checkpoint_dir(df.sparkSession)
        # One row per class reaches the driver.
        found = class_weights(df, label).limit(3).collect()
        if len(found) > 2:
            raise ValueError(f"{label} must have at most two values")
        table = {r[label]: r for r in found}

        def weight(kind: str) -> Column:
            out = F.lit(1.0)
            for value, row in table.items():
                out = F.when(F.col(label) == value, F.lit(float(row[kind]))).otherwise(out)
            return out

        rows = durable(
            df.select(
                F.col(self.features).cast("array<double>").alias("x"),
                F.col(label).cast("double").alias("label"),
                weight("balanced").alias("w_random_forest"),
                weight("fixed").alias("w_boosted_a"),
                weight("ratio").alias("w_boosted_b"),
            )
        ).withColumn("vec", array_to_vector("x"))
        for name in MEMBERS:
            options = {**PARAMS[name], **overrides.get(name, {})}
            kind = RandomForestClassifier if name == "random_forest" else GBTClassifier
            estimator = kind(
                featuresCol="vec", labelCol="label", weightCol=f"w_{name}", seed=seed, checkpointInterval=10, **options
            )
            self.members[name] = estimator.fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add member scores, `threat_score`, `ensemble_pred` and `model_confidence`."""
        if not self.is_trained:
            raise ValueError("train or load the ensemble first")
        out = df.withColumn("_vec", array_to_vector(F.col(self.features).cast("array<double>")))
        for name in MEMBERS:
            model = self.members[name]
            model.setFeaturesCol("_vec").setProbabilityCol("_prob").setPredictionCol("").setRawPredictionCol("_raw")
            out = model.transform(out).withColumn(f"{name}_score", vector_to_array("_prob")[1]).drop("_prob", "_raw")
        scores = [F.col(f"{m}_score") for m in MEMBERS]
        out = out.drop("_vec").withColumn("threat_score", soft_vote(scores, self.weights))
        return out.withColumns(
            {
                "ensemble_pred": (F.col("threat_score") > self.settings.decision_threshold).cast("int"),
                "model_confidence": F.greatest(*scores),
            }
        )

    def evaluate(self, df: DataFrame, label: str = "label") -> DataFrame:
        """Confusion counts, rates and AUC in one row."""
        scored = self.transform(df).select(label, "ensemble_pred", "threat_score")
        rates = confusion_metrics(scored, label, "ensemble_pred")
        auc = roc_auc(scored, "threat_score", label).select("auc")
        return rates.withColumn("auc", auc.scalar())

    def training_report(self, train: DataFrame, validation: DataFrame, label: str = "label") -> DataFrame:
        """Accuracy and AUC on the training and validation rows."""
        parts = [("train", train), ("validation", validation)]
        rows = [
            self.evaluate(df, label).select(F.lit(name).alias("split"), "accuracy", "auc") for name, df in parts
        ]
        return rows[0].unionByName(rows[1])

    def importances(self, names: list[str] = FEATURES) -> dict[str, dict[str, float]]:
        return {
            m: dict(zip(names, model.featureImportances.toArray().tolist())) for m, model in self.members.items()
        }

    def top_importances(self, spark: SparkSession, names: list[str] = FEATURES, limit: int = 15) -> DataFrame:
        """Strongest features by the weighted mean of the members."""
        rows = [
            (feature, member, value * w)
            for (member, values), w in zip(self.importances(names).items(), self.weights)
            for feature, value in values.items()
        ]
        table = spark.createDataFrame(rows, "feature string, member string, share double")
        return table.groupBy("feature").agg(F.sum("share").alias("importance")).orderBy(F.desc("importance"), "feature").limit(limit)

    def permutation_importance(
        self, df: DataFrame, id_col: str, label: str, names: list[str], repeats: int = 10, seed: int = 42
    ) -> DataFrame:
        """Mean AUC loss when one feature is shuffled among the rows; NULL where only one class is present.

        All shuffles are scored in one pass: each row is repeated once per feature and repeat, with that
        feature's value taken from the row at the same place in a random order.
        """
        rows = durable(row_numbers(df.select(id_col, label, self.features), id_col, "_at"))
        trials = F.explode(F.sequence(F.lit(0), F.lit(len(names) * repeats - 1)))
        spread = rows.select("*", trials.alias("_trial")).withColumn("_i", F.expr(f"cast(_trial div {repeats} AS INT)"))
        donors = spread.select(
            "_trial",
            F.col(id_col).alias("_donor"),
            F.get(self.features, F.col("_i")).alias("_new"),
            F.xxhash64(F.col(id_col), F.col("_trial"), F.lit(seed)).alias("_h"),
        ).withColumn("_slice", F.shiftright("_h", 56))
        ordered = running_sums(donors, ["_trial"], "_slice", ["_h", "_donor"], {"_place": F.lit(1)})
        ordered = ordered.select("_trial", F.col("_place").cast("long").alias("_at"), "_new")
        swapped = spread.withColumn("_at", F.col("_at").cast("long")).join(ordered, ["_trial", "_at"]).withColumn(
            self.features,
            F.transform(self.features, lambda x, at: F.when(at == F.col("_i"), F.col("_new")).otherwise(x)),
        )
        base = roc_auc(self.transform(rows), "threat_score", label).select("auc").scalar()
        lost = roc_auc(self.transform(swapped), "threat_score", label, ["_trial"])
        name = F.get(F.array(*[F.lit(n) for n in names]), F.expr(f"cast(_trial div {repeats} AS INT)"))
        return lost.groupBy(name.alias("feature")).agg(F.avg(base - F.col("auc")).alias("importance"))

    def save(self, path: str) -> None:
        if not self.is_trained:
            raise ValueError("no trained models to save")
        for name, model in self.members.items():
            model.write().overwrite().save(f"{path}/{name}")
        row = [(*self.weights, self.settings.decision_threshold, self.features)]
        SparkSession.active().createDataFrame(row, _META).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(path: str, settings: Settings | None = None) -> "EnsembleDetector":
        """The saved members; weights and threshold are the saved ones unless `settings` is given."""
        members = {name: loader.load(f"{path}/{name}") for name, loader in zip(MEMBERS, _LOADERS)}
        meta = SparkSession.active().read.parquet(f"{path}/meta").first().asDict()
        features = meta.pop("features")
        return EnsembleDetector(settings or Settings(**meta), members, features)
