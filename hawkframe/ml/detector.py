"""Unsupervised detector: three members and a majority vote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkframe.functions.decisions import anomaly_score, majority_vote
from hawkframe.ml.iforest import IsolationForest
from hawkframe.ml.neighbors import LocalOutlierFactor
from hawkframe.ml.ocsvm import OneClassSVM
from hawkframe.ml.scale import Scaler
from hawkframe.session import durable

MEMBERS = ("isolation_forest", "one_class_svm", "lof")


def _flag(decision: Column) -> Column:
    return F.when(decision < 0, F.lit(-1)).otherwise(F.lit(1))


@dataclass
class AnomalyDetector:
    contamination: float = 0.02
    scaler: Scaler | None = None
    isolation_forest: IsolationForest | None = None
    one_class_svm: OneClassSVM | None = None
    lof: LocalOutlierFactor | None = None
    id_col: str = "event_id"
    features: str = "features"

    @property
    def is_trained(self) -> bool:
        return self.lof is not None

    def fit(
        self, df: DataFrame, trees: int = 100, samples: int = 256, k: int = 20, seed: int = 42
    ) -> "AnomalyDetector":
        """Train on rows that are mostly normal."""
        self.scaler = Scaler.fit(df, self.features)
        x = durable(df.select(self.id_col, self.scaler.apply(self.features).alias("features")))
        c = self.contamination
        self.isolation_forest = IsolationForest.fit(x, self.id_col, "features", trees, samples, c, seed)
        self.one_class_svm = OneClassSVM.fit(x, "features", nu=c, seed=seed)
        self.lof = LocalOutlierFactor.fit(x, self.id_col, "features", k, c)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add member scores (higher is more anomalous), `anomaly_pred` and `anomaly_score`."""
        if not self.is_trained:
            raise ValueError("train or load the detector first")
        x = df.withColumn("_features", self.scaler.apply(self.features))
        scored = self.lof.score(x, self.id_col, "_features").select(
            *df.columns,
            self.isolation_forest.decision("_features").alias("_a"),
            self.one_class_svm.decision("_features").alias("_b"),
            F.col("lof_decision").alias("_c"),
        )
        parts = [F.col(c) for c in ("_a", "_b", "_c")]
        return scored.select(
            *df.columns,
            *[(-p).alias(f"{m}_score") for m, p in zip(MEMBERS, parts)],
            *[_flag(p).alias(f"{m}_pred") for m, p in zip(MEMBERS, parts)],
            majority_vote([_flag(p) for p in parts]).alias("anomaly_pred"),
            anomaly_score(parts).alias("anomaly_score"),
        )

    def training_stats(self, df: DataFrame) -> DataFrame:
        """Anomalies found by each member and by the vote, in one row."""
        out = self.transform(df)
        return out.agg(
            *[F.count_if(F.col(f"{m}_pred") == -1).alias(f"{m}_anomalies") for m in MEMBERS],
            F.count_if(F.col("anomaly_pred") == -1).alias("ensemble_anomalies"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        if not self.is_trained:
            raise ValueError("no trained models to save")
        schema = "contamination double, id_col string, features string, mean array<double>, std array<double>"
        row = [(self.contamination, self.id_col, self.features, self.scaler.mean, self.scaler.std)]
        spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/meta")
        for m in MEMBERS:
            getattr(self, m).save(spark, f"{path}/{m}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyDetector":
        meta = spark.read.parquet(f"{path}/meta").first()
        return AnomalyDetector(
            meta["contamination"],
            Scaler(list(meta["mean"]), list(meta["std"])),
            IsolationForest.load(spark, f"{path}/isolation_forest"),
            OneClassSVM.load(spark, f"{path}/one_class_svm"),
            LocalOutlierFactor.load(spark, f"{path}/lof"),
            meta["id_col"],
            meta["features"],
        )
