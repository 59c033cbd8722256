"""One-class SVM with an RBF kernel through random Fourier features.

Kernel map: Rahimi and Recht 2007; objective: Schoelkopf et al. 2001.  The
margin is that of normalised multipliers (their sum is 1), so decisions have
the sign and order of the kernel form but another scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkframe.operators.sliced import exact_quantiles


@dataclass
class OneClassSVM:
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float

    @staticmethod
    def fit(
        df: DataFrame,
        features: str = "features",
        nu: float = 0.02,
        gamma: float | None = None,
        dimensions: int = 256,
        iterations: int = 15,
        seed: int = 42,
    ) -> "OneClassSVM":
        """Full-batch subgradient steps; a step moves `dimensions` numbers.

        Every task sums its own rows first, so what is shuffled does not grow
        with the table.
        """
        width = df.agg(F.max(F.size(features)).alias("d")).first()["d"]
        gamma = gamma if gamma is not None else 1.0 / width
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, dimensions))
        b = rng.uniform(0.0, 2.0 * np.pi, dimensions)
        rows = df.select(F.col(features).cast("array<double>").alias("x"))
        model = OneClassSVM(w, b, np.zeros(dimensions), 0.0)
        total, n = model._mean_map(rows, None)
        model.weights = total / n
        for step in range(2, iterations + 2):
            margins = rows.select(model.margin("x").alias("m"))
            model.rho = float(margins.agg(F.percentile_approx("m", nu, 10000)).first()[0])
            pull, outside = model._mean_map(rows, model.rho)
            if outside == 0:
                break
            target = pull / (nu * n)
            model.weights = model.weights + (target - model.weights) / step
        margins = rows.select(model.margin("x").alias("m"))
        model.rho = float(exact_quantiles(margins, "m", {"rho": nu}).first()["rho"])
        return model

    def _mean_map(self, rows: DataFrame, below: float | None) -> tuple[np.ndarray, int]:
        """Sum of mapped rows (those with a margin up to `below`) and their number."""
        w, b, weights = self.directions, self.phases, self.weights
        size = len(b)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count = np.zeros(size), 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                z = _map(np.vstack(pdf["x"].to_numpy()), w, b)
                if below is not None:
                    z = z[z @ weights <= below]
                total += z.sum(axis=0)
                count += len(z)
            if count:
                yield pd.DataFrame({"i": np.arange(size + 1), "v": np.append(total, float(count))})

        sums = rows.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size + 1)
        for r in sums:
            out[r["i"]] = r["v"]
        return out[:size], int(out[size])

    def margin(self, features: str = "features") -> Column:
        w, b, weights = self.directions, self.phases, self.weights

        @F.pandas_udf("double")
        def udf(s: pd.Series) -> pd.Series:
            if len(s) == 0:
                return pd.Series([], dtype="float64")
            return pd.Series(_map(np.vstack(s.to_numpy()).astype(np.float64), w, b) @ weights)

        return udf(F.col(features))

    def decision(self, features: str = "features") -> Column:
        return self.margin(features) - F.lit(self.rho)

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.directions.ravel().tolist(), self.phases.tolist(), self.weights.tolist(), float(self.rho))]
        schema = "directions array<double>, phases array<double>, weights array<double>, rho double"
        spark.createDataFrame(row, schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "OneClassSVM":
        r = spark.read.parquet(path).first()
        phases = np.array(r["phases"])
        return OneClassSVM(np.array(r["directions"]).reshape(-1, len(phases)), phases, np.array(r["weights"]), r["rho"])


def _map(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(b)) * np.cos(x @ w + b)
