"""Standardisation with the population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation per position; two numbers per feature live on the driver."""

    mean: list[float]
    std: list[float]

    @staticmethod
    def fit(df: DataFrame, features: str = "features") -> "Scaler":
        width = df.agg(F.max(F.size(features)).alias("d")).first()["d"]
        at = [F.get(features, F.lit(i)).cast("double") for i in range(width)]
        row = df.agg(
            F.array(*[F.avg(x) for x in at]).alias("m"),
            F.array(*[F.stddev_pop(x) for x in at]).alias("s"),
        ).first()
        return Scaler(list(row["m"]), [s if s > 0 else 1.0 for s in row["s"]])

    def apply(self, features: str | Column = "features") -> Column:
        col = F.col(features) if isinstance(features, str) else features
        mean = F.array(*[F.lit(m) for m in self.mean])
        std = F.array(*[F.lit(s) for s in self.std])
        return F.transform(
            col, lambda x, i: (x.cast("double") - F.get(mean, i)) / F.get(std, i)
        )
