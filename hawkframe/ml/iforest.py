"""Isolation forest (Liu, Ting and Zhou 2008): trees grow in parallel tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkframe.operators.sliced import exact_quantiles

_HASH = 1 << 30
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varied) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + expected_path(len(rows))])
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, 0.0])
        goes_left = part[:, f] <= cut
        todo.append((rows[goes_left], depth + 1, number, 2))
        todo.append((rows[~goes_left], depth + 1, number, 3))
    return [(i, *n) for i, n in enumerate(nodes)]


@dataclass
class IsolationForest:
    """At most trees * 2 * samples nodes, so the forest fits the driver and each task."""

    nodes: pd.DataFrame
    sample_size: int
    offset: float = 0.0

    @staticmethod
    def fit(
        df: DataFrame,
        id_col: str,
        features: str = "features",
        trees: int = 100,
        samples: int = 256,
        contamination: float = 0.02,
        seed: int = 42,
    ) -> "IsolationForest":
        n = df.count()
        size = min(samples, n)
        # Each row draws one hash per tree; a tree takes the rows with the
        # lowest ones.  The cut leaves about four times the rows it needs.
        cut = int(min(1.0, 4.0 * size / max(n, 1)) * _HASH)
        draw = lambda j: F.pmod(F.xxhash64(F.col(id_col), j, F.lit(seed)), F.lit(_HASH))
        picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda j: draw(j) < cut)
        sampled = df.select(id_col, features, F.explode(picks).alias("tree")).select(
            "tree", draw(F.col("tree")).alias("h"), F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("x")
        )
        limit = int(np.ceil(np.log2(max(size, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            chosen = pdf.sort_values(["h", "id"]).head(size)
            x = np.vstack(chosen["x"].to_numpy())
            rows = _grow(x, np.random.default_rng([seed, tree]), limit)
            names = ["node", "feature", "threshold", "left", "right", "path"]
            return pd.DataFrame(rows, columns=names).assign(tree=tree)[["tree", *names]]

        nodes = sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
        model = IsolationForest(nodes.sort_values(["tree", "node"]), size)
        scored = df.select(model.score(features).alias("s"))
        quantile = exact_quantiles(scored, "s", {"offset": contamination})
        model.offset = float(quantile.first()["offset"])
        return model

    def score(self, features: str = "features") -> Column:
        """-2^(-mean path / expected path): nearer to -1 is more anomalous."""
        trees = [
            tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path"))
            for _, g in self.nodes.groupby("tree", sort=True)
        ]
        norm = max(expected_path(self.sample_size), 1e-12)

        @F.pandas_udf("double")
        def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                if len(s) == 0:
                    yield pd.Series([], dtype="float64")
                    continue
                x = np.vstack(s.to_numpy()).astype(np.float64)
                total = np.zeros(len(x))
                rows = np.arange(len(x))
                for feature, threshold, left, right, path in trees:
                    at = np.zeros(len(x), dtype=np.int64)
                    while True:
                        f = feature[at]
                        inner = f >= 0
                        if not inner.any():
                            break
                        goes_left = x[rows, np.maximum(f, 0)] <= threshold[at]
                        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                    total += path[at]
                yield pd.Series(-np.exp2(-total / (len(trees) * norm)))

        return udf(F.col(features))

    def decision(self, features: str = "features") -> Column:
        return self.score(features) - F.lit(self.offset)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(int(self.sample_size), float(self.offset))]
        spark.createDataFrame(meta, "sample_size int, offset double").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        meta = spark.read.parquet(f"{path}/meta").first()
        return IsolationForest(nodes, meta["sample_size"], meta["offset"])
