"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of rows and indexes every row. A query walks it with a priority queue of
branches, most similar centre first, and visits leaves in that order; how many is found on sample queries whose true
neighbours are known from a scan of all rows: visits widen until the wanted recall is reached. Equal vectors are one
entry with their smallest ids, so a vector that fills a third of the table is compared once.
"""

from __future__ import annotations

import dataclasses
import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, map_batches

# Bounds: rows the tree is fitted on, sample queries of the calibration, rows of a leaf that one task compares.
FIT_ROWS = 20_000
CALIBRATION_QUERIES = 200
CHUNK_ROWS = 4096
BRANCHES = 16
LEAF_POINTS = 160
RECALL = 0.97


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    # Scaled by the largest component first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def stacked(vectors: list[bytes]) -> np.ndarray:
    """Vectors kept as bytes, one below the other."""
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1) if vectors else np.zeros((0, 1))


@dataclasses.dataclass
class Tree:
    """Centres of each inner node's branches, and for each branch its node (>= 0) or leaf (~leaf)."""

    centres: list[np.ndarray]
    branches: list[np.ndarray]
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, following the most similar centre."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            best = (x[rows] @ self.centres[node].T).argmax(1)
            for b in np.unique(best).tolist():
                child, own = int(self.branches[node][b]), rows[best == b]
                if child < 0:
                    leaf[own] = ~child
                else:
                    todo.append((child, own))
        return leaf

    def visit(self, q: np.ndarray, most: int | None = None) -> list[int]:
        """Leaves in best-bin-first order, `most` at most."""
        most = self.leaves if most is None else most
        if not self.centres:
            return [0][:most]
        out: list[int] = []
        queue = [(-1.0, 0)]
        while queue and len(out) < most:
            _, at = heapq.heappop(queue)
            if at < 0:
                out.append(~at)
                continue
            for near, child in zip((self.centres[at] @ q).tolist(), self.branches[at].tolist(), strict=True):
                heapq.heappush(queue, (-near, child))
        return out


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf_points: int = LEAF_POINTS, seed: int = 5) -> Tree:
    """Spherical k-means, level by level, until a node has at most `leaf_points` points or cannot be split."""
    rng = np.random.default_rng(seed)
    tree = Tree([], [], 0)

    def split(rows: np.ndarray) -> int:
        k = min(branches, max(2, -(-len(rows) // leaf_points)))
        centres = x[rng.choice(rows, k, replace=False)] if len(rows) > leaf_points else None
        if centres is not None:
            for _ in range(8):
                best = (x[rows] @ centres.T).argmax(1)
                sums = np.zeros_like(centres)
                np.add.at(sums, best, x[rows])
                size = np.sqrt((sums**2).sum(1))
                centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
            best = (x[rows] @ centres.T).argmax(1)
            used = np.unique(best)
        if centres is None or len(used) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        node = len(tree.centres)
        tree.centres.append(centres[used])
        tree.branches.append(np.zeros(len(used), np.int64))
        for i, b in enumerate(used.tolist()):
            tree.branches[node][i] = split(rows[best == b])
        return node

    if len(x):
        split(np.arange(len(x)))
    tree.leaves = max(tree.leaves, 1)
    return tree


def nearest(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int, int]]]:
    """For each query row the k nearest ids as (score, id, row of x): equal scores (to 12 digits) by smaller id."""
    out = []
    a, b = unit(q), unit(x)
    for i in range(0, len(a), 256):
        near = a[i : i + 256] @ b.T
        cut = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
        for j in range(len(near)):
            rows = np.flatnonzero(near[j] >= cut[j] - 1e-11)
            score = np.einsum("j,ij->i", a[i + j], b[rows])
            found = [(-round(s, 12), key, s, r) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for key in ids[r]]
            out.append([(s, key, r) for _, key, s, r in heapq.nsmallest(k, found)])
    return out


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """One row per different usable vector: `embedding`, `ids` (its k + 1 smallest), `asked` (one of its rows is a query).

    Null ids, and vectors that are null, zero, hold nulls or non-finite numbers, or have not the most frequent length (the
    longer one at a tie) take no part. The smallest ids suffice, since equal vectors rank by id; Spark limits each
    group before its shuffle.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    usable = vectors.select("vec_id", e.cast("array<double>").alias("embedding"), F.col("asked"))
    usable = usable.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(finite)
    length = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    usable = usable.where(F.size("embedding") == (length["n"] if length else 0))
    flags = usable.groupBy("embedding").agg(F.max("asked").alias("asked"))
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = usable.groupBy("embedding", "vec_id").agg(F.max("asked").alias("asked")).withColumn("_n", nth).where(F.col("_n") <= k + 1)
    few = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return few.join(flags, "embedding")


def search(vectors: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """The k nearest rows of every row with `asked` true: query_id, rank (from 1), vec_id, score.

    `vectors` has vec_id, embedding and asked. A query's own id is no candidate. Rows with equal scores rank by id. Fewer
    candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    every = durable(entries(vectors, k).withColumn("key", F.element_at("ids", 1)))
    sample = every.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("embedding").toArrow()
    points = np.array(sample.column("embedding").to_pylist(), np.float64)
    tree = fit_tree(unit(points)) if len(points) else Tree([], [], 1)
    shared = spark.sparkContext.broadcast(tree)

    def assign(columns):
        x = np.array(columns["embedding"], np.float64)
        return {**columns, "embedding": [v.tobytes() for v in x], "leaf": shared.value.assign(unit(x)) if len(x) else []}

    index = durable(map_batches(every.select("key", "embedding", "ids", "asked"), assign, "key long, embedding binary, ids array<long>, asked boolean, leaf long"))
    visits = calibrated_visits(index, tree, shared, k, recall)
    chunks = {r["leaf"]: -(-r["count"] // CHUNK_ROWS) for r in index.groupBy("leaf").count().collect()}  # one row per leaf: bounded by FIT_ROWS
    parts = spark.sparkContext.broadcast(chunks)

    def spread(columns):
        out = {"key": [], "embedding": [], "leaf": [], "chunk": []}
        for key, vector in zip(columns["key"], columns["embedding"], strict=True):
            for leaf in shared.value.visit(unit(stacked([vector]))[0], visits):
                for c in range(parts.value.get(leaf, 0)):
                    for name, value in (("key", key), ("embedding", vector), ("leaf", leaf), ("chunk", c)):
                        out[name].append(value)
            if len(out["key"]) > 20_000:
                yield out
                out = {name: [] for name in out}
        yield out

    asked = map_batches(index.where("asked").select("key", "embedding"), spread, "key long, embedding binary, leaf long, chunk long")
    pick = F.create_map(*[F.lit(v) for leaf, n in chunks.items() if n > 1 for v in (leaf, n)]) if any(n > 1 for n in chunks.values()) else F.lit(None).cast("map<int,int>")
    rows = index.withColumn("chunk", F.pmod(F.xxhash64("key"), F.coalesce(F.element_at(pick, F.col("leaf").cast("int")), F.lit(1)).cast("long")))

    def compare(queries, candidates):
        import pyarrow as pa

        keys, q = queries.column("key").to_pylist(), stacked(queries.column("embedding").to_pylist())
        x = stacked(candidates.column("embedding").to_pylist())
        found = nearest(q, x, candidates.column("ids").to_pylist(), k + 1) if len(q) and len(x) else []
        made = [(key, s, i) for key, best in zip(keys, found, strict=False) for s, i, _ in best]
        return pa.table({"key": pa.array([m[0] for m in made], pa.int64()), "score": pa.array([m[1] for m in made], pa.float64()), "vec_id": pa.array([m[2] for m in made], pa.int64())})

    near = asked.groupBy("leaf", "chunk").cogroup(rows.select("leaf", "chunk", "embedding", "ids").groupBy("leaf", "chunk")).applyInArrow(compare, "key long, score double, vec_id long")
    order = F.struct((-F.round("score", 12)).alias("far"), F.col("vec_id"), F.col("score"))
    best = near.groupBy("key").agg(F.array_sort(F.collect_list(order)).alias("best")).withColumn("best", F.slice("best", 1, k + 1))
    # A query is a row; rows with equal vectors share the entry's answer, each without itself.
    entry = every.where("asked").select(F.col("key").alias("_key"), F.col("embedding").alias("_v"))
    queries = vectors.where("asked").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("_e")).distinct()
    answers = queries.join(entry, F.col("_e") == F.col("_v")).select("query_id", "_key").join(best, F.col("_key") == F.col("key"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    flat = answers.select("query_id", F.posexplode(others).alias("rank", "b"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def calibrated_visits(index: DataFrame, tree: Tree, shared, k: int, recall: float) -> int:
    """Leaves to visit so that the sample queries find `recall` of their true neighbours.

    The true neighbours come from one scan of all entries, in blocks; each lies in a leaf that the query would reach
    at a known place of its order, so one traversal tells the recall of every number of visits.
    """
    rows = index.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(CALIBRATION_QUERIES).select("key", "embedding").collect()
    if not rows:
        return 1
    keys, q = [r["key"] for r in rows], stacked([r["embedding"] for r in rows])
    sent = index.sparkSession.sparkContext.broadcast(q)

    def scan(columns):
        x = stacked(columns["embedding"])
        found = nearest(sent.value, x, columns["ids"], k + 1) if len(x) else []
        made = [(n, s, i, columns["leaf"][r]) for n, best in enumerate(found) for s, i, r in best]
        return {name: [m[j] for m in made] for j, name in enumerate(("n", "score", "vec_id", "leaf"))}

    all_near = map_batches(index.select("embedding", "ids", "leaf"), scan, "n int, score double, vec_id long, leaf long")
    order = F.struct((-F.round("score", 12)).alias("far"), "vec_id", "leaf")
    true = all_near.groupBy("n").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("best")).collect()  # one row per sample query
    needed = []
    for r in true:
        place = {leaf: i for i, leaf in enumerate(tree.visit(unit(q[r["n"] : r["n"] + 1])[0]))}
        needed += [place[b["leaf"]] + 1 for b in [b for b in r["best"] if b["vec_id"] != keys[r["n"]]][:k]]
    visits = 1
    while needed and sum(n <= visits for n in needed) < recall * len(needed):
        visits = min(tree.leaves, visits + max(1, visits // 4))
    return visits
