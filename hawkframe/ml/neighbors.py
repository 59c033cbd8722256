"""Nearest neighbours and the local outlier factor (Breunig et al. 2000), exact or by random projections.

Exact: points go to the cell of their nearest pivot and each cell is cut into blocks
of rings around it.  A query visits only blocks that the triangle inequality
cannot rule out, so results are exact without comparing every pair of blocks.
Points and queries are written once, packed thousands to a row.  A task holds a few
packs of queries and streams the packs of points past them, so no pair of a query
and a block is ever written.  Copies of a point are one point with a weight.  The
driver holds one row of bounds per block.

Projections: each of several trees halves the space by random directions at
medians of a bounded sample, and a query is compared with its leaf in every
tree.  Leaves are cut into blocks of bounded size, so cost grows with the rows
alone; some neighbours can be missed.  The caller chooses, never the size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hawkframe.operators.sliced import exact_quantiles, lookup_join
from hawkframe.session import durable

_PIVOTS = 128
_BLOCK_ROWS = 2048
_TREES = 16
_LEAF_ROWS = 2048
_SAMPLE_ROWS = 20_000
_DEEPEST = 10
_QUERY_ROWS = 2048
_CELLS_IN_MEMORY = 4_000_000
# Rows of a pack of points and of queries, packs of queries a task holds, and products compared at once.
_POINT_PACK = 16_384
_QUERY_PACK = 4096
_PACKS_HELD = 16
_CELLS_COMPARED = 1 << 21


def distinct_points(df: DataFrame, id_col: str, features: str) -> DataFrame:
    """One row per different vector: smallest id and number of copies."""
    vec = F.col(features).cast("array<double>")
    return df.groupBy(vec.alias("vec")).agg(
        F.min(id_col).alias("pid"), F.count(F.lit(1)).alias("weight")
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, _CELLS_IN_MEMORY // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _nearest_pivot(pivots: np.ndarray) -> Column:
    @F.pandas_udf("cell int, r double")
    def udf(vec: pd.Series) -> pd.DataFrame:
        if len(vec) == 0:
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "r": pd.Series([], dtype="float64")})
        d = _distances(np.vstack(vec.to_numpy()), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "r": d[np.arange(len(d)), cell]})

    return udf(F.col("vec"))


def _matrix(vec: pa.ChunkedArray | pa.Array) -> np.ndarray:
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = vec.value_lengths().drop_null().unique()
    if vec.null_count or len(width) > 1:
        raise ValueError("vectors must all be there and of one length")
    return flat.reshape(len(vec), -1)


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of the batches, `rows` at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _packed(
    df: DataFrame, pivots: np.ndarray, id_col: str, rows: int, schema: str, pack: Callable[[pa.Table, int], dict]
) -> DataFrame:
    """`df` in order of nearest pivot and distance to it, about `rows` rows packed into one; written."""
    placed = df.withColumn("_p", _nearest_pivot(pivots)).select(*df.columns, "_p.cell", "_p.r")
    ordered = placed.repartitionByRange(max(1, -(-df.count() // rows)), "cell", "r").sortWithinPartitions("cell", "r", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, t in enumerate(_tables(batches, rows), first):
            made = pack(t, number)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([v[0]], type=v[1]) for v in made.values()], names=[*made])

    return durable(ordered.mapInArrow(run, schema))


def _ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers or objects that sort as they do in Spark, and which of them are null."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), none
    out = np.empty(len(ids), dtype=object)
    out[:] = ids.drop_null()[:1].to_pylist() * len(ids) if none.all() else ids.to_pylist()
    if none.any() and not none.all():
        out[none] = out[np.flatnonzero(~none)[0]]
    return out, none


def _set(flags: np.ndarray) -> np.ndarray:
    """Positions of flags, few of which are set: eight are read at once."""
    words = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:words].view(np.uint64))
    at = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.append(at[flags[at]], words + np.flatnonzero(flags[words:]))


class _Augmented:
    """Vectors with two more columns, so that one matrix product gives squared distances, and the product's error."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, query: bool):
        self.x = x - centre
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.query, self.made = query, {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.made:
            one = np.ones(len(self.x))
            cols = [-2.0 * self.x, one, self.norm] if self.query else [self.x, self.norm, one]
            self.made[kind] = np.column_stack(cols).astype(kind)
        return self.made[kind]

    def error(self, kind: type, rows: np.ndarray, other: float) -> np.ndarray:
        info = np.finfo(kind)
        return 4.0 * (self.x.shape[1] + 4) * float(info.eps) * (self.norm[rows] + other) + 1e3 * float(info.tiny)


class _Search:
    """The `need` nearest points, by distance and id, of each query of a pack among the blocks seen so far.

    A matrix product in single precision, or in double where that is too coarse, with its error rules points out;
    distances of the others are computed as `_distances` does.
    """

    def __init__(self, ids: pa.Array, x: np.ndarray, reach: np.ndarray, pivots: np.ndarray, centre: np.ndarray, need: int):
        self.ids, self.x, self.limit, self.need, self.centre = ids, x, reach.copy(), need, centre
        self.to_pivot = _distances(x, pivots)
        self.full = np.zeros(len(x), dtype=bool)
        self.aug = _Augmented(x, centre, True)
        self.best: tuple[np.ndarray, ...] | None = None
        self.new: list[tuple[np.ndarray, ...]] = []

    def visit(self, ids: pa.Array, y: np.ndarray, weight: np.ndarray, blocks: list[tuple[int, int, float, float]]) -> None:
        key, none = _ids(ids)
        at = 0
        for cell, size, low, high in blocks:
            d = self.to_pivot[:, cell]
            near = np.maximum(np.maximum(d - high, low - d), 0.0) - 1e-9 * (d + high)
            rows = np.flatnonzero(~(near > self.limit))
            here = slice(at, at + size)
            at += size
            if len(rows):
                self._compare(rows, y[here], key[here], none[here], weight[here])
                if sum(len(n[0]) for n in self.new) > len(self.x) * self.need // 2 or not self.full[rows].all():
                    self._merge()

    def _compare(self, rows: np.ndarray, y: np.ndarray, key: np.ndarray, none: np.ndarray, weight: np.ndarray) -> None:
        points = _Augmented(y, self.centre, False)
        step = max(1, _CELLS_COMPARED // len(y))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            hits = self._hits(np.float32, part, points)
            if len(hits) > 8 * self.need * len(part):
                hits = self._hits(np.float64, part, points)
            few = max(1, _CELLS_COMPARED // 4 // y.shape[1])
            for j in range(0, len(hits), few):
                row, p = np.divmod(hits[j : j + few], len(y))
                row = part[row]
                diff = self.x[row] - y[p]
                dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                ok = dist <= self.limit[row]
                row, p, dist = row[ok], p[ok], dist[ok]
                self.new.append((row, dist, none[p], key[p], weight[p]))
            if sum(len(n[0]) for n in self.new) > _CELLS_COMPARED // 16:
                self._merge()

    def _hits(self, kind: type, rows: np.ndarray, points: _Augmented) -> np.ndarray:
        """Positions (row, point) of a product that may be among the nearest."""
        q, p = self.aug.of(kind), points.of(kind)
        whole = len(rows) and rows[-1] - rows[0] + 1 == len(rows)
        square = (q[rows[0] : rows[-1] + 1] if whole else q[rows]) @ p.T
        finite = points.norm[np.isfinite(points.norm)]
        error = self.aug.error(kind, rows, finite.max() if len(finite) else 0.0)
        most = self.limit[rows] ** 2 * (1 + 1e-9) + error
        short = np.flatnonzero(~self.full[rows])
        if len(p) > self.need and len(short):
            seen = np.partition(square[short], self.need - 1, axis=1)[:, self.need - 1]
            most[short] = np.fmin(most[short], seen + 2 * error[short])
        over = square > (most * (1 + 1e-6)).astype(kind)[:, None]
        return _set(np.logical_not(over, out=over).ravel())

    def _merge(self) -> None:
        if not self.new:
            return
        parts = ([self.best] if self.best else []) + self.new
        cols = [np.concatenate(c) for c in zip(*parts)]
        row, dist, none, key, _ = cols
        order = np.lexsort((key, ~none, dist, row))  # null ids first, as in Spark
        row = row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        self.best, self.new = tuple(c[order[rank < self.need]] for c in cols), []
        last = order[rank == self.need - 1]
        self.full[cols[0][last]] = True
        self.limit[cols[0][last]] = np.minimum(self.limit[cols[0][last]], dist[last])

    def result(self, skip_self: bool) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.best is None:
            return
        row, dist, none, key, weight = self.best
        if skip_self:
            own, lost = _ids(self.ids)
            weight = weight - ((key == own[row]).astype(bool) & ~none & ~lost[row])
        ids = pa.array(key, mask=none, type=self.ids.type)
        t = pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), ids, pa.array(dist), pa.array(weight)], names=["qid", "pid", "dist", "weight"])
        yield t.filter(pa.array(weight > 0))


@dataclass
class NeighborIndex:
    """Blocks of points; pivots and block bounds are small and of bounded number.

    A row of `points` is a pack of blocks: their ids, vectors and weights, and the blocks' sizes and bounds.
    """

    points: DataFrame
    pivots: np.ndarray
    blocks: pd.DataFrame

    @staticmethod
    def build(points: DataFrame, pivots: int = _PIVOTS, block_rows: int = _BLOCK_ROWS) -> "NeighborIndex":
        n = points.count()
        pivots = int(max(1, min(pivots, np.sqrt(max(n, 1)))))
        chosen = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()
        centre = np.array([r["vec"] for r in chosen])

        def pack(t: pa.Table, number: int) -> dict:
            x, r = _matrix(t["vec"]), t["r"].to_numpy()
            there = ~np.isnan(x).any(axis=1)  # a vector with NaN is near none
            if not there.any():
                return {}
            x, r, cell, weight = x[there], r[there], t["cell"].to_numpy()[there], t["weight"].to_numpy()[there]
            edge = np.flatnonzero(np.diff(cell, prepend=-1))
            starts = np.array([s for a, b in zip(edge, np.append(edge[1:], len(cell))) for s in range(a, b, block_rows)])
            ids = t["pid"].combine_chunks().filter(pa.array(there))
            return {
                "pack": (number, pa.int64()),
                "pid": (ids.to_pylist(), pa.list_(ids.type)),
                "vec": (np.ascontiguousarray(x).tobytes(), pa.binary()),
                "weight": (weight.astype(np.int64).tobytes(), pa.binary()),
                "cell": (cell[starts].tolist(), pa.list_(pa.int32())),
                "size": (np.diff(np.append(starts, len(cell))).tolist(), pa.list_(pa.int32())),
                "low": (np.minimum.reduceat(r, starts).tolist(), pa.list_(pa.float64())),
                "high": (np.maximum.reduceat(r, starts).tolist(), pa.list_(pa.float64())),
                "heavy": (np.add.reduceat(weight, starts).tolist(), pa.list_(pa.int64())),
            }

        schema = (
            f"pack bigint, pid array<{dict(points.dtypes)['pid']}>, vec binary, weight binary, "
            "cell array<int>, size array<int>, low array<double>, high array<double>, heavy array<bigint>"
        )
        packs = _packed(points.select("pid", "vec", "weight"), centre, "pid", _POINT_PACK, schema, pack)
        zipped = F.explode(F.arrays_zip("cell", "low", "high", F.col("heavy").alias("weight"))).alias("b")
        bounds = (
            packs.select("pack", zipped)
            .select("pack", "b.cell", "b.low", "b.high", "b.weight")
            .toPandas()
            .sort_values(["cell", "low", "pack"])
            .reset_index(drop=True)
        )
        bounds["block"] = np.arange(len(bounds), dtype=np.int32)
        return NeighborIndex(packs, centre, bounds)

    def _bounds(self, need: int) -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
        """For vectors, some at a time: how far their `need` nearest points can be, and which blocks they must visit."""
        centre = self.pivots
        cell = self.blocks["cell"].to_numpy()
        low, high = self.blocks["low"].to_numpy(), self.blocks["high"].to_numpy()
        weight = self.blocks["weight"].to_numpy()

        def of(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = max(1, _CELLS_COMPARED // 4 // max(1, len(cell)))
            for i in range(0, len(x), step):
                d = _distances(x[i : i + step], centre)[:, cell]
                far = d + high
                order = np.argsort(far, axis=1)
                have = np.cumsum(weight[order], axis=1)
                last = np.minimum((have < need).sum(axis=1), far.shape[1] - 1)
                reach = np.take_along_axis(far, order, 1)[np.arange(len(d)), last]
                reach = np.where(have[:, -1] < need, np.inf, reach * (1 + 1e-9) + 1e-12)
                near = np.maximum(np.maximum(d - high, low - d), 0.0)
                yield reach, near <= reach[:, None]

        return of

    def _route(self, need: int) -> Column:
        """Blocks a query must visit to be sure of its `need` nearest points."""
        bounds, block = self._bounds(need), self.blocks["block"].to_numpy()

        @F.pandas_udf("array<int>")
        def udf(vec: pd.Series) -> pd.Series:
            if not len(vec):
                return pd.Series([], dtype=object)
            return pd.Series([block[k] for _, keep in bounds(np.vstack(vec.to_numpy())) for k in keep])

        return udf(F.col("vec"))

    def _found(self, queries: DataFrame, need: int, skip_self: bool) -> DataFrame:
        """Rows (qid, pid, dist, weight) with the `need` nearest points of each query, and maybe more."""
        bounds, pack_of, pivots = self._bounds(need), self.blocks["pack"].to_numpy(), self.pivots
        kinds = dict(self.points.dtypes)
        id_type = kinds["pid"].removeprefix("array<").removesuffix(">")
        if not len(pack_of):
            return self.points.sparkSession.createDataFrame([], f"qid {id_type}, pid {id_type}, dist double, weight bigint")

        def pack(t: pa.Table, number: int) -> dict:
            x = _matrix(t["vec"])
            reach, blocks = [], np.zeros(len(pack_of), dtype=bool)
            for r, keep in bounds(x):
                reach.append(r)
                blocks |= keep.any(axis=0)
            ids = t["qid"].combine_chunks()
            return {
                "part": (number, pa.int64()),
                "qid": (ids.to_pylist(), pa.list_(ids.type)),
                "qvec": (np.ascontiguousarray(x).tobytes(), pa.binary()),
                "reach": (np.concatenate(reach).tobytes(), pa.binary()),
                "packs": (np.unique(pack_of[blocks]).tolist(), pa.list_(pa.int64())),
            }

        schema = f"part bigint, qid array<{id_type}>, qvec binary, reach binary, packs array<bigint>"
        asked = _packed(queries.select("qid", "vec"), pivots, "qid", _QUERY_PACK, schema, pack)
        finite = pivots[np.isfinite(pivots).all(axis=1)]
        centre = finite.mean(axis=0) if len(finite) else np.zeros(pivots.shape[1])
        width = pivots.shape[1]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, _Search] = {}
            with np.errstate(all="ignore"):
                for batch in batches:
                    for i in range(batch.num_rows):
                        at = {n: batch.column(n)[i] for n in batch.schema.names}
                        data = lambda n, kind=np.float64: np.frombuffer(at[n].as_buffer(), kind)  # noqa: B023, E731
                        part = at["part"].as_py()
                        if part not in held:
                            if len(held) >= _PACKS_HELD:
                                yield from held.pop(next(iter(held))).result(skip_self)
                            # Copies, as the batch goes.
                            ids = pa.concat_arrays([at["qid"].values])
                            held[part] = _Search(ids, data("qvec").reshape(-1, width).copy(), data("reach"), pivots, centre, need)
                        blocks = [*zip(*(at[n].as_py() for n in ("cell", "size", "low", "high")))]
                        held[part].visit(at["pid"].values, data("vec").reshape(-1, width), data("weight", np.int64), blocks)
                for s in held.values():
                    yield from s.result(skip_self)

        pairs = asked.hint("shuffle_replicate_nl").join(self.points.drop("heavy"), F.array_contains("packs", F.col("pack")))
        # Joined, a part of queries meets the parts of points one after the other; one task takes them all.
        parts = max(1, asked.rdd.getNumPartitions())
        return pairs.drop("packs", "pack").coalesce(parts).mapInArrow(search, f"qid {id_type}, pid {id_type}, dist double, weight bigint")

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """The k nearest points of each query (qid, vec): qid, pid, dist, weight.

        Copies count with their weight, the last point only up to k.  With
        `skip_self` one copy of the query itself does not count.
        """
        found = self._found(queries, k + 1 if skip_self else k, skip_self)
        w = Window.partitionBy("qid").orderBy("dist", "pid")
        before = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (
            found.withColumn("_before", before)
            .filter(F.col("_before") < k)
            .select("qid", "pid", "dist", F.least("weight", F.lit(k) - F.col("_before")).alias("weight"))
        )


@dataclass
class ProjectionIndex(NeighborIndex):
    """Leaves of random-projection trees; `directions` (tree, level, dimension) and medians per tree, level and node."""

    directions: np.ndarray | None = None
    medians: list[list[np.ndarray]] | None = None
    chunks: int = 1

    @staticmethod
    def build(points: DataFrame, trees: int = _TREES, leaf_rows: int = _LEAF_ROWS, seed: int = 7) -> "ProjectionIndex":
        n = points.count()
        depth = int(np.clip(np.ceil(np.log2(max(n / leaf_rows, 1))), 0, _DEEPEST))
        chosen = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(_SAMPLE_ROWS).collect()
        sample = np.array([r["vec"] for r in chosen])
        directions = np.random.default_rng(seed).normal(size=(trees, depth, sample.shape[1]))
        medians = []
        for tree in range(trees):
            levels, code = [], np.zeros(len(sample), np.int64)
            for level in range(depth):
                along = sample @ directions[tree, level]
                cuts = np.array([np.median(along[code == node]) if (code == node).any() else 0.0 for node in range(1 << level)])
                levels.append(cuts)
                code = 2 * code + (along > cuts[code])
            medians.append(levels)
        chunks = max(1, -(-n // (leaf_rows << depth)))
        index = ProjectionIndex(points, sample[:1], pd.DataFrame(), directions, medians, chunks)
        own = F.explode(index._leaves()).alias("_leaf")
        placed = points.select("pid", "vec", "weight", own)
        block = (F.col("_leaf") * chunks + F.pmod(F.xxhash64("pid"), F.lit(chunks))).cast("int")
        index.points = durable(placed.select(block.alias("block"), "pid", "vec", "weight"))
        return index

    def _leaves(self) -> Column:
        directions, medians = self.directions, self.medians

        @F.pandas_udf("array<int>")
        def udf(vec: pd.Series) -> pd.Series:
            if not len(vec):
                return pd.Series([], dtype=object)
            x = np.vstack(vec.to_numpy())
            out = []
            for tree, levels in enumerate(medians):
                code = np.zeros(len(x), np.int64)
                for level, cuts in enumerate(levels):
                    code = 2 * code + (x @ directions[tree, level] > cuts[code])
                out.append(code + (tree << len(levels)))
            return pd.Series([*np.stack(out, axis=1).astype(np.int32)])

        return udf(F.col("vec"))

    def _route(self, need: int) -> Column:
        chunks = self.chunks
        return F.flatten(F.transform(self._leaves(), lambda leaf: F.sequence(leaf * chunks, leaf * chunks + (chunks - 1))))

    def _found(self, queries: DataFrame, need: int, skip_self: bool) -> DataFrame:
        visits = durable(
            queries.select("qid", "vec", F.explode(self._route(need)).alias("block"))
        )
        # A block that many queries visit is copied to several tasks.
        load = visits.groupBy("block").agg(
            F.ceil(F.count(F.lit(1)) / _QUERY_ROWS).cast("int").alias("_parts")
        )
        left = lookup_join(visits, load, ["block"], "inner").withColumn(
            "part", F.pmod(F.xxhash64("qid"), F.col("_parts").cast("bigint"))
        )
        right = lookup_join(self.points, load, ["block"], "inner").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts").cast("bigint") - 1))
        )

        def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            cols = {"qid": [], "pid": [], "dist": [], "weight": []}
            if len(q) and len(p):
                p = p.sort_values("pid", kind="stable")
                d = _distances(np.vstack(q["vec"].to_numpy()), np.vstack(p["vec"].to_numpy()))
                pid, weight = p["pid"].to_numpy(), p["weight"].to_numpy()
                top = min(need, d.shape[1])
                for qid, row in zip(q["qid"].to_numpy(), d):
                    limit = np.partition(row, top - 1)[top - 1]
                    near = np.flatnonzero(row <= limit)
                    near = near[np.argsort(row[near], kind="stable")][:need]
                    w = weight[near].astype(np.int64)
                    if skip_self:
                        w = w - (pid[near] == qid)
                    cols["qid"].append(np.full(len(near), qid))
                    cols["pid"].append(pid[near])
                    cols["dist"].append(row[near])
                    cols["weight"].append(w)
            return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in cols.items()})

        id_type = dict(self.points.dtypes)["pid"]
        found = (
            left.select("qid", "vec", F.col("block").alias("_lb"), F.col("part").alias("_lp"))
            .groupBy("_lb", "_lp")
            .cogroup(
                right.select("pid", "vec", "weight", F.col("block").alias("_rb"), F.col("part").alias("_rp")).groupBy(
                    "_rb", "_rp"
                )
            )
            .applyInPandas(search, f"qid {id_type}, pid {id_type}, dist double, weight bigint")
            .filter("weight > 0")
        )
        return found.dropDuplicates(["qid", "pid"])


def _index(points: DataFrame, method: str) -> NeighborIndex:
    if method not in ("exact", "lsh"):
        raise ValueError(f"method must be exact or lsh, not {method}")
    return NeighborIndex.build(points) if method == "exact" else ProjectionIndex.build(points)


@dataclass
class LocalOutlierFactor:
    """`table` holds pid, vec, weight, k-distance and density of the training points."""

    table: DataFrame
    k: int
    offset: float
    method: str = "exact"
    _index: NeighborIndex | None = None

    @staticmethod
    def fit(
        df: DataFrame, id_col: str, features: str = "features", k: int = 20, contamination: float = 0.02, method: str = "exact"
    ) -> "LocalOutlierFactor":
        """`method="lsh"` compares points only within leaves of random-projection trees; `k` should stay far below 2,048."""
        points = durable(distinct_points(df, id_col, features))
        n = points.agg(F.sum("weight")).first()[0]
        k = int(max(1, min(k, n - 1)))
        index = _index(points, method)
        own = durable(index.nearest(points.select(F.col("pid").alias("qid"), "vec"), k, skip_self=True))
        kdist = own.groupBy(F.col("qid").alias("pid")).agg(F.max("dist").alias("kdist"))
        density = _density(lookup_join(own, kdist, ["pid"], "inner"), k)
        dense = density.withColumnRenamed("qid", "pid")
        table = durable(points.join(kdist, "pid").join(dense, "pid"))
        factors = _factor(own, table, density, k)
        weighted = factors.join(points.select(F.col("pid").alias("qid"), "weight"), "qid")
        cut = exact_quantiles(
            weighted.select((-F.col("lof")).alias("s"), "weight"), "s", {"offset": contamination}, weight="weight"
        )
        offset = cut.first()["offset"]
        return LocalOutlierFactor(table, k, float(offset), method, index)

    def score(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        """Add `lof` and `lof_decision` (negative: outlier) to new rows."""
        index = self._index or _index(self.table.select("pid", "vec", "weight"), self.method)
        self._index = index
        queries = durable(
            distinct_points(df.where(F.forall(F.col(features).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v))), id_col, features).select(F.col("pid").alias("qid"), "vec")
        )
        near = durable(index.nearest(queries, self.k))
        reach = lookup_join(near, self.table.select("pid", "kdist"), ["pid"], "inner")
        factors = _factor(near, self.table, _density(reach, self.k), self.k)
        by_vec = queries.join(factors, "qid").select("vec", "lof")
        rows = df.withColumn("vec", F.col(features).cast("array<double>"))
        out = lookup_join(rows, by_vec, ["vec"], "left")
        return out.select(*df.columns, "lof", (-F.col("lof") - F.lit(self.offset)).alias("lof_decision"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/points")
        meta = [(self.k, self.offset, self.method)]
        spark.createDataFrame(meta, "k int, offset double, method string").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LocalOutlierFactor":
        meta = spark.read.parquet(f"{path}/meta").first()
        return LocalOutlierFactor(spark.read.parquet(f"{path}/points"), meta["k"], meta["offset"], meta["method"])


def _density(near: DataFrame, k: int) -> DataFrame:
    """Local reachability density of each query from its neighbours with k-distances."""
    reach = F.greatest("dist", "kdist") * F.col("weight")
    return near.groupBy("qid").agg((1.0 / (F.sum(reach) / k + 1e-10)).alias("lrd"))


def _factor(near: DataFrame, table: DataFrame, density: DataFrame, k: int) -> DataFrame:
    theirs = lookup_join(near, table.select("pid", F.col("lrd").alias("_lrd")), ["pid"], "inner")
    mean = theirs.groupBy("qid").agg((F.sum(F.col("_lrd") * F.col("weight")) / k).alias("_mean"))
    return mean.join(density, "qid").select("qid", (F.col("_mean") / F.col("lrd")).alias("lof"))
