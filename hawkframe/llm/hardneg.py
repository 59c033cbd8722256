"""Hard negatives for anchor rows, by lists that the anchors of a cluster share.

Anchors are clustered by direction. For each cluster every row gets an upper bound of its inner product with any member
of length one: its length times the cosine of its angle to the centre less the cluster's widest angle. The rows
sorted by this bound are the cluster's list; it is written once, in segments and in contiguous chunks. Members walk it from
the top, segment by segment, and each stops for good as soon as the bound of the next row, times its own length, is
below the worst score that could still enter its answer. That is certain, so answers are exact; a weak bound only
costs a longer walk. One walk finds the positives, a second one the negatives inside the positives' bands.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, map_batches

ANCHOR_STEP = 100
FIRST = 5
# Bounds: anchors the centres and rows the segment bounds are fitted on, lists, members and rows that meet in one task.
FIT_ROWS = 8192
LISTS = 8
LEAST_MEMBERS = 32
MEMBER_ROWS = 1024
CHUNK_ROWS = 16_384
# Shares of a list that its segments but the last cover.
SHARES = (1 / 32, 1 / 4)
STRIDE = 1024
# Added to each cosine, over and above any rounding of angles.
SLACK = 1e-6
NO_LIMIT = (1 << 63) - 1


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(lengths(x), 1e-300)[:, None]


def stacked(vectors: list[bytes], kind: np.dtype, width: int) -> np.ndarray:
    """Vectors kept as bytes, one below the other."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), width)


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each row to each centre; a zero row has none with any of them."""
    found = np.arccos(np.clip(directions(x) @ centres.T, -1.0, 1.0))
    return np.where(lengths(x)[:, None] > 0, found, 0.0)


def fit_centres(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    u = directions(x[lengths(x) > 0])
    if not len(u):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 1))
    centres = u[np.random.default_rng(seed).permutation(len(u))[:k]]
    for _ in range(10):
        best = (u @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, u)
        size = lengths(sums)[:, None]
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def bounds(x: np.ndarray, centres: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """Upper bound of each row's inner product with any unit vector of each cluster."""
    return lengths(x)[:, None] * (np.cos(np.maximum(angles(x, centres) - widest, 0.0)) + SLACK)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point as long as that has the digits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


def walk(members: dict, rows: dict, same_label: bool, k: int, stride: int = STRIDE) -> list[tuple[int, int, int, int]]:
    """(member, band, score, vec_id): the best `k` of `rows` for each band of each member, as far as they may matter.

    `members`: row, vec_id, label, q, and bands, a list of (low, high, floor): scores wanted, and the score from which on a
    row may still enter. `rows`: vec_id, label, q and bound, in any order.
    """
    order = np.lexsort((rows["vec_id"], -rows["bound"]))
    bound, ids, labels, x = (rows[c][order] for c in ("bound", "vec_id", "label", "q"))
    size = lengths(members["q"])
    best: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.int64),) * 2 for _ in bands] for bands in members["bands"]]
    floors = [[max(low, floor) for low, _, floor in bands] for bands in members["bands"]]
    for start in range(0, len(bound), stride):
        going = [i for i, f in enumerate(floors) if f and size[i] * bound[start] >= min(f)]
        if not going:
            break
        part = slice(start, start + stride)
        scores = products(members["q"][going], x[part])
        fits = (members["label"][going][:, None] == labels[part][None, :]) == same_label
        fits &= members["vec_id"][going][:, None] != ids[part][None, :]
        for at, i in enumerate(going):
            for band, (_, high, _) in enumerate(members["bands"][i]):
                hits = np.flatnonzero(fits[at] & (scores[at] >= floors[i][band]) & (scores[at] <= high))
                if not len(hits):
                    continue
                s = np.concatenate([best[i][band][0], scores[at][hits]])
                v = np.concatenate([best[i][band][1], ids[part][hits]])
                top = np.lexsort((v, -s))[:k]
                best[i][band] = (s[top], v[top])
                if len(top) == k:
                    floors[i][band] = max(floors[i][band], int(s[top[-1]]))
    return [(int(members["row"][i]), band, int(s), int(v)) for i, bands in enumerate(best) for band, found in enumerate(bands) for s, v in zip(*found, strict=True)]


def usable_rows(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, q: whole components, shifted labels; row numbers are given once, as the table is written."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), e.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform("embedding", lambda v: F.floor(v * 256.0).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), q.alias("q")).distinct()
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


class Lists:
    """The clusters' lists: `members` (row, vec_id, label, q, cluster, block, size) and `entries` (cluster, segment, chunk, ...)."""

    def __init__(self, vectors: DataFrame, anchor_step: int = ANCHOR_STEP, lists: int = LISTS, chunk_rows: int = CHUNK_ROWS, member_rows: int = MEMBER_ROWS, shares: Sequence[float] = SHARES) -> None:
        rows = usable_rows(vectors)
        most = rows.agg(F.max(F.size("q")).alias("d"), F.max(F.array_max("q")).alias("high"), F.min(F.array_min("q")).alias("low"), F.count(F.lit(1)).alias("n")).first()
        self.width = width = max(most["d"] or 0, 1)
        largest = max(abs(most["high"] or 0), abs(most["low"] or 0))
        if largest * largest * width >= 1 << 63:
            raise ValueError("components too large: scores would pass 64 bits")
        self.kind = kind = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8")

        def encode(columns):
            made = np.zeros((len(columns["q"]), width), kind)
            for i, q in enumerate(columns["q"]):
                made[i, : len(q)] = q
            return {**columns, "q": [v.tobytes() for v in made]}

        rows = map_batches(rows.select("row", "vec_id", "label", "q"), encode, "row long, vec_id long, label long, q binary")
        anchors = rows.where(F.col("vec_id") % anchor_step == 0)
        shuffled = [F.xxhash64("row"), F.col("row")]
        sample = stacked([r["q"] for r in anchors.orderBy(*shuffled).limit(FIT_ROWS).select("q").collect()], kind, width)
        self.centres = centres = fit_centres(sample, max(1, min(lists, len(sample) // LEAST_MEMBERS)))
        k = len(centres)

        def join_cluster(columns):
            x = stacked(columns["q"], kind, width)
            angle = angles(x, centres)
            nearest = angle.argmin(1) if len(x) else np.zeros(0, int)
            return {**columns, "cluster": nearest.tolist(), "angle": angle[np.arange(len(x)), nearest].tolist(), "size": lengths(x).tolist()}

        members = durable(map_batches(anchors, join_cluster, "row long, vec_id long, label long, q binary, cluster int, angle double, size double"))
        known = {r["cluster"]: r for r in members.groupBy("cluster").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        widest = np.array([known[c]["widest"] if c in known else 0.0 for c in range(k)])
        self.blocks = {c: -(-known[c]["n"] // member_rows) for c in known}
        pick = F.coalesce(*[F.when(F.col("cluster") == c, n) for c, n in self.blocks.items()], F.lit(1))
        self.members = members.withColumn("block", F.pmod(F.xxhash64("row"), pick).cast("int"))
        sample = stacked([r["q"] for r in rows.orderBy(*shuffled).limit(FIT_ROWS).select("q").collect()], kind, width)
        # cuts[s][c]: the least bound of segment s of list c; the last segment has all the rest.
        fitted = bounds(sample, centres, widest) if len(sample) else np.zeros((1, k))
        self.cuts = cuts = [np.quantile(fitted, 1 - share, axis=0) for share in shares]

        def enlist(columns):
            x = stacked(columns["q"], kind, width)
            b = bounds(x, centres, widest)
            segment = sum((b < cut).astype(int) for cut in cuts) + np.zeros(b.shape, int)
            wanted = [c for c in range(k) if c in known]
            for c in wanted:
                yield {"cluster": [c] * len(x), "segment": segment[:, c].tolist(), "bound": b[:, c].tolist(), **{n: columns[n] for n in ("vec_id", "label", "q")}}

        entries = map_batches(rows, enlist, "cluster int, segment int, bound double, vec_id long, label long, q binary")
        chunks = max(1, -(-most["n"] * max(1, len(known)) // chunk_rows))
        in_order = ["segment", "cluster", F.desc("bound"), "vec_id"]
        listed = entries.repartitionByRange(chunks, *in_order).sortWithinPartitions(*in_order)
        self.entries = durable(listed.withColumn("chunk", F.spark_partition_id()))

    def next_bound(self, segment: int) -> F.Column:
        """Least upper bound that rows behind `segment` of a member's list have, per unit of its length."""
        return F.coalesce(*[F.when(F.col("cluster") == c, float(cut)) for c, cut in enumerate(self.cuts[segment])])


def best_in_bands(lists: Lists, wanted: DataFrame, same_label: bool, k: int) -> DataFrame:
    """row, band, score, vec_id: the `k` best rows per anchor and band, larger scores and then smaller ids first.

    `wanted` has row, band, low, high: the scores asked for. Anchors leave once nothing behind their place can enter.
    """
    wanted = durable(wanted.select("row", "band", "low", "high"))
    order = Window.partitionBy("row", "band").orderBy(F.desc("score"), "vec_id")
    best, kind, width = None, lists.kind, lists.width
    for segment in range(len(lists.cuts) + 1):
        asked = wanted.withColumn("floor", F.col("low"))
        if best is not None:
            full = best.groupBy("row", "band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") == k)
            asked = wanted.join(full, ["row", "band"], "left").withColumn("floor", F.greatest("low", F.coalesce("worst", "low")))
        bands = asked.groupBy("row").agg(F.min("floor").alias("needed"), F.array_sort(F.collect_list(F.struct("band", "low", "high", "floor"))).alias("bands"))
        going = lists.members.join(bands, "row")
        if segment:
            going = going.where(F.col("size") * lists.next_bound(segment - 1) >= F.col("needed"))
        going = durable(going.select("row", "vec_id", "label", "q", "cluster", "block", "bands"))
        if going.isEmpty():
            break
        rows = lists.entries.where(F.col("segment") == segment)
        places = rows.select("cluster", "chunk").distinct().toDF("cluster", "chunk")
        blocks = going.select("cluster", "block").distinct().toDF("cluster", "block")
        left = going.join(places, "cluster")
        right = rows.select("cluster", "chunk", "bound", "vec_id", "label", "q").join(blocks, "cluster")

        def meet(members, entries):
            import pyarrow as pa

            if not members.num_rows or not entries.num_rows:
                return _found([])
            asking = {c: members.column(c).to_numpy() for c in ("row", "vec_id", "label")}
            asking["q"] = stacked(members.column("q").to_pylist(), kind, width)
            asking["bands"] = [[(b["low"], b["high"], b["floor"]) for b in bands] for bands in members.column("bands").to_pylist()]
            names = [[b["band"] for b in bands] for bands in members.column("bands").to_pylist()]
            listed = {c: entries.column(c).to_numpy() for c in ("bound", "vec_id", "label")}
            listed["q"] = stacked(entries.column("q").to_pylist(), kind, width)
            at = {int(r): i for i, r in enumerate(asking["row"])}
            return _found([(row, names[at[row]][band], s, v) for row, band, s, v in walk(asking, listed, same_label, k)])

        keys = ("cluster", "block", "chunk")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "row long, band long, score long, vec_id long")
        found = found if best is None else found.unionByName(best)
        best = durable(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"))
    return best if best is not None else wanted.select("row", "band", F.col("low").alias("score"), F.lit(0).cast("long").alias("vec_id")).limit(0)


def _found(rows: list[tuple[int, int, int, int]]):
    import pyarrow as pa

    return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("row", "band", "score", "vec_id"))})


def hard_negatives(vectors: DataFrame, k: int = FIRST, **sizes: object) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding; further columns are ignored, whatever their names. Rows with a null id, label
    or vector, or a null or non-finite component take no part; an empty vector scores 0 with all; shorter vectors go on
    with zeros. Exactly repeated rows count once. Rows that share the anchor's id are neither its positives nor
    its negatives. Components so large that scores could pass 64 bits are an error. An empty table, or one without
    anchors, gives no rows.
    """
    lists = Lists(vectors, **sizes)
    zero = F.lit(0).cast("long")
    everything = lists.members.select("row", zero.alias("band"), F.lit(-NO_LIMIT).alias("low"), F.lit(NO_LIMIT).alias("high"))
    positives = best_in_bands(lists, everything, True, k).select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 80 p <= 100 n <= 100 p has no solution for p < 0; the least n is p less a fifth of p, rounded down.
    p = F.col("positive_score")
    bands = positives.where(p >= 0).select("row", p.alias("band"), (p - F.expr("positive_score div 5")).alias("low"), p.alias("high")).distinct()
    negatives = best_in_bands(lists, bands, False, k).select("row", F.col("band").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.join(negatives, ["row", "positive_score"]).join(lists.members.select("row", F.col("vec_id").alias("anchor_id")), "row")
    order = Window.partitionBy("row", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
