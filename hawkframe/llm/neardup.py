"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Texts with equal shingle sets are one class. Each tree sorts the classes by its own order of the signature's values;
classes that agree in the first DEPTH values form a region, and a class's candidates are its neighbours in the sorted
region, which share the longest prefixes with it. A region that outgrows REGION_ROWS is cut deeper, at twice the
depth, and beyond that into chunks; the first class of each piece is also paired with the region's first, so no piece is
cut off. Candidates are weighed by signature, then confirmed exactly: first each class's best partners, then
every candidate that still joins two components. Pairs within a component cannot change the result.

Neighbours do not cover a region of more than NEIGHBOURS + 1 classes. Where such a region (by the first DEPTH values
alone) still holds several components, its classes meet all others of their kind through the rarest shingles of their
full sets: every pair at the limit shares one, whatever its place in the regions.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, lowered, map_batches
from hawkframe.llm.components import components, counted, linked

SHINGLE = 5
TREES, DEPTH = 24, 4
HASHES = TREES * DEPTH
PERCENT = 75
# A pair at the limit agrees in 75 % of the values on average, with a deviation of 4.4 %.
LEAST_AGREEMENT = 0.57
NEIGHBOURS = 3
BEST = 2
REGION_ROWS = 4096
# Shingles are ordered by the counts of so many buckets; any order gives all pairs, a true one fewer candidates.
BUCKET_BITS = 20
_RNG = np.random.default_rng(2024)
FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles: 5 words each; fewer words are one shingle, none are none."""
    words = lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([known[x] for x in words], np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, len(w) if len(w) < SHINGLE else SHINGLE, np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h = (h ^ (h >> np.uint64(31))) * MIX + w[i : i + n] * WEIGHTS[i]
    h = (h ^ (h >> np.uint64(29))) * MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[i : i + 1024, None] * FACTORS[None, :]).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _fresh(known: _Hashes) -> _Hashes:
    """Keep the word table of a task bounded."""
    if len(known) > 300_000:
        known.clear()
    return known


def document_sets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, node (id of its set; null without words) and signature."""
    known = _Hashes()

    def run(columns):
        out = {"doc_id": columns["doc_id"], "text_hash": columns["text_hash"], "n_shingles": [], "node": [], "signature": []}
        for text in columns["text"]:
            s = shingle_hashes(text, _fresh(known))
            out["n_shingles"].append(len(s))
            out["node"].append(_set_id(s) if len(s) else None)
            out["signature"].append(signature(s).tobytes() if len(s) else None)
        return out

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, signature binary")


def forest(classes: DataFrame) -> DataFrame:
    """One row per class and tree: `key` (the first DEPTH values), `o1`, `o2` (the next four, in order) and node."""

    def run(columns):
        if not columns["node"]:
            return {"key": [], "o1": [], "o2": [], "node": []}
        sig = np.frombuffer(b"".join(columns["signature"]), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        keys, first, second = [], [], []
        for t in range(TREES):
            v = np.roll(sig, -t * DEPTH, axis=1)
            h = np.full(len(v), t + 1, np.uint64)
            for i in range(DEPTH):
                h = (h ^ (h >> np.uint64(32))) * MIX + v[:, i]
            keys.append((h ^ (h >> np.uint64(29))) * MIX)
            first.append((v[:, DEPTH] << np.uint64(32)) | v[:, DEPTH + 1])
            second.append((v[:, DEPTH + 2] << np.uint64(32)) | v[:, DEPTH + 3])
        flat = {n: np.concatenate(x).view(np.int64) for n, x in (("key", keys), ("o1", first), ("o2", second))}
        return {**flat, "node": columns["node"] * TREES}

    return map_batches(classes.select("node", "signature"), run, "key long, o1 long, o2 long, node binary")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different pairs (a < b) of neighbours in the sorted regions of all trees, and (key, node) of the regions that have further pairs."""
    rows = forest(classes)
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_hub")).where(F.col("_n") > REGION_ROWS)
    large = durable(large.withColumnRenamed("key", "_key"))
    split = rows.join(large, rows["key"] == large["_key"], "left").withColumn("deep", F.xxhash64("key", "o1", "o2"))
    deeper = split.where(F.col("_hub").isNotNull())
    sizes = deeper.groupBy(F.col("deep").alias("_deep")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > REGION_ROWS)
    deeper = deeper.join(sizes, F.col("deep") == F.col("_deep"), "left")
    chunk = F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("_m") / REGION_ROWS), F.lit(1)))
    deeper = deeper.withColumn("region", F.xxhash64("deep", chunk))
    hubs = deeper.groupBy("region").agg(F.min("node").alias("x"), F.min("_hub").alias("y")).select("x", "y")
    sized = F.count(F.lit(1)).over(Window.partitionBy("region")) > NEIGHBOURS + 1
    regions = split.where(F.col("_hub").isNull()).select(F.col("key").alias("region"), "key", "o1", "o2", "node", F.lit(False).alias("large"))
    regions = regions.unionByName(deeper.select("region", "key", "o1", "o2", "node", F.lit(True).alias("large")))
    order = Window.partitionBy("region").orderBy("o1", "o2", "node")
    ys = F.array(*[F.lag("node", i).over(order) for i in range(1, NEIGHBOURS + 1)])
    near = regions.select("key", F.col("node").alias("x"), ys.alias("ys"), (F.col("large") | sized).alias("crowded"))
    # A row without y says that the region of x is crowded.
    ys = F.concat(F.filter("ys", lambda y: y.isNotNull()), F.when(F.col("crowded"), F.array(F.lit(None).cast("binary"))).otherwise(F.array().cast("array<binary>")))
    found = durable(near.select("key", "x", F.explode(ys).alias("y")))
    pairs = found.select("x", "y").where(F.col("y").isNotNull()).unionByName(hubs)
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs, found.where(F.col("y").isNull()).select("key", F.col("x").alias("node"))


def weighed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs with `agreement`, the share of equal signature values; sizes too different for a link and low agreement leave."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("signature").alias(f"s{s}"), F.col("n_shingles").alias(f"n{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)

    def run(columns):
        if not columns["a"]:
            return {"a": [], "b": [], "agreement": []}
        x, y = (np.frombuffer(b"".join(columns[c]), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
        return {"a": columns["a"], "b": columns["b"], "agreement": (x == y).mean(axis=1)}

    return map_batches(both.select("a", "b", "sa", "sb"), run, "a binary, b binary, agreement double").where(F.col("agreement") >= LEAST_AGREEMENT)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted classes (node, rep), from the text of each class's representative document."""
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"]))
    known = _Hashes()

    def run(columns):
        out = {"node": [], "set": []}
        for text, node in zip(columns["text"], columns["node"], strict=True):
            s = shingle_hashes(text, _fresh(known))
            # Rows that share an id need not share a text.
            if len(s) and _set_id(s) == node:
                out["node"].append(node)
                out["set"].append(s.tobytes())
        return out

    return map_batches(texts.select("text", "node"), run, "node binary, set binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the limit: 100 * intersection >= 75 * union."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"s{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(columns):
        out = {"a": [], "b": []}
        for a, b, x, y in zip(columns["a"], columns["b"], columns["sa"], columns["sb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(x, y)
            shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_batches(both.select("a", "b", "sa", "sb"), run, "a binary, b binary")


def unsettled(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the classes in crowded regions of more than one component; a class without links is its own."""
    own = crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = own.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("key")
    return own.join(mixed, "key", "left_semi").select("node", "label").distinct()


def rare_partners(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components, among them every pair of the sets that reaches the limit.

    With the shingles of all sets in one order, rare ones first, the longer set of such a pair (y at a tie of x and y, x < y) has a
    shingle of its first n - ceil(3n / 4) + 1 among the first m - ceil(6m / 7) + 1 of the shorter; after the first such shingle, both have
    the whole required intersection left. Per shingle, the most frequent component is not paired with itself.
    """
    shift = np.uint64(64 - BUCKET_BITS)

    def count(columns):
        every = np.frombuffer(b"".join(columns["set"]), np.uint64)
        counts = np.bincount((every >> shift).astype(np.int64), minlength=1)
        used = np.flatnonzero(counts)
        return {"bucket": used, "n": counts[used]}

    met = map_batches(sets.select("set"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[met["bucket"].to_numpy()] = met["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def heads(columns):
        out = {"token": [], "at": [], "n": [], "node": [], "label": []}
        for node, label, s in zip(columns["node"], columns["label"], columns["set"], strict=True):
            s = np.frombuffer(s, np.uint64)
            n = len(s)
            first = s[np.lexsort((s, shared.value[(s >> shift).astype(np.int64)]))][: n - -(-PERCENT * n // 100) + 1]
            out["token"] += first.view(np.int64).tolist()
            out["at"] += range(len(first))
            for name, value in (("n", n), ("node", node), ("label", label)):
                out[name] += [value] * len(first)
        return out

    rows = durable(map_batches(sets.join(labels, "node"), heads, "token long, at int, n long, node binary, label binary"))
    kinds = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("_n"))
    kinds = kinds.groupBy("token").agg(F.max_by("label", F.struct("_n", "label")).alias("_main"), F.count(F.lit(1)).alias("_kinds"))
    kinds = durable(kinds.where("_kinds > 1").select("token", "_main"))
    rows = rows.join(kinds, "token")
    side = lambda df, s: df.select("token", *[F.col(c).alias(f"{c}{s}") for c in ("at", "n", "node", "label", "_main")])
    x, y = side(rows.where(F.col("label") != F.col("_main")), "x"), side(rows, "y")
    least = F.ceil((F.col("nx") + F.col("ny")) * PERCENT / F.lit(100 + PERCENT) - 1e-9)
    before = F.struct("nx", "nodex") < F.struct("ny", "nodey")
    short = lambda s: F.col(f"at{s}") <= F.col(f"n{s}") - F.ceil(F.col(f"n{s}") * 2 * PERCENT / F.lit(100 + PERCENT) - 1e-9)
    fits = (F.col("labelx") != F.col("labely")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * PERCENT)
    fits = fits & F.when(before, short("x")).otherwise(short("y")) & (F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) >= least)
    # Where neither is of the main component the pair comes from both sides.
    met = x.join(y, "token").where(fits)
    return met.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, and (node, rep, label) of their classes: the class's smallest id and its component."""
    every = durable(document_sets(docs))
    classes = durable(every.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")))
    near, crowded = candidates(classes)
    pairs = durable(weighed(near, classes))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = durable(full_sets(docs, classes.select("node", "rep").join(ends, "node", "left_semi")))
    both = pairs.select(F.col("a").alias("x"), "a", "b", "agreement").union(pairs.select(F.col("b").alias("x"), "a", "b", "agreement"))
    nth = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("agreement"), "a", "b"))
    best = both.withColumn("_n", nth).where(F.col("_n") <= BEST).select("a", "b").distinct()
    labels = components(durable(confirmed(best, sets)))
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
    rest = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).select("a", "b")
    # Further links change the labels only where they join two components.
    labels = linked(labels, confirmed(rest, sets))
    open_, crowd = counted(unsettled(crowded, labels), "true")
    if crowd:
        sets = durable(full_sets(docs, classes.select("node", "rep").join(open_, "node", "left_semi")))
        labels = linked(labels, confirmed(durable(rare_partners(sets, open_)), sets))
    return every, classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id of its group) and kept (it is that document).

    Null and empty texts, and texts without words, have the empty set and stand alone, under their own id. Rows with a null id may link
    others but give no component its name; a group of only such rows has a null component_id and is kept. Repeated rows with the
    smallest id are all kept. An empty table gives no rows.
    """
    every, named = grouped(docs)
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(names, "label").select("node", "component_id")
    out = every.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the smallest id, then the smallest text hash; of rows equal in
    both, any one. Documents without words stand alone and all stay.
    """
    every, named = grouped(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keepers = every.join(named.select("node", "label"), "node").groupBy("label").agg(F.min(first).alias("k"))
    keepers = keepers.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # The row rides along as one value, so that no column of it can clash with those of the join.
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    rows = docs.where(~wordless).select(whole.alias("_row"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    kept = rows.join(keepers, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    kept = kept.dropDuplicates(["_id", "_hash"]).select("_row.*")
    return kept.union(docs.where(wordless))
