"""Exact removal of repeated 50-byte strings by blockwise suffix sorting with a difference cover.

Two suffixes matter to each other only if they agree in LENGTH bytes, so a suffix is its first LENGTH bytes and
its order that of their fingerprints. Texts are laid end to end in the order of doc_id and cut into groups.

1. Cover sample: positions p with p mod 31 in a difference cover. Whatever the alignment of two suffixes, within 31
   steps both meet a sampled position, so equal suffixes share a sampled string of LENGTH - 30 bytes. The sample is
   sorted bucket by bucket; a group gets one bit for each of its strings: does it occur elsewhere.
2. Suffixes without such a string in reach cannot tie with any other and are not sorted at all; a bitmap per group
   says which ones can. Only these are read again.
3. They go to buckets of fingerprints, and one bucket at a time is sorted. Groups are in document order, so
   a suffix is a repeat if an earlier group has it; again the answer is one bit.
4. Each group marks its repeated suffixes and drops the bytes under them.

Buckets get each different string once per group, compressed as differences, so neither a passage that a third of all
texts share nor a frequent string makes one large.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, ensure_checkpoint_dir, map_batches, running_sum, text_partitions

LENGTH = 50
PERIOD = 31
# A difference cover modulo 31 (a perfect difference set): every residue is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)
SAMPLED = LENGTH - PERIOD + 1
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
# Strings that are fingerprinted at once.
RUN = 1 << 18
MUL = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the strings of `length` bytes at some places; `words` are the 8 bytes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for first in range(0, len(at), RUN):
        h, some = out[first : first + RUN], at[first : first + RUN]
        for offset in (*range(0, length - 7, 8), length - 8):
            h *= MUL
            h ^= h >> np.uint64(29)
            h += words[some + offset]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return out


def spread(flags: np.ndarray, length: int) -> np.ndarray:
    """Set each flag that has a set one among the last `length` ones, itself included."""
    flags, reach = flags.copy(), 1
    while reach < length:
        step = min(reach, length - reach)
        flags[step:] |= flags[:-step]
        reach += step
    return flags


class Group:
    """Texts laid end to end."""

    def __init__(self, ids: list[int], sizes: list[int], packed: bytes):
        import zstandard

        self.ids, self.sizes = ids, np.array(sizes, np.int64)
        data = zstandard.ZstdDecompressor().decompress(packed) if self.sizes.sum() else b""
        size = len(data)
        data += bytes(8)
        self.data = np.frombuffer(data, np.uint8)[:size]
        # One word at each byte; no string asked for reaches into the padding.
        self.words = np.ndarray((size + 1,), "<u8", data, 0, (1,))
        self.ends = np.cumsum(self.sizes)
        self.rank = np.cumsum(np.r_[0, np.diff(np.array(ids)) != 0][: len(ids)]).astype(np.int32)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The different ids numbered in order: that of the text at each place (in order)."""
        begin = np.searchsorted(at, np.r_[0, self.ends])
        return np.repeat(self.rank, np.diff(begin))

    def inside(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those of the places (in order) whose strings end within their text."""
        begin = np.searchsorted(at, np.r_[0, self.ends])
        return at[at <= np.repeat(self.ends - length, np.diff(begin))]

    def sample(self) -> np.ndarray:
        """Places of the cover sample."""
        at = (np.arange(0, len(self.data), PERIOD)[:, None] + np.array(COVER)).ravel()
        return self.inside(at[at < len(self.data)], SAMPLED)

    def keys(self, at: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings at these places: the different keys in order, the number of each string's key among them,
        and the smallest and the largest owner of each key."""
        key = fingerprints(self.words, at, length) >> np.uint64(64 - bits)
        if not len(key):
            return key, *(np.zeros(0, np.int32) for _ in range(3))
        order = np.argsort(key).astype(np.int32)
        ranked = key[order]
        del key
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        first = np.flatnonzero(new).astype(np.int32)
        ranked = ranked[first]
        which = np.empty(len(order), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        who = self.owner(at)[order]
        return ranked, which, np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Bitmap of the suffixes that have one of these places within PERIOD steps."""
        near = np.zeros(len(self.data), bool)
        near[shared] = True
        return np.packbits(spread(near[::-1], PERIOD)[::-1])

    def starts(self, bitmap: bytes) -> np.ndarray:
        """Places of the suffixes of a bitmap that have LENGTH bytes in their text."""
        return self.inside(np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(self.data))), LENGTH)

    def removed(self, starts: np.ndarray) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
        """Per text: bytes, removed bytes, SHA-256 of the rest, and removed runs as [first, last)."""
        gone = np.zeros(len(self.data), bool)
        gone[starts] = True
        gone = spread(gone, LENGTH)
        out = []
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            own = gone[end - size : end]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            rest = self.data[end - size : end][~own] if len(edge) else self.data[end - size : end]
            out.append((size, int((edge[1::2] - edge[::2]).sum()), hashlib.sha256(rest).hexdigest(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
        return out


def _packed(keys: np.ndarray) -> bytes:
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _parts(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each bucket (an equal range of keys) begins among sorted keys."""
    edges = np.array([i * (1 << bits) // parts for i in range(parts)], np.uint64)
    return [*np.searchsorted(keys, edges).tolist(), len(keys)]


def _sent(g: int, keys: np.ndarray, bits: int, parts: int) -> dict[str, list]:
    at = _parts(keys, bits, parts)
    out = {"g": [], "part": [], "keys": []}
    for p, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        if b > a:
            out["g"].append(g)
            out["part"].append(p)
            out["keys"].append(_packed(keys[a:b]))
    return out


def _answers(sent: DataFrame, earlier: bool) -> DataFrame:
    """Sort one bucket at a time; per group of it, a bit for each key: do others (or earlier ones only) have it."""
    import pyarrow as pa

    def sort(bucket: pa.Table) -> pa.Table:
        rows = sorted(zip(bucket["g"].to_pylist(), bucket["keys"].to_pylist(), strict=True))
        lists = [_unpacked(k) for _, k in rows]
        sizes = [len(k) for k in lists]
        keys = np.concatenate(lists)
        lists.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = np.r_[False, keys[1:] == keys[:-1]]
        bit = np.zeros(len(keys), bool)
        bit[order] = same if earlier else same | np.r_[same[1:], False]
        cut = np.split(bit, np.cumsum(sizes)[:-1])
        part = bucket["part"][0].as_py()
        return pa.table({"g": pa.array([g for g, _ in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "bits": pa.array([np.packbits(c).tobytes() for c in cut], pa.binary())})

    made = durable(sent.groupBy("part").applyInArrow(sort, "g long, part long, bits binary"))
    return made.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("answer"))


def _bits(answer: list[dict] | None, keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    at, out = _parts(keys, bits, parts), np.zeros(len(keys), bool)
    for a in answer or []:
        p = a["part"]
        out[at[p] : at[p + 1]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=at[p + 1] - at[p]).astype(bool)
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write `df` to the shared folder as a table bucketed by `key`, so that joins on it leave these rows where they are."""
    spark = df.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").bucketBy(text_partitions(df), key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def grouped_texts(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per group of consecutive ids: g, ids, sizes, and the compressed texts end to end."""
    import pyarrow as pa

    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("_size"))
    place = running_sum(sizes, ["doc_id"], "_size", "_before").select(F.col("doc_id").alias("_id"), F.floor(F.col("_before") / group_bytes).alias("g"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")).join(place, F.col("doc_id") == F.col("_id")).select("g", "doc_id", "data")

    def lay(table: pa.Table) -> pa.Table:
        import zstandard

        table = table.sort_by("doc_id")
        texts = table["data"].to_pylist()
        return pa.table(
            {
                "g": pa.array([table["g"][0].as_py()], pa.int64()),
                "ids": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                "packed": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
            }
        )

    return bucketed(rows.groupBy("g").applyInArrow(lay, "g long, ids array<long>, sizes array<long>, packed binary"), "g")


def repeated_spans(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, kept_sha256 and spans (removed runs as [first, last) bytes).

    Removed is each byte under a LENGTH-byte string that also starts in a document with a smaller id, by the
    texts as given. Null texts are empty. Rows that share an id are one document to the others and take nothing from each
    other. Rows without id keep all their bytes and remove none. Ids must be whole numbers. An empty table gives no rows.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BUCKET_BYTES))
    # A sampled string may be taken for another now and then, which costs a sort and no error; suffixes have all 64 bits.
    cover_bits = min(64, max(24, total.bit_length() + 6))
    bits = 64
    groups = grouped_texts(named, group_bytes)

    def load(columns, i):
        return Group(columns["ids"][i], columns["sizes"][i], columns["packed"][i])

    def send_cover(columns):
        for i, g in enumerate(columns["g"]):
            group = load(columns, i)
            yield _sent(g, group.keys(group.sample(), SAMPLED, cover_bits)[0], cover_bits, parts)

    sent = "g long, part long, keys binary"
    first = _answers(map_batches(groups, send_cover, sent), earlier=False)

    def mark(columns):
        import zstandard

        for i, g in enumerate(columns["g"]):
            group = load(columns, i)
            at = group.sample()
            keys, which, low, high = group.keys(at, SAMPLED, cover_bits)
            shared = (low < high) | _bits(columns["answer"][i], keys, cover_bits, parts)
            yield {"g": [g], "bitmap": [zstandard.ZstdCompressor(level=1).compress(group.candidates(at[shared[which]]))]}

    bitmaps = durable(map_batches(groups.join(first, "g", "left"), mark, "g long, bitmap binary"))
    marked = groups.join(bitmaps, "g")

    def suffixes(columns, i):
        import zstandard

        group = load(columns, i)
        start = group.starts(zstandard.ZstdDecompressor().decompress(columns["bitmap"][i]) if len(group.data) else b"")
        return group, start, *group.keys(start, LENGTH, bits)

    def send_suffixes(columns):
        for i, g in enumerate(columns["g"]):
            yield _sent(g, suffixes(columns, i)[2], bits, parts)

    second = _answers(map_batches(marked, send_suffixes, sent), earlier=True)

    def cut(columns):
        for i in range(len(columns["g"])):
            group, start, keys, which, low, _ = suffixes(columns, i)
            gone = (group.owner(start) > low[which]) | _bits(columns["late"][i], keys, bits, parts)[which]
            made = group.removed(start[gone])
            yield {
                "doc_id": group.ids,
                "n_bytes": [m[0] for m in made],
                "n_removed": [m[1] for m in made],
                "kept_sha256": [m[2] for m in made],
                "spans": [[{"first": a, "last": b} for a, b in m[3]] for m in made],
            }

    out = "doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<first: long, last: long>>"
    found = map_batches(marked.join(second.withColumnRenamed("answer", "late"), "g", "left"), cut, out)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    unnamed = docs.where(F.col("doc_id").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.sha2(text, 256).alias("kept_sha256"),
        F.array().cast("array<struct<first: long, last: long>>").alias("spans"),
    )
    return found.unionByName(unnamed)


def dedup_report(docs: DataFrame) -> DataFrame:
    spans = repeated_spans(docs)
    return spans.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
