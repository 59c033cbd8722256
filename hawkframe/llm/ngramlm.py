"""Language-model scores from an n-gram trie in Elias-Fano levels.

Level 1 holds the word hashes with exact counts; a word's number is its place there. Level n holds the pairs
(place of the context in level n-1, word) as one monotone sequence, so the entries of a context stand together and a pair
is found by its whole key. Each n-gram has its smoothed log10 probability and its context's back-off
in a byte each. Levels are cut into files of contiguous keys in the shared folder and memory-mapped by the tasks.

P(w | c) = (count(c w) + MU P(w | shorter c)) / (count(c) + MU), and P(w) = (count(w) + 0.5) / (N + 0.5 (V + 1)).
Every text is preceded and followed by the end mark; the first one is context only.
"""

from __future__ import annotations

import dataclasses
import functools
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, ensure_checkpoint_dir, fold_of, lowered, map_batches
from hawkframe.llm.eliasfano import EliasFano, from_buffer, to_bytes

MU = 2.0
ORDER = 3
END = b""
# A byte stands for log10 values from 0 down in steps of STEP.
STEP = 0.045
# Tokens behind one file of a level, and bytes of text behind one file of level 1.
FILE_TOKENS = 4_000_000
FILE_TEXT_BYTES = 128 << 20
# Text that a task turns into numbers at once.
BATCH_BYTES = 8 << 20


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 255).astype(np.uint8)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def by_bytes(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[list[str | None]]:
    """Runs of texts of about `most` characters together; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens, all tokens as numbers of these (each text behind and before the end mark,
    which is number 0), and where each text's leading mark stands."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # Arrow splits bytes at \x20 and \x09 to \x0D, and numbers the words in order of first use.
    lines = pa.array([lowered(t) for t in texts], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(lines)
    n, words = np.diff(split.offsets.to_numpy()).astype(np.int64), split.flatten()
    # White space at the ends of a text leaves empty words.
    empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    if len(empty):
        n -= np.bincount(np.searchsorted(split.offsets.to_numpy(), empty, "right") - 1, minlength=len(n))
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    del lines, split
    coded = words.dictionary_encode()
    del words
    starts = np.cumsum(n + 2) - (n + 2)
    codes = np.zeros(int((n + 2).sum()), np.int64)
    codes[np.arange(len(coded)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = coded.indices.to_numpy() + 1
    different = coded.dictionary.view(pa.large_binary()).to_pylist()
    return np.fromiter(map(word_hash, [END, *different]), np.uint64, len(different) + 1), codes, starts


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte planes apart, and counts, both compressed."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    gaps = np.diff(keys, prepend=np.uint64(0))
    return z.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes()), z.compress(counts.astype(np.uint32).tobytes())


def _spread(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    planes = np.frombuffer(z.decompress(keys), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(z.decompress(counts), np.uint32)


@dataclasses.dataclass(frozen=True)
class Files:
    """One level: for each file its path, first key, base and first place. Keys of a file are stored less its base, which
    is where the context of its first key begins: a context may go on from one file to the next."""

    root: str
    paths: tuple[str, ...]
    first_key: np.ndarray
    base: np.ndarray
    first_place: np.ndarray
    size: int


@functools.lru_cache(maxsize=512)
def _mapped(root: str, path: str) -> tuple[EliasFano, list[np.ndarray]]:
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, _ = FileSystem.from_uri(root)
    if isinstance(fs, LocalFileSystem):
        buffer = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        with fs.open_input_file(path) as f:
            buffer = np.frombuffer(f.read_buffer(), np.uint8)
    arrays = from_buffer(buffer)
    return EliasFano.from_arrays(*arrays[:4]), arrays[4:]


def look_up(level: Files, keys: np.ndarray, columns: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Places of sorted keys (-1: not there) and the stored columns at them (0 where not there)."""
    place = np.full(len(keys), -1, np.int64)
    values: list = [None] * len(columns)
    if not len(level.paths):
        return [place, *[np.zeros(len(keys), np.int64) for _ in columns]]
    which = np.searchsorted(level.first_key, keys, "right") - 1
    for f in np.unique(which[which >= 0]).tolist():
        a, b = np.searchsorted(which, [f, f + 1])
        sequence, stored = _mapped(level.root, level.paths[f])
        # A key holds its context's place, so only an entry of that context equals it.
        found = sequence.find(keys[a:b] - level.base[f])
        hit = np.flatnonzero(found >= 0)
        place[a:b][hit] = found[hit] + level.first_place[f]
        for k, c in enumerate(columns):
            if values[k] is None:
                values[k] = np.zeros(len(keys), stored[c].dtype)
            values[k][a:b][hit] = stored[c][found[hit]]
    return [place, *[np.zeros(len(keys), np.int64) if v is None else v for v in values]]


def at_places(level: Files, places: np.ndarray, column: int | None) -> np.ndarray:
    """Stored column, or with None the keys, at places of a level, in any order."""
    out = np.zeros(len(places), np.uint64 if column is None else np.int64)
    which = np.searchsorted(level.first_place, places, "right") - 1
    for f in np.unique(which).tolist():
        rows = np.flatnonzero(which == f)
        sequence, stored = _mapped(level.root, level.paths[f])
        local = places[rows] - level.first_place[f]
        out[rows] = sequence.access(local) + level.base[f] if column is None else stored[column][local]
    return out


# Stored columns of level 1, and of the others.
COUNT_1, CHANCE, BACK, COUNT = 0, 0, 1, 2


@dataclasses.dataclass(frozen=True)
class Model:
    """Levels in order, N and V of the training tokens."""

    levels: tuple[Files, ...]
    tokens: int
    types: int

    @property
    def bits(self) -> int:
        """Bits of a word's number."""
        return max(1, self.types.bit_length())

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        place, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        place[order], count[order] = look_up(self.levels[0], hashes[order], (COUNT_1,))
        return place, count

    def step(self, context: np.ndarray, word: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the place of the context before it, and for tokens with known context and word
        (returned third) the key in level n."""
        before = np.concatenate([[-1], context[:-1]])
        before[starts] = -1
        asked = np.flatnonzero((before >= 0) & (word >= 0))
        return before, (before[asked].astype(np.uint64) << np.uint64(self.bits)) | word[asked].astype(np.uint64), asked

    def find(self, context: np.ndarray, word: np.ndarray, starts: np.ndarray, n: int, columns: tuple[int, ...] = ()):
        """Of each token: place of the context before it, place in level n (-1: none), and the bytes of the columns there."""
        before, key, asked = self.step(context, word, starts, n)
        unique, inverse = np.unique(key, return_inverse=True)
        found = look_up(self.levels[n - 1], unique, columns)
        out = [np.full(len(word), -1, np.int64), *[np.zeros(len(word), np.uint8) for _ in columns]]
        for full, part in zip(out, found, strict=True):
            full[asked] = part[inverse]
        return before, *out

    def suffix(self, n: int, place: np.ndarray) -> np.ndarray:
        """Place in level n-1 of the last n-1 words of the n-grams at these places."""
        key = at_places(self.levels[n - 1], place, None)
        word = key & np.uint64((1 << self.bits) - 1)
        if n == 2:
            return word.astype(np.int64)
        shorter = self.suffix(n - 1, (key >> np.uint64(self.bits)).astype(np.int64))
        key = (shorter.astype(np.uint64) << np.uint64(self.bits)) | word
        unique, inverse = np.unique(key, return_inverse=True)
        return look_up(self.levels[n - 2], unique)[0][inverse]

    def chances(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For n-grams of the next level: the probability with the context one word shorter, and the context's count."""
        n = len(self.levels) + 1
        if n == 2:
            return 10 ** self.unigram(at_places(self.levels[0], word, COUNT_1)), at_places(self.levels[0], context, COUNT_1)
        contexts, inverse = np.unique(context, return_inverse=True)
        above = at_places(self.levels[n - 2], contexts, COUNT)[inverse]
        key = (self.suffix(n - 1, contexts)[inverse].astype(np.uint64) << np.uint64(self.bits)) | word.astype(np.uint64)
        unique, inverse = np.unique(key, return_inverse=True)
        place, chance = look_up(self.levels[n - 2], unique, (CHANCE,))
        if (place < 0).any():
            raise LookupError(f"level {n - 1} lacks {int((place < 0).sum())} n-grams that end those of level {n}")
        return 10.0 ** (-STEP * chance[inverse]), above

    def score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, log10 probabilities under the words' shares and under the trie."""
        made = [self._score(part) for part in by_bytes(texts)]
        return {k: np.concatenate([m[k] for m in made]) if made else np.zeros(0) for k in ("n_tokens", "n_known", "base_score", "score")}

    def _score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        hashes, codes, starts = tokens(texts)
        place, count = self.words(hashes)
        word, count = place[codes], count[codes]
        base = self.unigram(count)
        base[starts] = 0
        full, context, back = base.copy(), word, np.log10(MU / (count + MU))
        for n in range(2, len(self.levels) + 1):
            before, context, chance, next_back = self.find(context, word, starts, n, (CHANCE, BACK))
            full = np.where(before >= 0, full + np.concatenate([[0.0], back[:-1]]), full)
            full = np.where(context >= 0, -STEP * chance, full)
            back = -STEP * next_back.astype(float)
        known = (count > 0).astype(np.int64)
        known[starts] = 0
        return {
            "n_tokens": np.diff(np.append(starts, len(codes))) - 1,
            "n_known": np.add.reduceat(known, starts),
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(full, starts),
        }


def _write(folder: str, arrays: list[np.ndarray]) -> str:
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/{uuid.uuid4().hex}.level"
    with fs.open_output_stream(path, compression=None) as out:
        out.write(to_bytes(arrays))
    return path


MANIFEST = "part long, path string, first long, base long, size long, total long, cuts array<struct<place: long, share: double>>"


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if counts.max() < 1 << 32 else counts


def _cuts(counts: np.ndarray, most: int) -> list[dict]:
    """Where the next level is cut into files of `most` tokens: places of contexts, and the share of the context before the cut."""
    running = np.cumsum(counts, dtype=np.int64)
    at = np.arange(most, int(running[-1]), most)
    place = np.searchsorted(running, at, "right")
    share = (at - (running[place] - counts[place])) / counts[place]
    return [{"place": int(p), "share": float(s)} for p, s in zip(place, share, strict=True)]


def _level(blobs: DataFrame, folder: str, bits: int, model: Model | None, file_tokens: int) -> DataFrame:
    """Merge the counted blobs of each part and write its file; one row per committed file.

    Parts are ranges of keys, so neither a frequent word nor a frequent context makes one large.
    """
    import pyarrow as pa

    def merge(table: pa.Table) -> pa.Table:
        pieces = [_spread(k, c) for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)]
        keys = np.concatenate([k for k, _ in pieces])
        counts = np.concatenate([c for _, c in pieces]).astype(np.int64)
        del pieces
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        base = (keys[0] >> np.uint64(bits)) << np.uint64(bits) if bits else keys[0]
        stored = [*EliasFano.of(keys - base).arrays()]
        if model is None:
            stored.append(_narrow(counts))
        else:
            context, word = (keys >> np.uint64(bits)).astype(np.int64), keys & np.uint64((1 << bits) - 1)
            lower, above = model.chances(context, word.astype(np.int64))
            chance = (counts + MU * lower) / (above + MU)
            stored += [quantised(np.log10(chance)), quantised(np.log10(MU / (counts + MU))), _narrow(counts)]
        row = {"part": int(table["part"][0].as_py()), "path": _write(folder, stored), "first": int(keys[0]), "base": int(base), "size": len(keys), "total": int(counts.sum()), "cuts": _cuts(counts, file_tokens)}
        return pa.Table.from_pylist([row], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(MANIFEST))
    return durable(blobs.groupBy("part").applyInArrow(merge, MANIFEST))


def _files(manifest: DataFrame, folder: str) -> tuple[Files, list, int]:
    """The level's files in order of keys; the committed rows are few (one per file)."""
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    sizes = [r["size"] for r in rows]
    places = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64) if rows else np.zeros(0, np.int64)
    firsts, bases = (np.array([r[c] for r in rows], np.uint64) for c in ("first", "base"))
    return Files(folder, tuple(r["path"] for r in rows), firsts, bases, places, sum(sizes)), rows, sum(r["total"] for r in rows)


def _blobs(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> dict[str, list]:
    out = {"part": [], "keys": [], "counts": []}
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(begin, np.append(begin, len(part))[1:], strict=False):
        k, c = _squeeze(keys[a:b], counts[a:b])
        out["part"].append(int(part[a]))
        out["keys"].append(k)
        out["counts"].append(c)
    return out


def train(texts: DataFrame, order: int = ORDER, file_tokens: int = FILE_TOKENS, file_text_bytes: int = FILE_TEXT_BYTES) -> Model:
    """Count all texts (column `text`; null counts as empty) and write the levels of the trie to the shared folder.

    Each task sends every part of a level one compressed block of its distinct keys with their counts, so
    a frequent word or context costs one entry per batch. Files are never changed once a manifest row names them.
    """
    spark = texts.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    root = root if ":/" in root else f"file://{root}"
    texts = texts.select("text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // file_text_bytes))

    def count_words(columns):
        for some in by_bytes(columns["text"]):
            hashes, codes, starts = tokens(some)
            counts = np.bincount(codes, minlength=len(hashes))
            counts[0] -= len(starts)
            order_ = np.argsort(hashes)
            hashes, counts = hashes[order_], counts[order_]
            yield _blobs(hashes[counts > 0], counts[counts > 0], ((hashes[counts > 0] >> np.uint64(31)) * np.uint64(parts)) >> np.uint64(32))

    level, rows, n = _files(_level(map_batches(texts, count_words, "part long, keys binary, counts binary"), f"{root}/1", 0, None, file_tokens), f"{root}/1")
    model = Model((level,), n, level.size)
    for k in range(2, order + 1):
        bounds = [(int(p) << model.bits) + int(share * model.types) for r, first in zip(rows, level.first_place, strict=True) for p, share in [(first, 0.0), *((first + c["place"], c["share"]) for c in r["cuts"])]]
        shared = spark.sparkContext.broadcast((model, np.array(bounds, np.uint64)))

        def count_grams(columns, k=k, shared=shared):
            model, bounds = shared.value
            for some in by_bytes(columns["text"]):
                hashes, codes, starts = tokens(some)
                word = model.words(hashes)[0][codes]
                context = word
                for j in range(2, k):
                    context = model.find(context, word, starts, j)[1]
                keys, counts = np.unique(model.step(context, word, starts, k)[1], return_counts=True)
                yield _blobs(keys, counts, np.searchsorted(bounds, keys, "right") - 1)

        made = _level(map_batches(texts, count_grams, "part long, keys binary, counts binary"), f"{root}/{k}", model.bits, model, file_tokens)
        level, rows, _ = _files(made, f"{root}/{k}")
        model = dataclasses.replace(model, levels=(*model.levels, level))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score and score of the whole text; null is empty, repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        return {"doc_id": columns["doc_id"], **shared.value.score(columns["text"])}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base_score double, score double")


def score_report(docs: DataFrame, order: int = ORDER, **sizes: int) -> DataFrame:
    """Train on the documents whose crc32(doc_id) mod 5 is not 1 (a null id counts as empty text, 0), score all."""
    model = train(docs.where(fold_of("doc_id") != 1), order, **sizes)
    scores = score_documents(docs, model)
    return scores.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
