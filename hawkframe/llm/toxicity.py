"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3- to 5-grams (with word boundaries) and of the word itself, all
hashed into one table; a window is the mean over its words, filled up with zero vectors to a fixed number; a softmax
over two classes follows. Windows run over a text's different words in order of first use, so a repeated line counts
once. A text is as toxic as its most toxic window, so a long text does not dilute a short insult, and a misspelling that was
never seen shares most n-gram vectors with the word. Labels belong to texts, not windows: after a first fit on
all windows, toxic texts are represented by their highest windows only and the fit goes on.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import fold_of, map_batches

WINDOW = 32
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 8
# Bounds of the training sample: texts per class, and bytes of a text that may be in it.
SAMPLE_TEXTS = 4000
SAMPLE_TEXT_BYTES = 16_384
LEAST_STEPS = 300
# An n-gram counts once for each different word of each text that has it.
LEAST_USES = 5


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams, and where each word's begin (one more entry at the end)."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    last = end[owner]
    mul, place = np.uint64(0x9E3779B97F4A7C15), np.arange(len(code))
    whole = np.add.reduceat((code + np.uint64(7)) * _powers(place - (end - size)[owner]), end - size)
    found, owners = [whole], [np.arange(len(words))]
    rolled = code * mul
    for n in range(2, max(GRAMS) + 1):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * mul + code[n - 1 :]
        if n in GRAMS:
            inside = place[: len(rolled)] + n <= last[: len(rolled)]
            found.append(rolled[inside] + np.uint64(n))
            owners.append(owner[: len(rolled)][inside])
    h, who = np.concatenate(found), np.concatenate(owners)
    h = h * mul
    ids = ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(who, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))])


def _powers(exponent: np.ndarray) -> np.ndarray:
    most = int(exponent.max()) + 1 if len(exponent) else 1
    with np.errstate(over="ignore"):
        table = np.cumprod(np.full(most, 0xD6E8FEB86659FD93, np.uint64))
    return table[exponent]


def windows(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the windows over texts laid end to end. Texts of over `window` words end in a full window that
    overlaps the one before; texts without words have none."""
    n = np.where(lengths > 0, -(-lengths // window), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(lengths) - lengths)[text]
    size = lengths[text]
    start = begin + np.minimum(nth * window, np.maximum(size - window, 0))
    return start, np.minimum(start + window, begin + size), text


def coded(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of the texts, each text's different words as numbers, and how many each has."""
    index: dict[str, int] = {}
    number = index.setdefault
    codes = []
    for t in texts:
        codes.append(np.array([number(w, len(index)) for w in dict.fromkeys((t or "").lower().split())], np.int32))
    return list(index), np.concatenate(codes) if codes else np.zeros(0, np.int32), np.array([len(c) for c in codes], np.int64)


@dataclasses.dataclass
class Model:
    """What scoring needs: each bucket's share of the logit, and the bias."""

    logit: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        out = []
        for i in range(0, len(words), 20_000):
            ids, ptr = features(words[i : i + 20_000], len(self.logit))
            out.append(np.add.reduceat(self.logit[ids], ptr[:-1]) / np.diff(ptr))
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        words, codes, lengths = coded(texts)
        start, end, text = windows(lengths)
        total = np.concatenate([[0.0], np.cumsum(self.word_logits(words)[codes])]) if len(codes) else np.zeros(1)
        logits = np.full(len(texts), self.bias)
        if len(start):
            each = (total[end] - total[start]) / WINDOW + self.bias
            has = lengths > 0
            logits[has] = np.maximum.reduceat(each, np.flatnonzero(np.r_[True, text[1:] != text[:-1]]))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def fit(texts: list[str], toxic: list[int], seed: int = 3, rounds: int = 3, batch: int = 128, rate: float = 0.6) -> Model:
    """Fit on whole texts. Without texts of both classes the model is constant at the labels' share."""
    y_text = np.asarray(toxic, np.int64)
    if not len(y_text) or y_text.min() == y_text.max():
        share = (y_text.sum() + 1e-3) / (len(y_text) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    words, codes, lengths = coded(texts)
    parts = [features(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    ids = np.concatenate([p[0].astype(np.int32) for p in parts])
    ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    del parts, words
    start, end, owner = windows(lengths)
    y = y_text[owner]
    rng = np.random.default_rng(seed)
    # Vectors start at zero, and n-grams of too few words of texts stay there: what was never seen says nothing.
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    uses = np.bincount(codes, minlength=len(ptr) - 1).astype(np.float32)
    often = np.bincount(ids, np.repeat(uses, np.diff(ptr)), BUCKETS) >= LEAST_USES
    out, bias = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    sums, out_sums, bias_sums = np.full(BUCKETS, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def forward(rows):
        sizes = end[rows] - start[rows]
        at = np.cumsum(sizes) - sizes
        flat = codes[np.repeat(start[rows], sizes) + np.arange(sizes.sum()) - np.repeat(at, sizes)]
        used, local = np.unique(flat, return_inverse=True)
        n = ptr[used + 1] - ptr[used]
        first = np.cumsum(n) - n
        grams = ids[np.repeat(ptr[used], n) + np.arange(n.sum()) - np.repeat(first, n)]
        vectors = np.add.reduceat(table[grams], first, axis=0) / n[:, None]
        mean = np.add.reduceat(vectors[local], at, axis=0) / WINDOW
        z = mean @ out + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True), mean, sizes, local, len(used), n, grams

    def step(rows):
        nonlocal out, bias
        p, mean, sizes, local, used, n, grams = forward(rows)
        p[np.arange(len(rows)), y[rows]] -= 1
        p *= np.where(y[rows] == 1, 2.0, 1.0)[:, None] / len(rows)
        # An empty window is clean.
        nothing = np.exp(bias - bias.max())
        g_bias = p.sum(0) + 0.2 * (nothing / nothing.sum() - np.array([1.0, 0.0]))
        g_out, g_mean = mean.T @ p, p @ out.T
        per_word = np.repeat(g_mean / WINDOW, sizes, axis=0)
        g_word = np.stack([np.bincount(local, per_word[:, j], used) for j in range(WIDTH)], 1) / n[:, None]
        hit, where = np.unique(grams, return_inverse=True)
        spread = np.repeat(g_word, n, axis=0)
        g = np.stack([np.bincount(where, spread[:, j], len(hit)) for j in range(WIDTH)], 1).astype(np.float32)
        g[~often[hit]] = 0
        sums[hit] += (g * g).mean(1)
        table[hit] -= rate * g / np.sqrt(sums[hit])[:, None]
        out_sums[:], bias_sums[:] = out_sums + g_out**2, bias_sums + g_bias**2
        out = out - 0.1 * rate * g_out / np.sqrt(out_sums)
        bias = bias - 0.1 * rate * g_bias / np.sqrt(bias_sums)

    def margins() -> np.ndarray:
        logit = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
        of_word = np.add.reduceat(logit.astype(np.float32)[ids], ptr[:-1]) / np.diff(ptr)
        total = np.concatenate([[0.0], np.cumsum(of_word[codes])])
        return (total[end] - total[start]) / WINDOW + bias[1] - bias[0]

    rows = np.concatenate([rng.permutation(np.flatnonzero(y == v))[: int((y == 1).sum())] for v in (0, 1)])
    for turn in range(rounds):
        if turn:
            # Toxic texts stand by their highest window and any other that the model is sure of; clean ones by their
            # highest windows, and a twentieth of all.
            margin = margins()
            best = np.full(len(lengths), -np.inf)
            np.maximum.at(best, owner, margin)
            top = margin >= best[owner]
            rows = np.flatnonzero(np.where(y == 1, top | (margin > 2), top | (margin > -1) | (rng.random(len(y)) < 0.05)))
        # A small sample is gone through more often.
        for _ in range(max(1 if turn == 0 else 2, -(-LEAST_STEPS * batch // len(rows)))):
            mixed = rng.permutation(rows)
            for i in range(0, len(mixed), batch):
                step(mixed[i : i + batch])
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, texts_per_class: int = SAMPLE_TEXTS, text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows of the training folds (crc32(doc_id) mod 5 not 0).

    The sample takes, for each class, the `texts_per_class` texts of at most `text_bytes` bytes with the smallest id hashes. A
    document's label is the largest of its label rows; null labels, null ids and null texts are not used.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id") != 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    usable = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    ids = marks.join(usable.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.xxhash64("doc_id"))
    for value in (0, 1):
        part = ids.where(F.col("toxic") == value).orderBy("_h", "doc_id").limit(texts_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Bounded by texts_per_class, so the ids go to the scan and the texts are not shuffled.
    wanted = F.broadcast(chosen.select("doc_id", "toxic"))
    rows = usable.select("doc_id", "text").join(wanted, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * texts_per_class)

    def learn(batches):
        import pyarrow as pa

        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        if texts:
            model = fit(texts, toxic)
            yield pa.RecordBatch.from_pydict({"logit": [model.logit.tobytes()], "bias": [model.bias]})

    # The rows come in one ordered partition; its task fits, and the driver gets the shares of the buckets only.
    made = rows.select("text", "toxic").mapInArrow(learn, "logit binary, bias double").collect()
    return Model(np.frombuffer(made[0]["logit"], np.float32), made[0]["bias"]) if made else fit([], [])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in 0..1 of every whole text; null and empty texts get the score of an empty bag. Repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        return {"doc_id": columns["doc_id"], "score": shared.value.score(columns["text"])}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scores = score_documents(docs, train(docs, labels))
    return scores.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score below `threshold`, with all their columns; scored beside the row, so nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)
