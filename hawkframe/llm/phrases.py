"""Phrases of two to four words by dynamic itemset counting.

Texts become blocks of word codes, dealt to a fixed number of shards that are scanned in a cycle, one shard a step. All words
are counted from the first step. A longer phrase is activated once the two phrases that lack its last and its first
word have reached the threshold, whatever the step, so that all lengths are counted in the same scans. An active phrase
enters the tally at the first shard that holds enough of it (a phrase that reaches `least` in a cycle of S shards has
least / S in one of them, so none is missed and the tally stays small), and is complete after one full cycle of S steps.

What tasks need to know of the tally are bit tables of bounded size, built by Spark from what a step adds. A table keeps its
size and only gains bits of phrases at the threshold, so a phrase that once looked active there is still seen in each later
step: it costs work and is counted over a full cycle like any other.

Counts of a shard are packed by ranges of the phrases' hashes and summed range by range; only what the tally needs becomes rows.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.llm.common import durable, lowered

LONGEST = 4
LEAST = 30
SHARDS = 4
SUBSUMED_PERCENT = 80
TOP = 2000
# Text of one block of codes; bits of one table at most (16 MB).
BLOCK_BYTES = 2_000_000
MOST_BITS = 1 << 27
# Bits of a table for each phrase that could be at the threshold.
PHRASE_BITS = 4
# Tokens of a shard behind one range of hashes.
RANGE_TOKENS = 1_000_000
NO_LANG = "und"
W = [f"w{i}" for i in range(1, LONGEST + 1)]

# Breaks become one that no word holds; what else splits a piece is white space to `split`.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"."
_PIECES = bytes.maketrans(_BREAKS, _BREAK * len(_BREAKS))
_EMITTED = ", ".join(f"{w} long" for w in W) + ", c long"


def word_ids(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """64-bit numbers of the words of a language; 0 is kept for 'no word'."""
    import xxhash

    head = lang.encode("utf-8", "surrogatepass") + b"\0"
    ids = np.array([xxhash.xxh3_64_intdigest(head + w, seed) for w in words], np.uint64)
    return np.where(ids == 0, np.uint64(1), ids)


def _code_type(words: int) -> type:
    return np.uint16 if words < 1 << 16 else np.uint32


def blocks(docs: DataFrame, shards: int, seed: int, block_bytes: int = BLOCK_BYTES, number: Callable = word_ids) -> DataFrame:
    """Blocks of texts of one language: shard, lang, words (each once), ids, codes (places in ids from 1, 0 between pieces), tokens."""
    import pyarrow as pa

    schema = "lang string, words array<binary>, ids binary, codes binary, tokens long, shard int"
    arrow = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("ids", pa.binary()), ("codes", pa.binary()), ("tokens", pa.int64()), ("shard", pa.int32())])

    def cut(batches):
        nth = itertools.count()
        open_blocks: dict[str, tuple[dict, list[int], list[int]]] = {}

        def close(lang):
            codes, out, _ = open_blocks.pop(lang)
            words = [*codes][1:]
            row = {"lang": lang, "words": words, "ids": number(words, lang, seed).tobytes(), "codes": np.array(out, _code_type(len(words))).tobytes(), "tokens": len(out), "shard": next(nth) % shards}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for i in range(batch.num_rows):
                lang = langs[i].as_py()
                if lang not in open_blocks:
                    codes: dict[bytes, int] = defaultdict(itertools.count(1).__next__, {_BREAK: 0})
                    open_blocks[lang] = (codes, [0], [0])
                codes, out, size = open_blocks[lang]
                text = lowered(texts[i].as_py()).translate(_PIECES)
                out.extend(map(codes.__getitem__, text.replace(_BREAK, b" . ").split()))
                out.append(0)
                size[0] += len(text)
                if size[0] >= block_bytes:
                    yield close(lang)
                elif len(open_blocks) > 8 and sum(b[2][0] for b in open_blocks.values()) >= 8 * block_bytes:
                    for name in [*open_blocks]:
                        yield close(name)
        for lang in [*open_blocks]:
            yield close(lang)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text").mapInArrow(cut, schema)


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Mixed 64 bits of word numbers, a phrase per row; short phrases are followed by zeros."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a table of `bits` (a power of two)."""
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask).astype(np.int64)


@dataclasses.dataclass
class Bits:
    """Which phrases may be of a kind: no phrase of the kind is missed."""

    table: np.ndarray

    def holds(self, columns: list[np.ndarray]) -> np.ndarray:
        if not len(self.table) or not len(columns[0]):
            return np.zeros(len(columns[0]), bool)
        out = np.ones(len(columns[0]), bool)
        for at in probes(phrase_hash(columns), len(self.table) * 64):
            out &= (self.table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


@dataclasses.dataclass
class Known:
    """Bits of one step, by length: phrases at the threshold, those of them that got there in the last cycle, and those being counted."""

    reached: dict[int, Bits]
    recent: dict[int, Bits]
    open: dict[int, Bits]


def _nothing() -> Bits:
    return Bits(np.zeros(0, np.uint64))


def active_counts(ids: np.ndarray, codes: np.ndarray, known: Known, longest: int = LONGEST) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Word numbers and counts of a block's active phrases, one length at a time.

    At each length `group` names the phrase that starts at a place (-1: it has not reached the threshold), so that a
    longer one is a pair of such names.
    """
    at = np.concatenate([np.zeros(1, np.uint64), ids])
    reached, recent = known.reached.get(1, _nothing()).holds([at]), known.recent.get(1, _nothing()).holds([at])
    reached[0] = recent[0] = False
    places = np.flatnonzero(reached[codes])
    group = codes[places].astype(np.int64)
    words, newer = [at], recent
    # No longer phrase than these can be active now.
    longest = min(longest, max([*known.open, *[n + 1 for n in known.recent]], default=1))
    for n in range(2, longest + 1):
        # Phrases of n words start where one of n - 1 words does, and another starts a place later.
        follow = np.flatnonzero(np.diff(places) == 1)
        if not len(follow):
            return
        first, second = group[follow], group[follow + 1]
        pair = first * len(words[0]) + second
        order = np.argsort(pair)
        ranked = pair[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        begin = np.flatnonzero(new)
        count = np.diff(begin, append=len(pair))
        a, b = first[order[begin]], second[order[begin]]
        phrase = [w[a] for w in words] + [words[-1][b]]
        wanted = newer[a] | newer[b]
        wanted[~wanted] = known.open.get(n, _nothing()).holds([w[~wanted] for w in phrase])
        yield [w[wanted] for w in phrase], count[wanted]
        if n == longest:
            return
        at_threshold = known.reached.get(n, _nothing()).holds(phrase)
        newer = known.recent.get(n, _nothing()).holds(phrase) & at_threshold
        inverse = np.empty(len(pair), np.int64)
        inverse[order] = np.cumsum(new) - 1
        here = at_threshold[inverse]
        places, group, words = places[follow][here], inverse[here], phrase


def add_up(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different phrases and their summed counts."""
    h = phrase_hash(columns)
    order = np.argsort(h)
    ranked, words = h[order], [w[order] for w in columns]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    other = np.any([w[1:] != w[:-1] for w in words], axis=0)
    if (other & ~new[1:]).any():  # different phrases share a hash
        order = np.lexsort(columns)
        words = [w[order] for w in columns]
        new = np.r_[True, np.any([w[1:] != w[:-1] for w in words], axis=0)]
    begin = np.flatnonzero(new)
    return [w[begin] for w in words], np.add.reduceat(counts[order], begin)


def _count_shard(texts: DataFrame, known, ranges: int, enough: int) -> DataFrame:
    """Counts of active phrases of two words or more in one shard: those with `enough` there, and those being counted."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            for ids, codes in zip(batch.column("ids"), batch.column("codes"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.uint64) if ids.as_buffer().size else np.zeros(0, np.uint64)
                codes = np.frombuffer(codes.as_buffer(), _code_type(len(ids)))
                for phrase, counts in active_counts(ids, codes, known.value):
                    part = ((phrase_hash(phrase) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
                    order = np.argsort(part, kind="stable")
                    begin = np.searchsorted(part[order], np.arange(ranges + 1))
                    filled = np.flatnonzero(np.diff(begin))
                    words, counts = [w[order] for w in phrase], counts[order].astype(np.uint32)
                    blobs = [[w[begin[r] : begin[r + 1]].tobytes() for r in filled] for w in [*words, counts]]
                    none = [[None] * len(filled)] * (LONGEST - len(phrase))
                    columns = [pa.array(np.full(len(filled), len(phrase), np.int32)), pa.array(filled), *[pa.array(c, pa.binary()) for c in [*blobs[:-1], *none, blobs[-1]]]]
                    yield pa.RecordBatch.from_arrays(columns, names=["n", "range", *W, "c"])

    def merge(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        columns = [np.frombuffer(b"".join(table[w].to_pylist()), np.uint64) for w in W[:n]]
        phrase, counts = add_up(columns, np.frombuffer(b"".join(table["c"].to_pylist()), np.uint32).astype(np.int64))
        keep = counts >= enough
        keep[~keep] = known.value.open.get(n, _nothing()).holds([w[~keep] for w in phrase])
        counts = counts[keep]
        zero = np.zeros(len(counts), np.int64)
        columns = [w[keep].view(np.int64) for w in phrase] + [zero] * (LONGEST - n)
        return pa.table([pa.array(c) for c in [*columns, counts]], names=[*W, "c"])

    packed = texts.select("ids", "codes").mapInArrow(count, "n int, range long, " + ", ".join(f"{w} binary" for w in W) + ", c binary")
    return packed.groupBy("n", "range").applyInArrow(merge, _EMITTED)


def _count_words(texts: DataFrame) -> DataFrame:
    """Words of one shard with their counts: w1, lang, word, c."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            for lang, words, ids, codes in zip(*(batch.column(c) for c in ("lang", "words", "ids", "codes")), strict=True):
                if not len(words):
                    continue
                counts = np.bincount(np.frombuffer(codes.as_buffer(), _code_type(len(words))), minlength=len(words) + 1)[1:]
                numbers = np.frombuffer(ids.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([lang.as_py()] * len(numbers)), words.values.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["w1", "lang", "word", "c"])

    counted = texts.select("lang", "words", "ids", "codes").mapInArrow(count, "w1 long, lang string, word string, c long")
    return counted.groupBy("w1", "lang", "word").agg(F.sum("c").alias("c"))


Places = dict[int, tuple[np.ndarray, np.ndarray]]


def _places(marks: DataFrame, bits: int) -> dict[str, Places]:
    """Words of bit tables, with their bits, of the phrases in `marks` (kind, n, w1..), by kind and length; the driver gets `bits` bits a table at most, never the phrases."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            kinds, lengths = batch.column("kind").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            phrase = [batch.column(w).to_numpy().view(np.uint64) for w in W]
            for kind in ("new", "entered"):
                for n in range(1, LONGEST + 1):
                    here = (kinds == kind) & (lengths == n)
                    if here.any():
                        at = np.unique(np.concatenate(probes(phrase_hash([w[here] for w in phrase[:n]]), bits)))
                        masks = np.uint64(1) << (at & 63).astype(np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(at >> 6), pa.array(masks.view(np.int64))], names=["kind", "n", "at", "mask"])

    found = marks.mapInArrow(place, "kind string, n int, at long, mask long").groupBy("kind", "n", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    kinds, lengths = found.column("kind").to_numpy(), found.column("n").to_numpy()
    at, masks = found.column("at").to_numpy(), found.column("mask").to_numpy().view(np.uint64)
    out: dict[str, Places] = {"new": {}, "entered": {}}
    for kind, by_length in out.items():
        for n in range(1, LONGEST + 1):
            here = (kinds == kind) & (lengths == n)
            if here.any():
                by_length[n] = at[here], masks[here]
    return out


def _joined(steps: list[Places], bits: int, start: dict[int, Bits] | None = None) -> dict[int, Bits]:
    """Tables of the phrases of several steps, on top of those of `start`."""
    out = {n: b.table for n, b in (start or {}).items()}
    for step in steps:
        for n, (at, masks) in step.items():
            out.setdefault(n, np.zeros(bits // 64, np.uint64))[at] |= masks
    return {n: Bits(t) for n, t in out.items()}


class SharedNumber(Exception):
    """A frequent word has the number of another word under this seed."""


def count_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, seed: int = 0, block_bytes: int = BLOCK_BYTES, number: Callable = word_ids) -> tuple[DataFrame, DataFrame]:
    """Words (w1, lang, word, total) and phrases of 2 to 4 words (w1..w4, total) that occur `least` times or more, exactly counted.

    All words are returned, whatever their count. Word numbers are told apart by seed: if a word at the threshold shares
    its number with another one (odds of 1 in 10^4 for 10^8 words), the next seed is tried.
    """
    while True:
        try:
            return _count_phrases(docs, least, shards, seed, block_bytes, number)
        except SharedNumber:
            seed += 1


def _count_phrases(docs: DataFrame, least: int, shards: int, seed: int, block_bytes: int, number: Callable) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    texts = durable(blocks(docs, shards, seed, block_bytes, number), by="shard")
    tokens = texts.agg(F.sum("tokens")).first()[0] or 0
    # No more phrases of a length than tokens / least reach the threshold, so tables never need to grow.
    bits = min(MOST_BITS, 1 << max(10, (PHRASE_BITS * (tokens // least)).bit_length()))
    ranges = max(1, -(-tokens // (shards * RANGE_TOKENS)))
    enough = -(-least // shards)
    words = tally = None
    known = Known({}, {}, {})
    new_in, entered_in = [], []  # of each step
    for step in itertools.count():
        shard = texts.where(F.col("shard") == step % shards)
        if step < shards:
            new = _count_words(shard).select("w1", "lang", "word", "c", F.lit(None).cast("int").alias("reached"))
            new = new if words is None else new.unionByName(words.withColumnRenamed("total", "c"))
            new = new.groupBy("w1", "lang", "word").agg(F.sum("c").alias("total"), F.min("reached").alias("reached"))
            words = durable(new.withColumn("reached", F.coalesce("reached", F.when(F.col("total") >= least, F.lit(step)))))
        if step:
            sent = spark.sparkContext.broadcast(known)
            nothing = F.lit(None).cast("long")
            new = _count_shard(shard, sent, ranges, enough).select(*W, "c", nothing.alias("total"), nothing.cast("int").alias("first"), nothing.cast("int").alias("reached"))
            if tally is not None:
                new = new.unionByName(tally.withColumn("c", nothing))
            new = new.groupBy(*W).agg(F.sum("c").alias("c"), *[F.max(x).alias(x) for x in ("total", "first", "reached")])
            new = new.where(F.col("first").isNotNull() | (F.col("c") >= enough))
            first = F.coalesce("first", F.lit(step))
            counts_now = F.when(F.lit(step) < first + shards, F.coalesce("c", F.lit(0))).otherwise(0)
            new = new.select(*W, (F.coalesce("total", F.lit(0)) + counts_now).alias("total"), first.alias("first"), "reached")
            tally = durable(new.withColumn("reached", F.coalesce("reached", F.when(F.col("total") >= least, F.lit(step)))))
            sent.unpersist()
        zero = F.lit(0).cast("long")
        state = words.select("w1", *[zero.alias(w) for w in W[1:]], F.lit(0).alias("first"), "reached").where("reached is not null")
        if tally is not None:
            state = state.unionByName(tally.select(*W, "first", "reached"))
        n = F.when(F.col("w2") == 0, 1).when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
        kinds = {"new": (F.col("reached") == step) & (F.col("n") < LONGEST), "entered": (F.col("n") > 1) & (F.col("first") == step)}
        state = state.withColumn("n", n)
        marks = state.select(F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])).alias("kind"), "n", *W).where("kind is not null")
        added = _places(marks, bits)
        new_in.append(added["new"])
        entered_in.append(added["entered"])
        # A phrase is new for a cycle, and counted in the step that it enters and the others of a cycle.
        recent, open_ = new_in[-shards:], entered_in[len(entered_in) - min(shards - 1, len(entered_in)) :]
        if step + 1 >= shards and not any(recent) and not any(open_):
            break
        known = Known(_joined([added["new"]], bits, known.reached), _joined(recent, bits), _joined(open_, bits))
        if step + 1 >= shards:
            new_in[step + 1 - shards] = entered_in[step + 1 - shards] = {}
    shared = words.groupBy("w1").agg(F.count(F.lit(1)).alias("k"), F.sum("total").alias("s")).where((F.col("k") > 1) & (F.col("s") >= least))
    if not shared.isEmpty():
        raise SharedNumber
    if tally is None:
        tally = spark.createDataFrame([], f"{_EMITTED.replace(', c long', '')}, total long")
    return words.select("w1", "lang", "word", "total"), tally.where(F.col("total") >= least).select(*W, "total")


def _part(first: int, n: int) -> F.Column:
    """The words first .. first + n - 1 of a phrase, with zeros behind, as one array."""
    return F.array(*[F.col(w) for w in W[first : first + n]], *[F.lit(0).cast("long")] * (LONGEST - n))


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int | None = TOP, shards: int = SHARDS, seed: int = 0, block_bytes: int = BLOCK_BYTES, number: Callable = word_ids) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best `top` phrases of each language (None: all).

    `docs` has lang and text; further columns are ignored, whatever their names. A null language is `und`, a null text
    empty, a repeated row counts again, an empty table gives no rows. Languages are apart in everything.
    """
    words, phrases = count_phrases(docs, least, shards, seed, block_bytes)
    phrases = phrases.withColumn("p", _part(0, LONGEST))
    n = words.groupBy("lang").agg(F.sum("total").alias("n"))
    words = words.where(F.col("total") >= least)
    totals = phrases.select("p", F.col("total").alias("f")).unionByName(
        words.select(F.array("w1", *[F.lit(0).cast("long")] * (LONGEST - 1)).alias("p"), F.col("total").alias("f"))
    )
    totals = durable(totals)
    n_words = F.lit(LONGEST) - F.size(F.filter("p", lambda w: w == 0))
    phrases = phrases.withColumn("len", n_words)
    # Each cut of a phrase of n words, the count of its first and of its other words, and the score.
    cuts = [F.when(F.col("len") > k, F.struct(F.lit(k).alias("k"), _part(0, k).alias("head"), _tail(k).alias("tail"))) for k in range(1, LONGEST)]
    cut = phrases.select("p", F.col("total").alias("a"), F.explode(F.array(*cuts)).alias("cut")).where("cut is not null").select("p", "a", "cut.*")
    cut = cut.join(totals.select(F.col("p").alias("head"), F.col("f").alias("l")), "head").join(totals.select(F.col("p").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    scored = cut.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # A phrase goes when a longer one around it is nearly as frequent.
    inner = [F.when(F.col("len") >= first + n + (first == 0), _part(first, n)) for n in range(2, LONGEST) for first in range(LONGEST - n + 1)]
    around = phrases.select(F.explode(F.array(*inner)).alias("p"), F.col("total").alias("f")).where("p is not null").groupBy("p").agg(F.max("f").alias("longer"))
    wide = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(SUBSUMED_PERCENT) * F.col("a").cast("decimal(20,0)")
    left = scored.join(around, "p", "left").where(~F.coalesce(wide, F.lit(False)))
    # Word texts by number, one row a word, then the phrase in order.
    spelt = left.select("p", "a", "best", F.posexplode(F.filter("p", lambda w: w != 0)).alias("pos", "w1")).join(words.select("w1", "lang", "word"), "w1")
    spelt = spelt.groupBy("p", "a", "best").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def _tail(k: int) -> F.Column:
    """The words after the first k, moved to the front."""
    return F.array(*[F.col(w) for w in W[k:]], *[F.lit(0).cast("long")] * k)
