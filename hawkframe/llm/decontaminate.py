"""Benchmark decontamination: one Aho-Corasick automaton over word windows of the test items.

The automaton reads words, not characters: each word of the items has a number, a window is a sequence of
numbers, and a text is scanned once as the sequence of its words' numbers (0: not in any item). A match ends
at a word, words have offsets in the original text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import lowered, map_batches

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = re.compile("[A-Z]+")
WINDOW = 10


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(lowered(text).decode("utf-8", "surrogatepass"))


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[str, ...]]:
    """All runs of `window` words; an item of fewer words, but not none, is one run."""
    words = words_of(text)
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Windows:
    """The automaton over all windows of the items (id, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import ahocorasick

        self.vocabulary: dict[str, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for key, text in items:
            for run in windows_of(text, window):
                coded = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in run)
                owners.setdefault(coded, set()).update(() if key is None else (number[key],))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for coded, keys in owners.items():
            self.automaton.add_word(coded, (len(coded), frozenset(keys)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs of hit words [first, last) in order, and the ids of the items that occur."""
        if self.empty or not words:
            return [], []
        get = self.vocabulary.get
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, (length, keys) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            first = end + 1 - length
            items |= keys
            # Ends come in order; a longer window may start before runs already taken.
            while runs and first <= runs[-1][1]:
                first = min(first, runs.pop()[0])
            runs.append((first, end + 1))
        return runs, sorted(self.ids[n] for n in items)


def _shared_items(docs: DataFrame, benchmark: DataFrame, most_bytes: int):
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes; one automaton takes {most_bytes}")
    rows = benchmark.select(F.col("item_id").cast("string"), "text").distinct().collect()
    return docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows])


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 256 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids as text, sorted) and spans (hit runs as [first, last)
    character offsets in the original text).

    The items are collected to build the automaton; a benchmark of over `most_bytes` is refused. Null texts and items have no words; an
    item without id still hits words but is not named; rows with the same item id are one item. Repeated
    document rows give repeated rows.
    """
    shared = _shared_items(docs, benchmark, most_bytes)
    built: list[Windows] = []

    def scan(columns):
        if not built:
            built.append(Windows(shared.value, window))
        out = {k: [] for k in ("doc_id", "n_words", "n_hit", "items", "spans")}
        for key, text in zip(columns["doc_id"], columns["text"], strict=True):
            words = words_of(text)
            runs, ids = built[0].scan(words)
            spans = []
            if runs:
                # Lower-casing A-Z changes no offset.
                at = [m.span() for m in WORDS.finditer(UPPER.sub(lambda m: m[0].lower(), text))]
                spans = [{"first": at[a][0], "last": at[b - 1][1]} for a, b in runs]
            for name, value in (("doc_id", key), ("n_words", len(words)), ("n_hit", sum(b - a for a, b in runs)), ("items", ids), ("spans", spans)):
                out[name].append(value)
        return out

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), scan, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<first: long, last: long>>")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan_documents(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 256 << 20) -> DataFrame:
    """Documents without any hit, with all their columns; the scan runs beside the row, so no join is needed."""
    shared = _shared_items(docs, benchmark, most_bytes)
    built: list[Windows] = []

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            if not built:
                built.append(Windows(shared.value, window))
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield batch.filter(pa.array([not built[0].scan(words_of(t))[0] for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
