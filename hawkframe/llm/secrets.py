"""Secret scans: fixed patterns, and strings that a public BPE vocabulary needs many tokens for."""

from __future__ import annotations

import base64
import functools
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How this vocabulary's tokenizer cuts text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Known forms that are random by nature and no secret: digests by length, UUIDs, dates and plain numbers.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+|[0-9T+/_=-]+)"
)
# The same inside a longer run, between separators.
INNER = re.compile(rf"(?<![A-Za-z0-9])(?:{KNOWN.pattern.replace('|[0-9T+/_=-]+', '')})(?![A-Za-z0-9])")
HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOWELS = re.compile("[aeiouyAEIOUY]")
SEPARATORS = "/=-_"
# Stretches inside a run hold one part of this length: lists of short parts are no strings.
LONG_PART = re.compile(r"[A-Za-z0-9+]{8}")
LEAST_CHARS = 16
KINDS = ("assign", "access", "hex", "random")
CHARS_PER_TOKEN = 2.2
PIECE_CHARS = 1024


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(text: str, path: str = VOCABULARY) -> float:
    """Characters per token; long strings are counted in pieces, so one endless run stays cheap."""
    encode = _encoding(path).encode_ordinary
    return len(text) / max(1, sum(len(encode(text[i : i + PIECE_CHARS])) for i in range(0, len(text), PIECE_CHARS)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _gaps(text: str, begin: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans `taken` leave of begin..end."""
    out = []
    for a, b in taken:
        if b > begin and a < end:
            out.append((begin, a))
            begin = max(begin, b)
    return [(a, b) for a, b in [*out, (begin, end)] if b - a >= LEAST_CHARS]


def _ordinary(word: str, path: str, most: float) -> bool:
    """Letters in words' case that read well in small letters, or few different characters: words, identifiers, rules."""
    if len(set(word)) < 8:
        return True
    if re.search("[0-9+]", word):
        return False
    parts = [p for p in re.split("[/=_-]", word) if len(p) >= 8]
    return _wordlike(word, path, most) and all(_wordlike(p, path, most) for p in parts)


def _wordlike(word: str, path: str, most: float) -> bool:
    cased = HUMPS.findall(word)
    letters = sum(map(len, cased))
    if letters < 4 * len(cased):
        return False
    # Long words of other languages come near the limit from below, but have vowels.
    rate = chars_per_token(word.lower(), path)
    return rate >= most or rate >= 0.85 * most and 4 * len(VOWELS.findall(word)) >= letters


def _dense(word: str, path: str, most: float) -> list[tuple[int, int]]:
    """Parts of a run with under `most` characters per token: the whole run, else the stretches of tokens that exceed
    that rate the most, each as wide as the separators around it while it stays under."""
    encoding = _encoding(path)
    ends, starts, gains = [], [], []
    for i in range(0, len(word), PIECE_CHARS):
        at = i
        for token in encoding.encode_ordinary(word[i : i + PIECE_CHARS]):
            size = len(encoding.decode_single_token_bytes(token))
            starts.append(at)
            at += size
            ends.append(at)
            gains.append(most - size)
    if sum(gains) > 0:
        return [(0, len(word))]
    total = [0.0, *itertools.accumulate(gains)]
    out, todo = [], [(0, len(gains))]
    while todo:
        lo, hi = todo.pop()
        best, low, a, b = 0.0, lo, lo, lo
        for i in range(lo, hi):
            if total[i] < total[low]:
                low = i
            if total[i + 1] - total[low] > best:
                best, a, b = total[i + 1] - total[low], low, i + 1
        if b == a or ends[hi - 1] - starts[lo] < LEAST_CHARS:
            continue
        todo += [(lo, a), (b, hi)]
        start, end = starts[a], ends[b - 1]
        left = max((word.rfind(c, 0, start) for c in SEPARATORS), default=-1) + 1
        right = min((k for c in SEPARATORS if (k := word.find(c, end)) >= 0), default=len(word))
        near = [(x, y) for x, y in ((left, right), (left, end), (start, right)) if y - x < most * len(encoding.encode_ordinary(word[x : min(y, x + PIECE_CHARS)])) and y - x <= PIECE_CHARS]
        out.append(near[0] if near else (start, end))
    return out


def random_spans(text: str, base: list[tuple[int, int, int]], path: str = VOCABULARY, most: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Further strings of 16 characters or more with under `most` characters per token, known forms, found secrets and ordinary words apart.

    A string may be part of a longer run; what secrets and known forms leave of a run is scored on its own.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        if KNOWN.fullmatch(m[0].strip("=")):
            continue
        taken = sorted([(a, b) for a, _, b in base if a < m.end() and m.start() < b] + [(k.start(), k.end()) for k in INNER.finditer(text, m.start(), m.end())])
        for begin, end in _gaps(text, m.start(), m.end(), taken):
            run, found = text[begin:end], []
            for x, y in _dense(run, path, most):
                word = run[x:y]
                if (x, y) != (0, len(run)) or taken:
                    x, y = x + len(word) - len(word.lstrip(SEPARATORS)), y - len(word) + len(word.rstrip(SEPARATORS))
                    word = run[x:y]
                    if len(word) < LEAST_CHARS or not LONG_PART.search(word):
                        continue
                if not re.search("[A-Za-z]", word) or KNOWN.fullmatch(word.strip("=")) or _ordinary(word, path, most):
                    continue
                found.append((begin + x, 3, begin + y))
            out += sorted(set(found))
    return out


def scan_secrets(docs: DataFrame, path: str = VOCABULARY, chars_per_token_below: float = CHARS_PER_TOKEN) -> DataFrame:
    """Per document: doc_id and secrets, an array of (start, kind, last) in characters of the whole text.

    Null and empty texts have none; repeated rows give repeated rows. The vocabulary file must be
    readable at `path` on every worker.
    """

    def scan(columns):
        out = []
        for text in columns["text"]:
            text = text or ""
            base = base_spans(text)
            spans = sorted(base + random_spans(text, base, path, chars_per_token_below))
            out.append([{"start": a, "kind": KINDS[k], "last": b} for a, k, b in spans])
        return {"doc_id": columns["doc_id"], "secrets": out}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), scan, f"doc_id {kind}, secrets array<struct<start: long, kind: string, last: long>>")


def secret_report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans and all spans as kind:start:end."""
    found = scan_secrets(docs, path)
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["last"])), ",")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(said(F.filter("secrets", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )
