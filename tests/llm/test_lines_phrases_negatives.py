"""Shared lines, phrases and hard negatives against plain versions, with small bounds so that every path is taken."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from test_llm_helpers import LONG, odd_documents

from hawkframe.llm import hardneg, linededup, phrases
from hawkframe.llm.common import table
from hawkframe.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, least_chars=40, least_documents=5):
    """(doc_id, n_lines, n_dropped, kept) per row."""
    holders: dict[str, set] = {}
    key = lambda line: fold(line.strip(BLANK))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            at = holders.get(key(line), set())
            if len(at) < least_documents or i == max(x for x in at if x is not None):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("hot_rows", [1000, 0])
def test_shared_lines_equal_plain_version(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(linededup, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(linededup, "HOT_SHARE", 0.01)
    rng = np.random.default_rng(2)
    common = ["All rights reserved by the owners of this very site", "Straße ÄÖÜ and forty more characters, İstanbul too", "x" * 39, "y" * 40, "Δ" * 40]
    rows = []
    for i in range(60):
        lines = [("\t " * (i % 3)) + (c.upper() if i % 2 and c.isascii() else c) + " \r" * (i % 2) for c in common if rng.random() < 0.4] * (1 + i % 2)
        lines += ["", " ", f"a line of document {i} that nobody else has at all"]
        rows.append((i if i % 7 else None if i else 0, "\n".join(rng.permutation(lines))))
    rows += [(3, rows[3][1]), (3, rows[4][1]), (100, None), (101, ""), (102, "\n"), (None, "\n".join(common)), (103, "\n".join(common * 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: linededup.F.lit(7) for c in ("row", "key", "lines", "gone", "id", "n")})
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.line_report(docs.repartition(5)).collect())
    want = sorted(((i is None, i or 0), n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(rows))
    assert got == want and sum(w[2] for w in want) > 100
    left = linededup.without_shared_lines(docs)
    assert left.columns == docs.columns and left.where("row <> 7 or lines <> 7").count() == 0
    assert sorted(r.text or "" for r in left.collect()) == sorted(t for *_, t in plain_lines(rows))
    assert left.where("text is null").count() == 1 and linededup.line_report(docs.limit(0)).count() == 0


def test_shared_lines_on_odd_documents(spark):
    docs = odd_documents(spark)
    assert linededup.line_report(docs).count() == docs.count()
    assert linededup.line_report(docs).where("n_dropped > 0").count() == 0


def plain_phrases(rows, least, top):
    """The contract's rows, from all contiguous phrases of all pieces."""
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    f = {g: c for g, c in f.items() if c >= least}
    longer: Counter = Counter()
    for (lang, g), c in f.items():
        for m in range(2, len(g)):
            for j in range(len(g) - m + 1):
                longer[lang, g[j : j + m]] = max(longer[lang, g[j : j + m]], c)
    out: dict[str, list] = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and 100 * longer[lang, g] < 80 * a:
            cuts = [(2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top]))


def invented(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "Ω"]
    odds = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        drawn = rng.choice(words, 40, p=odds / odds.sum()).tolist()
        for _ in range(3):
            drawn.insert(int(rng.integers(30)), "New York City Hall" if i % 3 else "new  york\tcity")
        drawn.insert(5, "; ")
        rows.append((["en", "de", None, "und"][i % 4], " ".join(drawn)))
    return rows


@pytest.mark.parametrize("shards,block_bytes", [(4, 300), (3, 2000), (1, 10**6)])
def test_phrases_equal_plain_counts(spark, shards, block_bytes):
    rows = invented(120, shards) + [("en", None), ("en", ""), ("fr", ".;  \t\n"), ("en", "aa aa aa aa aa " * 2000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, w1 int, p string").repartition(3)
    got = phrases.mine_phrases(docs, least=12, top=25, shards=shards, block_bytes=block_bytes)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
    assert got == plain_phrases(rows, 12, 25)
    assert {len(r[2].split()) for r in got} >= {2, 3} and {"en", "de", "und"} <= {r[0] for r in got}


def test_phrases_met_before_their_words_reach_the_threshold_are_counted_in_full(spark):
    # Some thousand rare words follow sixty common ones; a few of them look frequent in a bit table before they are.
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        drawn = [f"common{k % 60} rare{k}" for k in rng.integers(1000, size=85).tolist()]
        rows.append(("en", "; ".join(drawn)))
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = phrases.mine_phrases(docs, least=12, top=None, block_bytes=2000)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
    assert got == plain_phrases(rows, 12, None) and len(got) > 800


def test_phrases_of_one_hash_are_summed_apart(monkeypatch):
    monkeypatch.setattr(phrases, "phrase_hash", lambda columns: columns[0] % np.uint64(2))
    a, b = np.array([4, 2, 4, 2, 3], np.uint64), np.array([1, 1, 1, 5, 1], np.uint64)
    words, counts = phrases.add_up([a, b], np.array([1, 10, 100, 1000, 10000]))
    assert sorted(zip(*(w.tolist() for w in words), counts.tolist(), strict=True)) == [(2, 1, 10), (2, 5, 1000), (3, 1, 10000), (4, 1, 101)]


def test_phrases_of_nothing(spark):
    docs = odd_documents(spark)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    assert phrases.mine_phrases(docs.where("doc_id = 1")).count() == 0
    # Each word of the long text comes a few times only, and no two of them together more often.
    assert phrases.mine_phrases(docs.where("doc_id >= 11")).where("a < 30").count() == 0 and len(LONG) > 300_000


def test_words_that_share_a_number_are_told_apart(spark):
    def two_numbers(words, lang, seed):
        return phrases.word_ids(words, lang, seed) if seed else phrases.word_ids(words, lang, seed) % np.uint64(2) + np.uint64(1)

    docs = spark.createDataFrame([("en", "alpha beta gamma")] * 20, "lang string, text string")
    with pytest.raises(phrases.SharedNumber):
        phrases._count_phrases(docs, 12, 2, 0, 1000, two_numbers)
    got = phrases.mine_phrases(docs, least=12, shards=2, number=two_numbers).collect()
    assert [(r.phrase, r.a) for r in got] == [("alpha beta gamma", 20)]


def plain_negatives(rows, k=5):
    """rows: (vec_id, label, vector), each once."""
    use = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in use:
        if i % 100:
            continue
        others = sorted((-dot(v, w), j, m) for j, m, w in use if j != i)
        for s, j, _ in [o for o in others if o[2] == label][:k]:
            fits = [o for o in others if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s][:k]
            out += [(i, j, n + 1, b, -s, -t) for n, (t, b, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"lists": 3, "chunk_rows": 64, "member_rows": 3}, {"lists": 2, "chunk_rows": 50, "shares": (0.02, 0.1, 0.5)}])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(hardneg, "LEAST_MEMBERS", 2)
        monkeypatch.setattr(hardneg, "STRIDE", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(0, 1200):
        v = (centres[i % 4] + rng.normal(size=6) * 0.4) / 3
        rows.append((i if i % 3 else i // 3 * 100, int(rng.integers(10)), v.astype(np.float32).tolist()))
    rows = [*{r[0]: r for r in rows}.values()]
    # Copies of one vector with ties, vectors of other lengths, a zero anchor, and rows that take no part.
    rows += [(50_001 + i, i % 10, rows[0][2]) for i in range(90)]
    rows += [(70_000, 2, [0.0] * 6), (70_100, 3, []), (70_200, 4, [1.5, -2.25]), (70_300, 1, [1000.0] * 6)]
    rows += [(80_000, None, rows[1][2]), (80_100, 1, None), (80_200, 1, [1.0, None]), (80_300, 1, [float("nan")]), (80_400, 1, [float("inf")]), (None, 1, rows[0][2])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows + rows[:40]], "vec_id long, label int, embedding array<float>, row int, cluster string").repartition(4)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardneg.hard_negatives(df, **sizes).collect())
    assert got == plain_negatives(rows) and len(got) > 1000
    assert hardneg.hard_negatives(df.limit(0)).count() == 0 and hardneg.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_walks_stop_before_the_end(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    x = (256 * (np.repeat(centres, 400, axis=0) + rng.normal(size=(3200, 8)) * 0.02)).astype(np.int64)
    members = {"row": np.array([1]), "vec_id": np.array([0]), "label": np.array([0]), "q": x[:1], "bands": [[(0, 1 << 60, 0)]]}
    b = hardneg.bounds(x, centres[:1], np.array([0.1]))[:, 0]
    rows = {"vec_id": np.arange(3200), "label": np.zeros(3200, int), "q": x, "bound": b}
    seen = []
    plain = hardneg.products
    hardneg.products = lambda a, c: seen.append(len(c)) or plain(a, c)
    try:
        found = hardneg.walk(members, rows, True, 5, stride=100)
    finally:
        hardneg.products = plain
    best = sorted(((-int(s), i) for i, s in enumerate(x @ x[0]) if i), key=lambda t: t)[:5]
    assert [(-s, v) for _, _, s, v in found] == best and sum(seen) <= 800


def test_components_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError):
        hardneg.hard_negatives(df)


def test_registered_queries_take_every_row(spark, sf):
    assert QUERIES["op11_drop_shared_lines"](spark, sf).count() == table(spark, sf, "documents").count()
    anchors = {r.anchor_id for r in QUERIES["op13_mine_hard_negatives"](spark, sf).select("anchor_id").distinct().collect()}
    assert anchors <= {r.vec_id for r in table(spark, sf, "embeddings").where("vec_id % 100 = 0").collect()} and anchors
