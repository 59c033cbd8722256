"""Numbered queries against their SQL, or plain versions where SQL has no words for them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hawkframe.llm import annsearch, ngramlm, secrets, suffixdedup, toxicity
from hawkframe.llm.common import table
from hawkframe.llm.queries import QUERIES, SQL
from oracle import compare, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), SQL[name]) is None


def documents(spark, sf):
    return [(r.doc_id, r.text or "", r.source) for r in table(spark, sf, "documents").collect()]


def test_mix_stays_near_targets(spark, sf):
    rows = QUERIES["op2_mix_sources"](spark, sf).toPandas()
    assert (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(by.taken - by.target) <= 200).all()


def test_shards_have_no_gaps(spark, sf):
    rows = QUERIES["op3_shard_documents"](spark, sf).toPandas()
    counts = rows.groupby("shard").slot.agg(["count", "min", "max"])
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
    assert counts["count"].max() - counts["count"].min() <= 1


def test_neighbours_reach_recall(spark, sf):
    got = QUERIES["op4_nearest_neighbours"](spark, sf).toPandas()
    data = table(spark, sf, "embeddings").toPandas()
    ids, unit = data.vec_id.to_numpy(), annsearch.unit(np.stack(data.embedding))
    hits = wanted = 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(mine) + 1))
        for v, s in zip(mine.vec_id, mine.score, strict=True):
            assert abs(scores[np.flatnonzero(ids == v)[0]] - s) < 1e-12
        hits, wanted = hits + len({*ids[order]} & {*mine.vec_id}), wanted + len(order)
    assert hits >= 0.9 * wanted


def test_toxicity_on_held_out_labels(spark):
    words = "mild rain over the green hills and quiet towns beside slow rivers under clear autumn light".split()
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for i in range(400):
        t = list(rng.choice(words, 40))
        if i % 3 == 0:
            t[int(rng.integers(40))] = ["idiot", "moron", "worthless"][i % 9 // 3]
        texts.append(" ".join(t))
        marks.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:300], marks[:300])
    found = model.score(texts[300:]) >= 0.5
    assert (found == np.array(marks[300:])).mean() > 0.95
    bent = model.score([" ".join(words[:10] + [w] + words[10:]) for w in ("idiots", "m0ron", "worthles")])
    assert bent.min() > 5 * model.score([" ".join(words)])[0]
    assert model.score(["", None]).max() < 0.5


def test_repeats_equal_brute_force(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op7_repeated_bytes"](spark, sf).collect()}
    rows = sorted((i, t.encode()) for i, t, _ in documents(spark, sf))
    assert len(got) == len(rows)
    check_repeats(rows, got)


def test_repeats_over_many_groups_and_buckets(spark, sf, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 60_000)
    docs = table(spark, sf, "documents")
    found = suffixdedup.repeated_spans(docs, group_bytes=20_000)
    got = {r.doc_id: r for r in found.withColumn("n_spans", F.size("spans")).collect()}
    check_repeats(sorted((i, t.encode()) for i, t, _ in documents(spark, sf)), got)


def check_repeats(rows, got):
    first: dict[bytes, int] = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())


@pytest.mark.parametrize("order,sizes", [(2, {}), (3, {}), (3, {"file_tokens": 3000, "file_text_bytes": 100_000})])
def test_language_model_equals_plain_counts(spark, sf, order, sizes):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in ngramlm.score_report(docs, order, **sizes).collect()}
    tokens = {i: [*t.encode().lower().split(), b""] for i, t, _ in documents(spark, sf)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    grams: Counter = Counter()
    for i, w in tokens.items():
        if not held[i]:
            w = [b"", *w]
            for n in range(1, order + 1):
                grams.update(tuple(w[k : k + n]) for k in range(n == 1, len(w) - n + 1))
    words = {k: v for k, v in grams.items() if len(k) == 1}
    n, v = sum(words.values()), len(words)

    def chance(context, word):
        if not context:
            return (grams[(word,)] + 0.5) / (n + 0.5 * (v + 1))
        lower = chance(context[1:], word)
        return (grams[(*context, word)] + ngramlm.MU * lower) / (grams[context] + ngramlm.MU) if grams[context] else lower

    gain = 0.0
    for i, w in tokens.items():
        r, all_ = got[i], [b"", *w]
        base = sum(math.log10(chance((), x)) for x in w)
        full = sum(math.log10(chance(tuple(all_[max(0, k - order + 1) : k]), all_[k])) for k in range(1, len(all_)))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(grams[(x,)] > 0 for x in w), n, held[i])
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - full) <= 0.03 * len(w)
        gain += (r.score - r.base_score) * held[i]
    assert gain > 0


def test_secrets_equal_plain_patterns(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table holds no secret
    got = {r.doc_id: r for r in QUERIES["op10_scan_secrets"](spark, sf).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    some = 0
    for i, text, _ in documents(spark, sf):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert {*said.split(",")} - {""} <= {*r.spans.split(",")}
        some += len(spans)
    assert some


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    toxic, single, clean, mixed, sharded = steps
    assert single.count() == single.dropDuplicates(["text"]).count() or single.where("length(text) = 0").count() > 1
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    from hawkframe.llm.decontaminate import scan_documents

    dirty = {r.doc_id for r in scan_documents(single, table(spark, sf, "benchmark")).where("n_hit > 0").collect()}
    assert left == {r.doc_id for r in single.select("doc_id").collect()} - dirty
    originals = {r.doc_id: r.text for r in clean.collect()}
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and [*Counter(r.text.split())] and not Counter(r.text.split()) - Counter(originals[r.doc_id].split())
    assert sharded.count() == mixed.count() and toxic.count() <= table(spark, sf, "documents").count()
    for s in steps:
        s.unpersist()
