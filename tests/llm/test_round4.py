"""What the driver holds, and links added to known components."""

import os

import numpy as np
import pytest

from hawkframe.llm import components, eliasfano, ngramlm, toxicity


def test_the_classifier_is_fitted_by_a_task(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: toxicity.Model(np.full(4, len(texts), np.float32), float(os.getpid())))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, texts_per_class=5)
    assert model.bias != os.getpid()
    assert model.logit.tolist() == [10.0] * 4


def test_the_classifier_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    want = toxicity.fit([], [])
    got = toxicity.train(docs, labels)
    assert got.bias == want.bias and (got.logit == want.logit).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_links_added_to_components(spark, seed):
    rng = np.random.default_rng(seed)
    known, more = (rng.integers(0, 60, (n, 2)).tolist() for n in (25, 15))
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    labels = components.components(frame(known))
    got = {r.node: r.label for r in components.linked(labels, frame(more)).collect()}
    want = {r.node: r.label for r in components.components(frame(known + more)).collect()}
    assert got == want
    same = components.linked(labels, frame(known[:3]))
    assert {r.node: r.label for r in same.collect()} == {r.node: r.label for r in labels.collect()}
    none = components.components(frame([]))
    assert none.count() == 0 and components.linked(none, frame([])).count() == 0


def test_tokens_of_all_kinds_of_space(monkeypatch):
    calls = []
    monkeypatch.setattr(ngramlm, "word_hash", lambda word: calls.append(word) or len(calls) - 1)
    texts = [None, "", "  \t", " Ab\x0bab\x1cÄ ab\u00a0c\n", "x" + "".join(map(chr, range(1, 128))), "ab\ud800 \x85 AB", "\u2003ab ab"]
    hashes, codes, starts = ngramlm.tokens(texts)
    ends = [*starts[1:].tolist(), len(codes)]
    want = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    for a, b, words in zip(starts.tolist(), ends, want, strict=True):
        assert codes[a] == codes[b - 1] == 0
        assert [calls[c] for c in codes[a + 1 : b - 1]] == words
    assert len(hashes) == len(calls) == len({w for words in want for w in words}) + 1
    assert [len(x) for x in ngramlm.tokens([])] == [1, 0, 0]


def test_a_look_up_reads_only_the_sequence_of_its_level(spark, monkeypatch):
    texts = [f"w{i % 7} w{i % 5} w{i % 3} w{i % 11}" for i in range(200)]
    model = ngramlm.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3, file_tokens=100)
    assert len(model.levels[2].paths) > 1
    keys = ngramlm.at_places(model.levels[2], np.arange(model.levels[2].size), None)
    monkeypatch.setattr(eliasfano.EliasFano, "access", lambda *a: 1 / 0)
    absent = np.setdiff1d(np.concatenate([keys + np.uint64(1), keys[1:] - np.uint64(1)]), keys)
    assert (ngramlm.look_up(model.levels[2], keys)[0] == np.arange(len(keys))).all()
    assert (ngramlm.look_up(model.levels[2], absent)[0] == -1).all()
