"""Nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import io

import numpy as np
import pytest
from test_llm_helpers import LONG, odd_documents

from hawkframe.llm import annsearch, decontaminate, eliasfano, mixing, neardup, ngramlm, secrets, sharding, suffixdedup, toxicity, warc
from hawkframe.llm.components import components


def empty(df):
    return df.limit(0)


def test_warc_nulls_repeats_and_ties(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (2, "http://b", "same"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "same"), (5, "http://f", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", warc.F.lit("clash"))
    got = warc.warc_round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (0, "revisit", 2, 4), (5, "response", None, 400_000)]
    )
    assert warc.warc_round_trip(empty(pages)).count() == 0


def test_warc_reader_finds_damage():
    good = warc.encode_record(7, "http://a", b"body" * 1000, None, False, "2024-01-01T00:00:00Z")
    two = good + warc.encode_record(8, None, b"", 7, True, "2024-01-01T00:00:00Z")
    records = [*warc.read_records(io.BytesIO(two))]
    assert [r["record_type"] for r in records] == ["response", "revisit"] and all(r["ok"] for r in records)
    assert records[0]["payload"] == b"body" * 1000 and records[1]["start"] == len(good)
    with pytest.raises(warc.WarcError):
        [*warc.read_records(io.BytesIO(good[:-20]))]
    import zlib

    bent = zlib.compress(zlib.decompress(good, 31).replace(b"bodybody", b"bodyBODY", 1), wbits=31)
    assert [r["ok"] for r in warc.read_records(io.BytesIO(bent))] == [False]


def test_mix_and_shards_on_odd_documents(spark):
    docs = odd_documents(spark)
    n = docs.count()
    mixed = mixing.mix_report(docs)
    assert mixed.count() == n and mixed.where("taken > 3 * size or taken is null or target is null").count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns
    shards = sharding.shard_documents(docs, 3)
    counts = sorted(r["count"] for r in shards.groupBy("shard").count().collect())
    assert shards.count() == n and counts[-1] - counts[0] <= 1
    assert mixing.mix_report(empty(docs)).count() == 0 and sharding.shard_documents(empty(docs)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(docs.withColumnRenamed("lang", "slot"), 3)


def test_neighbours_ties_and_unusable_vectors(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(i, v) for i in range(0, 40)] + [(50, [2.0, 4.0, 1.0]), (51, None), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 1.0]), (54, [float("nan"), 1.0, 1.0]), (55, [1.0, 1.0]), (None, v), (3, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("asked", annsearch.F.col("vec_id") % 50 == 0)
    got = annsearch.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(50, i) for i in range(5)]
    assert annsearch.search(empty(df)).count() == 0


def test_toxicity_without_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.drop_toxic(docs, labels).count() == docs.count()
    assert toxicity.toxicity_report(empty(docs), labels).count() == 0


def test_near_duplicates_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = neardup.near_duplicates(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got
    assert got.count((10, 1, 3, False)) == 1 and got.count((3, 1, 3, True)) == 2
    assert (12, len(LONG.split()) - 4, 11, False) in got
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 1
    assert neardup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = list(base)
        words[int(rng.integers(300))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows.append((1000, " ".join(f"y{i}" for i in range(300))))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 1000} == {0} and sum(r.kept for r in got) == 2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_repeats_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = suffixdedup.dedup_report(docs).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == docs.count() and got[11].n_removed == 0 and got[12].n_removed == got[12].n_bytes
    assert [r.n_removed for r in rows if r.doc_id == 3] == [0, 0] and [r.n_removed for r in rows if r.doc_id is None] == [0]
    assert suffixdedup.dedup_report(empty(docs)).count() == 0


def test_difference_cover_and_elias_fano():
    assert {(a - b) % suffixdedup.PERIOD for a in suffixdedup.COVER for b in suffixdedup.COVER} == {*range(suffixdedup.PERIOD)}
    rng = np.random.default_rng(1)
    for n, most in ((0, 10), (1, 1), (1000, 100), (5000, 2**46), (1000, 2**62)):
        v = np.sort(rng.integers(0, most, n, dtype=np.uint64))
        raw = np.frombuffer(eliasfano.to_bytes(eliasfano.EliasFano.of(v).arrays()), np.uint8)
        e = eliasfano.EliasFano.from_arrays(*eliasfano.from_buffer(raw))
        q = np.concatenate([v, rng.integers(0, most + 5, 500, dtype=np.uint64)])
        assert (e.successor(q) == np.searchsorted(v, q)).all() and (e.access(np.arange(n)) == v).all()


def test_language_model_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = ngramlm.score_report(docs).collect()
    assert len(rows) == docs.count() and all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2))
    alone = ngramlm.score_report(docs.where("doc_id is null and doc_id is not null"))
    assert alone.count() == 0
    untaught = ngramlm.score_documents(docs, ngramlm.train(empty(docs)))
    assert {r.n_known for r in untaught.collect()} == {0}


def test_decontamination_edges(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "Alpha, BETA!"), (1, "gamma delta"), (2, None), (3, ""), (None, "epsilon"), (4, "Alpha beta")], "item_id long, text string")
    texts = [(1, "x alpha beta y"), (2, "ALPHA-beta alpha beta, epsilon"), (3, None), (4, "alphabeta"), (5, "delta gamma delta ſ")]
    found = {r.doc_id: r for r in decontaminate.scan_documents(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert (found[1].n_hit, found[1].items) == (2, ["1", "4"]) and (found[2].n_hit, found[2].n_words) == (5, 5)
    assert (found[3].n_words, found[4].n_hit, found[5].n_hit, found[5].items) == (0, 0, 2, ["1"])
    assert [(s.first, s.last) for s in found[1].spans] == [(2, 12)]
    assert decontaminate.contamination_report(docs, empty(items)).where("contaminated").count() == 0
    assert decontaminate.contamination_report(empty(docs), items).count() == 0


def test_secrets_by_token_efficiency():
    random_key = "q7Zk2Xv9Lm4Tb8Rn3Ws6Yp1D"
    text = f"see {random_key} and 123e4567-e89b-12d3-a456-426614174000 or d41d8cd98f00b204e9800998ecf8427e, international-organization-2024"
    base = secrets.base_spans(text)
    spans = secrets.random_spans(text, base)
    assert [text[a:b] for a, _, b in spans] == [random_key] and [k for _, k, _ in base] == [2]
    assert secrets.base_spans('TOKEN = "abcdef" token=abc password:abcdefg')[0][:2] == (0, 0)
    assert secrets.chars_per_token("ab1" * 5000) > 0 and secrets.base_spans("") == []


def test_clashing_columns_ride_along(spark):
    docs = odd_documents(spark)
    names = ("size", "_text", "_words", "_id", "_hash", "_row", "_n", "_all", "start", "label", "node", "first_shard", "drawn", "shard", "a.b")
    odd = docs.select("*", *[mixing.F.lit(f"own {c}").alias(c) for c in names])
    for made, plain in ((mixing.mix_documents(odd), mixing.mix_documents(docs)), (neardup.keep_one(odd), neardup.keep_one(docs))):
        assert made.columns == odd.columns
        rows = made.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in names)
        assert sorted(r.text or "" for r in rows) == sorted(r.text or "" for r in plain.collect())


def test_rows_that_differ_in_one_more_column_both_stay_in_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 5, "left"), (1, "a b c", "en", "x", 5, "right")], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    assert {r.extra for r in mixing.mix_documents(docs).collect()} == {"left", "right"}


def test_slots_of_the_mix_fill_its_shards(spark):
    targets = spark.createDataFrame([("a", 5000, 1, 9000.0), ("b", 3001, 5, 1500.0), (None, 0, 2, 0.0)], "_source string, source_size long, weight int, target double")
    rows = mixing.mix_slots(targets, 10, 64).toPandas()
    assert len(rows) == 900 + 150 and rows.groupby("shard").slot.apply(lambda s: sorted(s) == [*range(len(s))]).all()
    counts = rows.groupby("shard").size()
    assert (counts.iloc[:-1] == 64).all() and counts.iloc[-1] == 1050 % 64
    # Each shard has its own draw, and no block comes once more before all others have come.
    share = rows[rows.source == "a"].groupby("shard").size() / counts
    assert share.iloc[:-1].nunique() > 3 and abs(share.iloc[:-1].mean() - 900 / 1050) < 0.05
    used = rows[rows.source == "a"].groupby("block").size()
    assert len(used) == 500 and used.min() == 1 and used.max() == 2


def test_a_group_of_texts_takes_few_bytes_for_each_of_its_own():
    import tracemalloc

    import zstandard

    size = 1 << 20
    text = np.random.default_rng(0).integers(97, 123, size, dtype=np.uint8).tobytes()
    tracemalloc.start()
    group = suffixdedup.Group([*range(16)], [size // 16] * 16, zstandard.ZstdCompressor().compress(text))
    starts = group.starts(group.candidates(np.arange(0, size - 100, 40)).tobytes())
    keys, *_ = group.keys(starts, suffixdedup.LENGTH, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) > size // 2 and peak < 46 * size


def test_flags_spread_over_the_places_behind():
    flags = np.random.default_rng(1).random(500) < 0.02
    for length in (1, 2, 31, 50):
        assert suffixdedup.spread(flags, length).tolist() == [bool(flags[max(0, i - length + 1) : i + 1].any()) for i in range(500)]


def test_a_search_finds_one_zero_for_each_value_asked(monkeypatch):
    values = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 20_000).astype(np.uint64))
    sequence, asked = eliasfano.EliasFano.of(values), []
    zero = eliasfano.EliasFano._zero
    monkeypatch.setattr(eliasfano.EliasFano, "_zero", lambda self, k: asked.append(len(k)) or zero(self, k))
    assert (sequence.find(values) == np.arange(len(values))).all() and (sequence.find(values + np.uint64(1)) < 0).sum() > 19_000
    assert sum(asked) < 1.2 * 2 * len(values)


def test_set_bits_of_a_word_are_found_by_number():
    words = np.array([1, 1 << 63, (1 << 64) - 1, 0x8000000100000001, 0x00FF00000000FF00], np.uint64)
    for w in words:
        bits = [k for k in range(64) if int(w) >> k & 1]
        assert eliasfano._nth_one(np.full(len(bits), w), np.arange(len(bits))).tolist() == bits
