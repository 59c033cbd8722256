"""Whole results where caps, dilution or low orders would lose some."""

import string

import numpy as np

from hawkframe.llm import neardup, ngramlm, secrets


def template_texts(seed=5, plain=300, paired=12):
    """Texts of one template, any two just under the limit, and a few that share a few of another text's own words."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + format(int(rng.integers(1 << 40)), "x")
    template = [word() for _ in range(320)]
    texts = []
    for i in range(plain):
        # The template at one place each, and own words behind it.
        texts.append(template + [word() for _ in range(57)])
        if i < paired:
            texts.append(texts[-1][:326] + [word() for _ in range(51)])
    order = rng.permutation(len(texts))
    return [" ".join(texts[i]) for i in order]


def brute_force(texts):
    sets = [{*neardup.shingle_hashes(t, neardup._Hashes()).tolist()} for t in texts]
    label, links = list(range(len(sets))), 0
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if 100 * shared >= 75 * (len(x) + len(sets[j]) - shared):
                links += 1
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    return label, links


def test_near_copies_inside_a_template_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION_ROWS", 16)
    texts = template_texts()
    label, links = brute_force(texts)
    assert links == 12 and len({*label}) == 300
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_random_strings_of_letters_and_inside_runs():
    rng = np.random.default_rng(3)
    chars = np.array([*string.ascii_letters, *string.digits])
    draw = lambda n, k: "".join(rng.choice(chars[:k], n))
    spans = lambda t: secrets.random_spans(t, secrets.base_spans(t))
    around = [("", ""), ("com/account/settings/password/reset/", ""), ("com/documents/public/download/session/", "/index/overview")]
    for before, after in around:
        for k in (52, 62):
            hits = 0
            for _ in range(100):
                inner = draw(24, k)
                hits += any(a <= 4 + len(before) + 2 and b >= 4 + len(before) + 22 for a, _, b in spans(f"see {before}{inner}{after} now"))
            assert hits >= 95, (before, k)
    secret = draw(24, 62)
    text = f"password=abcdefgh/{secret} 550e8400-e29b-41d4-a716-446655440000/{secret}"
    assert len(spans(text)) == 1 and text[spans(text)[0][0] :] == secret
    ordinary = "com/account/settings/password/reset internationalization getUserAccountSettingsByName MAX_CONNECTION_TIMEOUT_SECONDS"
    ordinary += " ---------------- aaaaaaaaaaaaaaaaaaaa /users/550e8400-e29b-41d4-a716-446655440000/profile"
    assert spans(ordinary) == []


def test_registered_order_uses_more_than_the_word_before(spark):
    texts = ["a b c", "x b d"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    assert len(ngramlm.train(docs).levels) >= 3
    model = ngramlm.train(docs)
    seen, crossed = model.score(["a b c", "a b d"])["score"]
    # After one word, c and d are alike; after two, only c is known.
    assert seen > crossed + 0.3
