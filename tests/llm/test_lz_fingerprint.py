import hashlib

import numpy as np
import pytest

from pivotspark.llm import lz_fingerprint as L

from .helpers import ODD_TEXTS, documents, prose


def phrases(text):
    out, i = set(), 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in out:
            j += 1
        if j > len(text):
            break
        out.add(text[i:j])
        i = j
    return out


TEXTS = [t or "" for t in ODD_TEXTS] + [prose(i, 300) for i in range(8)]


@pytest.mark.parametrize("text", TEXTS[:18], ids=range(18))
def test_parse_gives_the_phrases(text):
    ends, _ = L.Parser().parse(text, 0, len(text))
    assert {text[a:b] for a, b in zip([0, *ends], ends)} == phrases(text)


def test_edited_pair_equals_two_parses():
    for a in TEXTS:
        for b in TEXTS[::4]:
            own, edited, other = L.edited_pair(a, b)
            assert edited == a[:len(a) - len(a) // 2] + b[:len(a) // 2]
            assert np.array_equal(own, L.text_signature(a)) and np.array_equal(other, L.text_signature(edited))


def test_full_dictionaries_and_blocks(monkeypatch):
    whole = [L.text_signature(t) for t in TEXTS]
    pairs = [L.edited_pair(a, b) for a, b in zip(TEXTS, TEXTS[1:])]
    monkeypatch.setattr(L, "PHRASE_BLOCK", 3)
    monkeypatch.setattr(L, "TEXT_BLOCK", 10)
    assert all(np.array_equal(a, L.text_signature(t)) for a, t in zip(whole, TEXTS))
    for (own, edited, other), a, b in zip(pairs, TEXTS, TEXTS[1:]):
        got = L.edited_pair(a, b)
        assert np.array_equal(own, got[0]) and edited == got[1] and np.array_equal(other, got[2])
    # full dictionaries: what is shared is undone, what was replaced is not
    monkeypatch.setattr(L.Parser.__init__, "__defaults__", (30,))
    for a, b in zip(TEXTS, TEXTS[1:]):
        own, edited, other = L.edited_pair(a, b)
        assert np.array_equal(own, L.text_signature(a)) and np.array_equal(other, L.text_signature(edited))
    text = prose(9, 2000)
    parser = L.Parser(limit=50)
    parser.parse(text, 0, 100)
    state = parser.state()
    ends, made = parser.parse(text, 100, 5000)
    parser.back_to(state, made)
    assert parser.parse(text, 100, 5000)[0] == ends


def test_likeness_estimates_the_overlap():
    error = []
    for a in TEXTS[-8:]:
        for b in TEXTS[-8:]:
            x, y = phrases(a), phrases(b)
            error.append(L.likeness(L.text_signature(a), L.text_signature(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.08
    assert L.likeness(L.text_signature(""), L.text_signature("")) == 1
    assert L.likeness(L.text_signature(""), L.text_signature("abc")) == 0


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_neighbours(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        texts = [None, *TEXTS]
        ids = [i * i - 40 for i in range(len(texts))]
        rows = {r.doc_id: r for r in L.with_edits(documents(spark, texts, ids=ids, extra=True).repartition(3)).collect()}
        order = sorted(zip(ids, texts), reverse=True)
        assert sorted(rows) == sorted(ids)
        for k, (i, text) in enumerate(order):
            a, b = text or "", order[(k + 1) % len(order)][1] or ""
            own, edited, other = L.edited_pair(a, b)
            r = rows[i]
            assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (r.fingerprint, r.edited_fingerprint) == (L.printed(own), L.printed(other))
            assert r.near_edited == L.likeness(own, other) and r.near_next == L.likeness(own, L.text_signature(b))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_tables(spark):
    docs = documents(spark, ["abc abc", "zz", "q", "q"], ids=[1, None, 4, 4])
    assert L.with_edits(docs).count() == 4
    assert L.with_edits(docs.limit(0)).count() == 0
    alone = L.with_edits(documents(spark, ["abcabc"])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
