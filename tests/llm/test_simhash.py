import random
import re

import numpy as np
import pytest
import xxhash

from pivotspark.llm import chunks as C
from pivotspark.llm import simhash as S
from pivotspark.llm.common import stored
from pivotspark.llm.components import connected_components

from .helpers import ODD_TEXTS, documents, prose


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, max_bits=4):
    """Smallest index of the component of each fingerprint."""
    up = list(range(len(values)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if int(values[i] ^ values[j]).bit_count() <= max_bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def clustered(seed, n):
    """Fingerprints in chains and dense clusters among spread ones."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 2, 5, 40])):
            out.append(x)
            for bit in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5])):
                x ^= 1 << bit
    return np.array(out[:n], dtype=np.uint64)


def near_texts():
    """Copies, near copies with a few words changed, and others."""
    rng, out = random.Random(5), list(ODD_TEXTS)
    for k in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(400)]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(own))
    return out


def test_fingerprints():
    texts = [t or "" for t in near_texts()] + ["word " * 70000]
    got = S.text_fingerprints([t.encode() for t in texts])
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


def test_long_texts_piece_by_piece(monkeypatch):
    texts = [(t or "").encode() for t in near_texts()]
    want = S.text_fingerprints(texts)
    monkeypatch.setattr(S, "LONG_TEXT", 0)
    monkeypatch.setattr(S, "pieces", lambda t: C.pieces(t, 7))
    assert np.array_equal(want, S.text_fingerprints(texts))


@pytest.mark.parametrize("chunk", [8, 2048])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    values = np.unique(clustered(chunk, 1500))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.u: r.root for r in S.groups(stored(prints, "test")).collect()}
    signed = values.view(np.int64).tolist()
    want = brute_groups(values)
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(w, []).append(v)
    for members in groups.values():
        assert {roots.get(v, v) for v in members} == {min(members)}


@pytest.mark.parametrize("n", [10, 10 ** 6, 10 ** 8, 10 ** 11, 10 ** 14])
def test_some_choice_of_blocks_agrees(n):
    rng, choices = random.Random(n), S.block_choices(n, 4)
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(all(not bits >> low & (1 << width) - 1 for low, width in c) for c in choices)


def test_documents(spark):
    texts = near_texts()
    rows = {r.doc_id: r for r in S.near_duplicates(documents(spark, texts, extra=True).repartition(4)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == brute_groups(np.array(prints, dtype=np.uint64))


def test_one_row_of_each_group_stays(spark):
    a, b = prose(1, 50), "quite another text of seven words"
    docs = documents(spark, [a, a, a, b, None, ""], ids=[7, 3, 3, 9, None, 4], extra=True)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert S.keep_one(docs.limit(0)).count() == 0 and S.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "v w x y z q"], ids=[None, 2, None])
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == [(2, 2), (None, 2), (None, None)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 400)] + [(7, 7), (160, 3)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 3 for i in range(100, 161)}, **{i: 5 for i in range(300, 400)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
