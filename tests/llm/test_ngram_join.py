import random
import re

import numpy as np
import pytest

from pivotspark.llm import ngram_join as J

from .helpers import ODD_TEXTS, documents, prose


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(ids, texts, percent=80):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, d in enumerate(ids)), key=str)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [str(rng.randrange(10 ** 6))]
    return " ".join(words)


def corpus():
    """Copies, near copies on both sides of the bound, chains of them, passages
    that many share, short texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, passage = list(ODD_TEXTS), prose(99, 60, vocabulary)
    for i in range(12):
        base = prose(i, [9, 14, 40, 90, 200, 400][i % 6], vocabulary)
        texts += [base, base.upper() if i % 2 else base]
        texts += [changed(rng, base, n) for n in (1, 1, 2, 3, 5, 8) for _ in range(2)]
        chain = base
        for _ in range(6):
            chain = changed(rng, chain, max(1, len(base.split()) // 60))
            texts.append(chain)
    texts += [prose(200 + i, 15 + i, vocabulary) + " " + passage for i in range(60)]
    texts += [passage + f" x{i}" for i in range(40)] + [f"order number now shipped to {i} thanks" for i in range(30)]
    texts += [" ".join(vocabulary[:n]) for n in range(1, 30)]
    return texts


@pytest.mark.parametrize("hot,chunk,look", [(1024, 1024, 64), (8, 10, 2), (3, 3, 1)])
def test_by_brute_force(spark, monkeypatch, hot, chunk, look):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "LOOK", look)
    if hot < 1024:
        monkeypatch.setattr(J, "LOOK_SETS", 2 * hot)
        monkeypatch.setattr(J, "ROWS", 50)
    texts = corpus()
    ids = [7 * i % 1009 for i in range(len(texts))]
    texts, ids = texts + ["lonely null"] * 2 + [texts[20]], ids + [None, None, ids[20]]
    docs = documents(spark, texts, ids=ids, extra=True)
    if hot < 1024:
        assert J.large_buckets(docs, "text", 5, 80)
    got = sorted(map(tuple, J.near_duplicates(docs).collect()), key=str)
    want = brute(ids, texts)
    assert got == want
    assert 100 < sum(r[0] != r[2] for r in want) < len(want) - 100


def test_oracle_agrees_with_brute_force():
    import duckdb
    import pandas as pd
    texts = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert sorted(con.sql(J.oracle_sql()).fetchall(), key=str) == brute(range(len(texts)), texts)


def test_linked_sets_always_share_a_kept_block():
    """Sets at the bound itself, in all bands up to 2,000 tokens; 1 + spare
    kept blocks agree."""
    rng = np.random.default_rng(5)
    spare = J.plan(80)[2]
    for n in [*range(1, 60), *rng.integers(60, 2000, 60).tolist()]:
        for _ in range(5):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            common = rng.permutation(a)[:rng.integers(-(-4 * n // 5), n + 1)]
            extra = len(common) * 100 // 80 - n
            b = np.concatenate([common, rng.integers(0, 1 << 63, max(0, rng.integers(0, extra + 1)) if extra > 0 else 0, dtype=np.uint64)])
            if 100 * len(common) < 80 * (n + len(b) - len(common)):
                continue
            which, bucket = J.blocks(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), 80)
            same = set(bucket[which == 0].tolist()) & set(bucket[which == 1].tolist())
            band = int(np.searchsorted(J.LOW, min(len(a), len(b)), side="right")) - 1
            assert sum(x & 255 == band for x in same) >= 1 + spare[band]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(6)
    for n, m in [(30, 33), (500, 700), (64, 31)]:
        pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2:n // 2 + m])
        s, t = J.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        size = min(len(s), len(t))
        apart = int(np.bitwise_count(J.folded(s, size) ^ J.folded(t, size)).sum())
        assert apart <= len(np.setxor1d(a, b)) and apart % 2 == len(np.setxor1d(a, b)) % 2


def test_empty_table(spark):
    docs = documents(spark, ["a"], extra=True)
    assert J.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(map(tuple, J.near_duplicates(documents(spark, [None, " "])).collect())) == [(0, 0, 0), (1, 0, 1)]


def test_single_word_shingles(spark):
    texts = ["a b c d e", "a b c d e f", "a b c x y", "e d c b a"]
    got = {r.doc_id: r.component_id for r in J.near_duplicates(documents(spark, texts), shingle=1).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}


def _edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10 ** 9)}"
    return " ".join(out)


def test_pairs_tried_before_are_not_brought_again(spark, monkeypatch):
    """A large group of near copies beside sets that just miss it: the walk of
    all pairs brings few rows, however many buckets they share."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] + [_edited(rng, base, 2) for _ in range(60)] + [_edited(rng, base, 9) for _ in range(12)]
    docs, rows, old = documents(spark, texts), {}, J.walked

    def walked(*args, every, **more):
        out = J.stored(old(*args, every=every, **more), "walked")
        rows[every] = out.count()
        return out

    monkeypatch.setattr(J, "walked", walked)
    got = sorted(map(tuple, J.near_duplicates(docs).collect()), key=str)
    assert got == brute(list(range(len(texts))), texts)
    assert rows[True] <= 3 * len(texts)


def test_pairs_of_one_set_are_decided_in_several_places(spark, monkeypatch):
    monkeypatch.setattr(J, "TOGETHER", 3)
    texts = corpus()
    got = sorted(map(tuple, J.near_duplicates(documents(spark, texts)).collect()), key=str)
    assert got == brute(list(range(len(texts))), texts)


def test_texts_without_a_pair_are_not_shuffled(spark):
    """Whatever the join with the needed texts costs, few others get there."""
    texts = [f"text number {i}" for i in range(3000)] + [None, "", "text number 7"]
    docs = documents(spark, texts, extra=True)
    needed = docs.where("doc_id % 50 = 7 and doc_id < 3000").selectExpr("xxhash64(text) as th", "doc_id as key")
    got = [r["__text"] for r in J.wanted_texts(docs, "text", needed).collect()]
    want = [t for i, t in enumerate(texts) if i < 3000 and i % 50 == 7] + ["text number 7"]
    assert not set(want) - set(got) and got.count("text number 7") == 2
    assert len(got) < 0.1 * len(texts)
    assert J.wanted_texts(docs, "text", needed.limit(0)).count() == 0
