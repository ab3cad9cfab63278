import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pivotspark.llm import periodic_runs as P
from pivotspark.llm import queries as Q

from .helpers import ODD_TEXTS, documents, prose


def brute_runs(words, min_length=6, exponent=4):
    """Every lag, every maximal stretch; the smallest period of a stretch."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            e, part = j + q, words[i:j + q]
            if e - i >= max(min_length, exponent * q) and not any(
                    part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, e - i, q))
            i = j
    return sorted((s, length, q) for s, length, q in out)


def brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_words():
    rng = random.Random(4)
    docs = []
    for k in range(600):
        letters = "ab" if k % 3 else "abc"
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 90))]
        if k % 2:
            root = [rng.choice("abcde"[:rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 30))]
            words = words[:10] + (root * 9)[:rng.randrange(1, 9 * len(root) + 1)] + words[10:20]
        docs.append(words)
    codes = np.array([ord(w) for d in docs for w in d])
    sizes = np.array([len(d) for d in docs])
    found = [[] for _ in docs]
    for d, *run in P.find_runs(codes, np.cumsum(sizes) - sizes).tolist():
        found[d].append(tuple(run))
    assert found == [brute_runs(d) for d in docs]
    assert sum(map(len, found)) > 300 and max(q for f in found for *_, q in f) > 20


def edited(doc_id, text):
    words = words_of(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapse(words, runs)))


def test_query_by_brute_force(spark, tmp_path):
    texts = [*ODD_TEXTS, *("la " * n for n in range(9)), *(prose(i, 80 + 7 * i) for i in range(60))]
    docs = documents(spark, [*texts, "x x x x x x"], ids=[*range(len(texts)), None], extra=True)
    docs.unionByName(docs.where("doc_id = 11")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, Q.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    want = [expected(i, edited(i, t)) for i, t in enumerate(texts)] + [expected(None, ["x"] * 6), expected(11, edited(11, texts[11]))]
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 8


def test_long_texts_and_slices(spark, monkeypatch):
    root = [str(i) for i in range(4000)]
    words = ["a"] * 50000 + root * 5 + ["b", "c"] * 30000
    assert P.find_runs(np.unique(words, return_inverse=True)[1], np.array([0]))[:, 1:].tolist() == [
        [0, 50000, 1], [50000, 20000, 4000], [70000, 60000, 2]]
    monkeypatch.setattr(P, "SLICE_BYTES", 100)
    texts = [prose(i, 50) + " again and" * 5 for i in range(20)]
    got = {r.doc_id: r for r in P.detect(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        runs = brute_runs(t.split())
        assert [tuple(r) for r in got[i].runs] == runs and got[i].collapsed == brute_collapse(t.split(), runs)


def test_empty_table(spark):
    out = P.digests(P.detect(P.with_periodic_tails(documents(spark, ["a"], extra=True).limit(0))))
    assert out.count() == 0


@pytest.mark.parametrize("n", [5, 6])
def test_shortest_run(n):
    assert len(P.find_runs(np.zeros(n, np.int64), np.array([0]))) == (n == 6)
