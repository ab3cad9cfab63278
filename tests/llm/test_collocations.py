import random
import re
from collections import Counter

import numpy as np
import pytest

from pivotspark.llm import collocations as C

from .helpers import ODD_TEXTS, documents, prose


def brute(rows, least, top, inside=80):
    """(lang, text) rows -> the reported rows, by counting all phrases."""
    f, n = {}, Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                   if 100 * a >= inside * cand[p[i:i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in dropped:
                s, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus():
    texts = [prose(i, 150) for i in range(60)] + ["New York City, new york CITY new york city of light\tof stone"] * 40
    langs = [["en", "fr", None, "und"][i % 4] for i in range(len(texts))]
    odd = ODD_TEXTS * 2
    return texts + odd, langs + ["en"] * len(odd)


@pytest.mark.parametrize("least,top,shard", [(30, 2000, 1 << 20), (3, 50, 1 << 20), (5, 200, 40)])
def test_by_brute_force(spark, monkeypatch, least, top, shard):
    monkeypatch.setattr(C, "SLICE", 4000)
    texts, langs = corpus()
    got = C.collocations(documents(spark, texts, langs, extra=True), least=least, top=top, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(zip(langs, texts), least, top)
    assert sorted(map(tuple, got.collect())) == want
    assert {len(r[2].split()) for r in want} == {2, 3, 4}


def test_large_counts_stay_exact(spark):
    big = 10 ** 15
    phrases = spark.createDataFrame([([1], big + 7), ([2], big + 1), ([1, 2], big - 3)], "p array<bigint>, f bigint")
    row = C.scored(phrases).first()
    assert row.score == 2000000 * (big - 3) // (2 * big + 8)


@pytest.mark.parametrize("n,words,depth", [(1, 3, 1), (300, 12, 3), (5000, 400, 2), (20000, 900, 3), (400, 400, 1)])
def test_trie_holds_its_phrases_only(n, words, depth):
    rng = np.random.default_rng(n)
    draw = lambda: np.minimum(rng.zipf(1.3, (n, depth)), words).astype(np.uint64) * np.uint64(7919)
    phrases = np.unique(draw(), axis=0)
    alphabet, base, check, phrase, _ = C.DoubleArray(phrases).arrays()
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    probes = np.concatenate([phrases, draw()])
    states = np.zeros(len(probes), dtype=np.int64)
    for d in range(depth):
        at = np.minimum(np.searchsorted(alphabet, probes[:, d]), len(alphabet) - 1)
        states = C.step(base, check, states, np.where(alphabet[at] == probes[:, d], at + 1, 0))
    found = np.where(states >= 0, phrase[states], -1)
    assert found.tolist() == [known.get(tuple(p), -1) for p in probes.tolist()]


def test_nothing_frequent(spark):
    docs = documents(spark, ["a b c", None], extra=True)
    assert C.collocations(docs).count() == 0
    assert C.collocations(docs.limit(0)).count() == 0


def test_oracle_agrees_with_brute_force(spark):
    import duckdb
    import pandas as pd
    texts, langs = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"text": texts, "lang": langs}))
    assert sorted(con.sql(C.oracle_sql(5, 100)).fetchall()) == brute(zip(langs, texts), 5, 100)


def test_random_pieces(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "c", " ", "\t", ".", "\n", "\x0b", "\x1c", "é"]) for _ in range(400)) for _ in range(40)]
    got = C.collocations(documents(spark, texts, ["x"] * 40), least=4, top=300)
    assert sorted(map(tuple, got.collect())) == brute([("x", t) for t in texts], 4, 300)
