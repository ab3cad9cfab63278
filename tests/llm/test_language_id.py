import random
import zlib

import numpy as np
import pytest

from pivotspark.llm import language_id as L

from .helpers import ODD_TEXTS, documents

WORDS = {"en": "the of and with that there thing other when".split(), "de": "der und nicht schön über zwischen auch ß".split(),
         "es": "el los que para según ción niño está".split()}


def corpus(n):
    rng = random.Random(4)
    langs = [rng.choice(sorted(WORDS)) for _ in range(n)]
    return [" ".join(rng.choice(WORDS[x]) for _ in range(rng.randint(8, 200))) for x in langs], langs


@pytest.fixture(scope="module")
def trained(spark):
    texts, langs = corpus(500)
    docs = documents(spark, texts, langs, extra=True)
    return docs, langs, L.fit(docs)


def test_held_out_accuracy(trained):
    docs, langs, model = trained
    rows = L.predict(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_the_other_two_thirds_are_learned_from(spark):
    texts, langs = corpus(200)
    wrong = [lang if zlib.crc32(str(i).encode()) % 3 != 1 else "zz" for i, lang in enumerate(langs)]
    sample = L.labelled_sample(documents(spark, texts, wrong), "doc_id", "text", "lang", 1000)
    assert {lang for lang, _ in sample} == set(WORDS)


def test_sample_is_of_different_texts(spark):
    texts, langs = corpus(400)
    few = [" ".join(WORDS["de"][i % 8:] + [str(i)]) for i in range(5)]
    docs = documents(spark, texts + few * 150, langs + ["few"] * 750)
    sample = L.labelled_sample(docs, "doc_id", "text", "lang", 20)
    got = [(lang, tuple(p)) for lang, p in sample]
    assert len(set(got)) == len(got)
    assert {lang: sum(x == lang for x, _ in got) for lang in {x for x, _ in got}} == {**dict.fromkeys(WORDS, 20), "few": 5}
    assert L.labelled_sample(docs.repartition(7, "text"), "doc_id", "text", "lang", 20) == sample


def test_languages_with_most_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    docs = documents(spark, [f"text {i}" for i in range(60)] + ["copy"] * 60, ["a"] * 40 + ["b"] * 20 + ["c"] * 60)
    assert {lang for lang, _ in L.labelled_sample(docs, "doc_id", "text", "lang", 10)} == {"a", "b"}


def test_label_and_id_are_no_inputs(spark, trained):
    _, _, model = trained
    texts, langs = corpus(60)
    a = [(r.lang_pred, r.score) for r in L.predict(documents(spark, texts, langs), model).orderBy("doc_id").collect()]
    other = documents(spark, texts, ["x"] * 60, ids=[1000 + i for i in range(60)])
    assert a == [(r.lang_pred, r.score) for r in L.predict(other, model).orderBy("doc_id").collect()]


def test_tables_give_the_convolution(trained):
    _, _, model = trained
    windows = np.random.default_rng(0).integers(0, 256, (5, L.WINDOW), dtype=np.uint8)
    pooled = []
    for width, filters, bias in zip(L.WIDTHS, model.filters, model.bias):
        x = model.embedding[windows]
        z = [sum(x[:, t + k] @ filters[k] for k in range(width)) + bias for t in range(L.WINDOW - width + 1)]
        pooled.append(np.maximum(np.max(z, axis=0), 0))
    want = L._softmax(np.concatenate(pooled, axis=1) @ model.weights + model.offset)
    assert np.allclose(model.scores(windows, model.tables()), want, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(1)
    model = L.train(rng.integers(0, 256, (8, 32), dtype=np.uint8), rng.integers(0, 2, 8), ["a", "b"], epochs=1)
    p = {"e": model.embedding, "w": model.weights, "o": model.offset}
    for w, f, b in zip(L.WIDTHS, model.filters, model.bias):
        p |= {f"f{w}": f, f"b{w}": b}
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, y = rng.integers(0, 256, (4, 32), dtype=np.uint8), np.array([0, 1, 1, 0])

    def loss():
        m = L.ByteCnn(["a", "b"], p["e"], [p[f"f{w}"] for w in L.WIDTHS], [p[f"b{w}"] for w in L.WIDTHS], p["w"], p["o"])
        pooled = []
        for width, f, b in zip(L.WIDTHS, m.filters, m.bias):
            e = m.embedding[x]
            z = sum(e[:, k:k + 32 - width + 1] @ f[k] for k in range(width)) + b
            pooled.append(np.maximum(z.max(axis=1), 0))
        s = L._softmax(np.concatenate(pooled, axis=1) @ m.weights + m.offset)
        return -np.log(s[np.arange(4), y]).mean()

    grads = L._gradients(p, x, y)
    for k, at in [("w", (3, 1)), ("o", (0,)), ("b3", (2,)), ("f2", (1, 3, 4)), ("f4", (0, 0, 7)), ("e", (int(x[0, 5]), 2))]:
        old = p[k][at]
        p[k][at] = old + 1e-5
        high = loss()
        p[k][at] = old - 1e-5
        low = loss()
        p[k][at] = old
        assert abs((high - low) / 2e-5 - grads[k][at]) < 1e-5, k


def test_odd_texts_and_no_model(spark, trained):
    _, _, model = trained
    rows = L.predict(documents(spark, ODD_TEXTS, extra=True), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[0].score == 0
    assert rows[ODD_TEXTS.index("!!! ### $$$")].lang_pred == "und" and rows[4].lang_pred == rows[5].lang_pred != "und"
    docs = documents(spark, ODD_TEXTS)
    assert L.fit(docs) is None and {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    assert L.keep_documents(docs, None).count() == len(ODD_TEXTS)
    kept = L.keep_documents(documents(spark, ODD_TEXTS, extra=True), model)
    assert "clash" not in kept.columns and kept.columns == documents(spark, [None], extra=True).columns
    assert 0 not in [r.doc_id for r in kept.collect()]
    assert L.predict(docs.limit(0), model).count() == 0 and L.keep_documents(docs.limit(0), model).count() == 0


def test_unlearned_languages_and_gibberish_go_and_mixed_texts_stay(spark, trained):
    _, _, model = trained
    rng = random.Random(8)
    every = [w for words in WORDS.values() for w in words]
    mixed = [" ".join(rng.choice(every) for _ in range(n)) for n in (40, 200, 900)]
    quoting = [" ".join(" ".join(rng.choice(WORDS[x]) for _ in range(8)) for x in rng.choices(sorted(WORDS), k=20)) for _ in range(5)]
    clean = [*mixed, *quoting, *corpus(30)[0]]
    letters = "abcdefghijklmnopqrstuvwxyz"
    foreign = [
        "Rząd ogłosił wczoraj szereg nowych środków mających na celu wsparcie rodzin i przedsiębiorstw dotkniętych kryzysem. " * 3,
        "Il governo ha annunciato ieri una serie di misure per sostenere le famiglie e le imprese colpite dalla crisi.",
        "Правительство объявило вчера о ряде новых мер поддержки семей и предприятий, пострадавших от кризиса.",
        "政府昨天宣布了一系列新措施以支持最近几个月受到经济危机影响的家庭和企业 " * 4,
        *(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (30, 200, 1000))]
    kept = {r.doc_id for r in L.keep_documents(documents(spark, clean + foreign, extra=True), model).collect()}
    assert kept == set(range(len(clean)))


def test_one_language_is_told_from_none(spark):
    texts, langs = corpus(300)
    own = [t for t, lang in zip(texts, langs) if lang == "en"]
    model = L.fit(documents(spark, own, ["en"] * len(own)))
    other = [t for t, lang in zip(texts, langs) if lang == "de"][:20]
    kept = {r.doc_id for r in L.keep_documents(documents(spark, own[:20] + other), model).collect()}
    assert kept == set(range(20))


def test_least_familiarity_is_of_all_held_out_texts(spark):
    """An exact quantile over every different held-out text, its copies once,
    and runs of all learned texts, not of a sample."""
    texts, langs = corpus(1500)
    texts = [f"{t} {t} {t}" for t in texts]
    docs = documents(spark, texts + texts[:300], langs + langs[:300])
    model = L.fit(docs, per_language=20)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(1800)]
    n = {}
    for t, lang in [x for x, h in zip(zip(texts + texts[:300], langs + langs[:300]), held) if not h]:
        runs, counts = L.byte_runs(L.cut(np.frombuffer(t.encode(), np.uint8)))
        for r in runs[counts].tolist():
            n[lang, r] = n.get((lang, r), 0) + 1
    whole = {lang: sum(c for (x, _), c in n.items() if x == lang) for lang in WORDS}
    known = {r for (lang, r), c in n.items() if c > 1 and c >= L.RUN_SHARE * whole[lang]}
    assert set(model.runs.tolist()) == known
    seen, shares = L._table(model.runs), {}
    for t, lang in {x for x, h in zip(zip(texts + texts[:300], langs + langs[:300]), held) if h}:
        share, runs = L.familiarity(L.cut(np.frombuffer(t.encode(), np.uint8)), np.array([0]), seen)
        if runs[0] >= L.LEAST_RUNS:
            shares.setdefault(lang, []).append(share[0])
    assert set(model.least) == set(WORDS)
    for lang, x in shares.items():
        assert model.least[lang] == pytest.approx(L.FAMILIAR_PART * np.quantile(x, L.FAMILIAR_QUANTILE))
