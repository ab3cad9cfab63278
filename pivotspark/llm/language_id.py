"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last of
which ends with the text (a shorter text is padded with spaces).  In each, filters of widths 2, 3 and 4 run over byte
embeddings, the largest response of each filter goes through a softmax layer,
and a text's score is the mean over all its windows.  The network is trained
in numpy on the driver on a bounded sample of labelled texts; prediction runs
in batches on the executors and sees the whole text.

The network names one of its languages for whatever it is given, and surely
so: its score does not tell a foreign text from a mixed one.  ``keep_documents``
therefore also asks how familiar a text is: the share of its runs of four bytes
(letters and single spaces) that the texts outside the held-out third show,
whatever the language.  A text that mixes learned languages is familiar throughout, one in
an unlearned language or of random letters is not.  The least share is measured
for each language on texts of the held-out third.  Runs and least shares come
from all labelled texts; only the network is fitted on a bounded sample.

A filter's response is a sum of one table row per byte of its width.  Rows for
two adjacent bytes are added up beforehand, so a response costs one or two
look-ups instead of a matrix product.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
and so is every text when no labelled row exists; a text of fewer than ``LEAST_RUNS`` runs, or in a language without a
held-out text, is taken as familiar; equal texts get equal results; ties go to the first language in alphabetical order; an empty table
gives an empty result; other columns are not looked at by ``predict`` and pass
through ``keep_documents`` whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import exact_group_quantile
from .chunks import text_slices
from .common import stored

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBEDDING = 8
FILTERS = 16
#: Different labelled texts a language that the network is fitted on, at most,
#: and languages that it learns, those with the most texts.
SAMPLE = 1500
LANGUAGES = 500
#: Bytes of a sampled text that reach the driver, at most: windows from its
#: start, middle and end.
SAMPLE_WINDOWS = 3
EPOCHS = 12
BATCH = 64
RATE = 0.01
SEED = 7
UNDETERMINED = "und"
#: A run is known when it is this part of a language's runs (and occurs twice).
RUN_SHARE = 2e-6
#: A text goes below this part of the familiarity that all but a twentieth of
#: its language's held-out texts have.
FAMILIAR_PART, FAMILIAR_QUANTILE = 0.8, 0.05
#: Runs of four bytes below which a text's familiarity says little.
LEAST_RUNS = 32
#: Runs are hashed into so many bits.
RUN_BITS = 24
#: Small ASCII letters for capitals, a space for what is no letter.
_FOLD = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b | 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], dtype=np.uint8)
#: What a byte counts among the spaces of a run; a digit rules the run out.
_SPACE = np.array([2 if 0x30 <= b <= 0x39 else int(_FOLD[b] == 0x20) for b in range(256)], dtype=np.uint8)
#: Windows that go through the network together.
TOGETHER = 256


@dataclass
class ByteCnn:
    languages: list[str]
    embedding: np.ndarray       # [256, EMBEDDING]
    filters: list[np.ndarray]   # of each width: [width, EMBEDDING, FILTERS]
    bias: list[np.ndarray]
    weights: np.ndarray         # [len(WIDTHS) * FILTERS, languages]
    offset: np.ndarray
    #: Hashes of the learned texts' runs of four bytes, and the least share of them
    #: in a text of each language; None: not measured.
    runs: np.ndarray | None = None
    least: dict[str, float] | None = None

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables whose rows add up to the responses: one of
        65,536 rows for each two bytes, one of 256 for a single last byte."""
        out = []
        for w, bias in zip(self.filters, self.bias):
            single = [(self.embedding @ k).astype(np.float32) for k in w]
            single[0] = single[0] + bias.astype(np.float32)
            out.append([
                (single[i][:, None, :] + single[i + 1][None, :, :]).reshape(65536, -1) if i + 1 < len(single) else single[i]
                for i in range(0, len(single), 2)])
        return out

    def scores(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Softmax scores of ``windows`` [n, WINDOW] of bytes."""
        pooled = []
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        for width, parts in zip(WIDTHS, tables):
            n = windows.shape[1] - width + 1
            total = None
            for k, rows in enumerate(parts):
                at = 2 * k
                index = pairs[:, at:at + n] if len(rows) == 65536 else windows[:, at:at + n]
                got = rows.take(index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(np.maximum(total.max(axis=1), 0))
        return _softmax(np.concatenate(pooled, axis=1) @ self.weights.astype(np.float32) + self.offset.astype(np.float32))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteCnn:
    """Adam on the cross entropy of single windows [n, WINDOW] of bytes."""
    rng = np.random.default_rng(seed)
    params = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "w": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))),
              "o": np.zeros(len(languages))}
    for width in WIDTHS:
        params[f"f{width}"] = rng.normal(0, (width * EMBEDDING) ** -0.5, (width, EMBEDDING, FILTERS))
        params[f"b{width}"] = np.zeros(FILTERS)
    params = {k: v.astype(np.float32) for k, v in params.items()}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            grads = _gradients(params, windows[own], labels[own])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return ByteCnn(languages, params["e"], [params[f"f{w}"] for w in WIDTHS], [params[f"b{w}"] for w in WIDTHS],
                   params["w"], params["o"])


def _gradients(p: dict, windows: np.ndarray, labels: np.ndarray) -> dict:
    n = len(windows)
    rows = np.arange(n)[:, None]
    x = p["e"][windows]
    pooled, where = [], []
    for width in WIDTHS:
        length = windows.shape[1] - width + 1
        z = sum(x[:, k:k + length] @ p[f"f{width}"][k] for k in range(width)) + p[f"b{width}"]
        best = z.argmax(axis=1)
        where.append(best)
        pooled.append(np.take_along_axis(z, best[:, None, :], axis=1)[:, 0])
    h = np.concatenate(pooled, axis=1)
    a = np.maximum(h, 0)
    d = _softmax(a @ p["w"] + p["o"])
    d[np.arange(n), labels] -= 1
    d /= n
    grads = {"w": a.T @ d, "o": d.sum(axis=0), "e": np.zeros_like(p["e"])}
    back = (d @ p["w"].T) * (h > 0)
    for i, width in enumerate(WIDTHS):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]
        grads[f"b{width}"] = g.sum(axis=0)
        grads[f"f{width}"] = np.zeros_like(p[f"f{width}"])
        for k in range(width):
            byte = windows[rows, where[i] + k]                     # [n, FILTERS]
            grads[f"f{width}"][k] = np.einsum("nfe,nf->ef", p["e"][byte], g)
            np.add.at(grads["e"], byte, g[:, :, None] * p[f"f{width}"][k].T[None])
    return grads


def cut(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Windows over all of a text's bytes: the last one ends with the text, a
    shorter text is padded with spaces."""
    if len(data) < size:
        return np.append(data, np.full(size - len(data), 0x20, dtype=np.uint8))[None]
    whole = len(data) // size * size
    out = data[:whole].reshape(-1, size)
    return out if whole == len(data) else np.concatenate([out, data[None, -size:]])


def byte_runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of four bytes in ``windows`` [n, WINDOW], and which
    of them count: those with one space at most and no digit."""
    folded, space = _FOLD[windows], _SPACE[windows]
    n = windows.shape[1] - 3
    run, spaces = np.zeros((len(windows), n), np.uint32), np.zeros((len(windows), n), np.uint8)
    for k in range(4):
        run = run << np.uint32(8) | folded[:, k:k + n]
        spaces += space[:, k:k + n]
    return run * np.uint32(0x9E3779B1) >> np.uint32(32 - RUN_BITS), spaces <= 1


def familiarity(windows: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of known runs of each text, whose windows begin at ``starts``, 1
    for a text of fewer than ``LEAST_RUNS``; and its number of runs."""
    known, all_runs = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for i in range(0, len(windows), TOGETHER):
        runs, counts = byte_runs(windows[i:i + TOGETHER])
        known[i:i + TOGETHER] = (seen[runs] & counts).sum(axis=1)
        all_runs[i:i + TOGETHER] = counts.sum(axis=1)
    known, all_runs = np.add.reduceat(known, starts), np.add.reduceat(all_runs, starts)
    return np.where(all_runs < LEAST_RUNS, 1.0, known / np.maximum(all_runs, 1)), all_runs


def _table(runs: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << RUN_BITS, bool)
    seen[runs] = True
    return seen


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list:
    """(language, pieces of text) of ``per_language`` different texts a
    language, or all if it has fewer, from labelled rows outside the held-out
    third: those with the smallest hashes, whatever the partitions
    and however many copies a text has.  A first scan estimates how many texts
    each language has; about twice as many as wanted are then ranked, and the
    driver gets a few windows of each."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"), docs[lang_col].alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~F.coalesce(held_out(F.col("i")), F.lit(True)))
    rows = rows.select("l", "t", F.xxhash64("t").alias("h")).withColumn("u", F.pmod("h", F.lit(1 << 30)))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    n = F.char_length("t")
    pieces = F.when(n <= SAMPLE_WINDOWS * WINDOW, F.array("t")).otherwise(F.array(*[
        F.substring(F.col("t"), (F.floor((n - WINDOW) * k / (SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW))
        for k in range(SAMPLE_WINDOWS)]))
    chosen = rows.join(F.broadcast(sizes), "l").where(F.col("u") < F.lit(2.0 * per_language * (1 << 30)) / F.col("n"))
    texts = chosen.select("l", "u", "h", pieces.alias("p")).groupBy("l", "u", "h").agg(F.min("p").alias("p"))
    order = Window.partitionBy("l").orderBy("u", "h")
    first = texts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    return sorted((r["l"], r["p"]) for r in first.select("l", "p").collect())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE, measure: bool = True) -> ByteCnn | None:
    """A network trained on ``labelled_sample``; None without labelled rows.
    With ``measure`` it also knows all learned texts' runs of bytes and the least
    familiarity of each language, which ``keep_documents`` asks for."""
    sample = labelled_sample(docs, id_col, text_col, lang_col, per_language)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    windows, labels = [], []
    for lang, pieces in sample:
        own = np.concatenate([cut(np.frombuffer(p.encode(), np.uint8)) for p in pieces])
        own = own[(own != 0x20).sum(axis=1) >= 16] if len(own) > 1 else own
        windows.append(own)
        labels += [languages.index(lang)] * len(own)
    model = train(np.concatenate(windows), np.array(labels), languages)
    if measure:
        model.runs = known_runs(docs, languages, id_col, text_col, lang_col)
        model.least = least_familiarity(docs, model, id_col, text_col, lang_col)
    return model


def _labelled(docs: DataFrame, languages: list[str], id_col: str, text_col: str, lang_col: str, held: bool) -> DataFrame:
    """(l, h, __text): labelled rows in ``languages``, in the held-out third or
    outside it; h is a hash of the text."""
    rows = docs.select(docs[lang_col].alias("l"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("__text"),
                       F.coalesce(held_out(docs[id_col]), F.lit(not held)).alias("held"))
    return rows.where(F.col("l").isin(languages) & F.col("__text").isNotNull() & (F.col("held") == held)).drop("held")


def known_runs(docs: DataFrame, languages: list[str], id_col: str, text_col: str, lang_col: str) -> np.ndarray:
    """Hashes of the runs of four bytes that all learned texts show: those that
    occur twice in a language, and are ``RUN_SHARE`` of its runs at least, so
    that a few foreign words in many texts do not make a language known."""
    rows = _labelled(docs, languages, id_col, text_col, lang_col, held=False).select("l", "__text")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                cuts = [cut(np.frombuffer(t, np.uint8)) for t in texts.cast(pa.binary()).to_pylist()]
                windows, coded = np.concatenate(cuts), part.column(0).dictionary_encode()
                lang = np.repeat(np.asarray(coded.indices, dtype=np.int64), [len(c) for c in cuts])
                found = []
                for i in range(0, len(windows), TOGETHER):
                    runs, counts = byte_runs(windows[i:i + TOGETHER])
                    found.append((runs + (lang[i:i + TOGETHER, None] << RUN_BITS))[counts])
                code, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(code >> RUN_BITS)), pa.array((code & (1 << RUN_BITS) - 1).astype(np.int32)), pa.array(n)],
                    names=["l", "run", "n"])

    counts = stored(rows.mapInArrow(run, "l string, run int, n bigint").groupBy("l", "run").agg(F.sum("n").alias("n")), "language-runs")
    whole = counts.groupBy("l").agg(F.sum("n").alias("all"))
    known = counts.join(F.broadcast(whole), "l").where((F.col("n") > 1) & (F.col("n") >= F.col("all") * F.lit(RUN_SHARE)))
    return np.array(sorted(r["run"] for r in known.select("run").distinct().collect()), dtype=np.uint32)


def least_familiarity(docs: DataFrame, model: ByteCnn, id_col: str, text_col: str, lang_col: str) -> dict[str, float]:
    """For each language the least familiarity that a text of it must have, by
    all different texts of the held-out third: an exact quantile."""
    rows, known = _labelled(docs, model.languages, id_col, text_col, lang_col, held=True), model.runs

    def run(batches):
        seen = _table(known)
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                cuts = [cut(np.frombuffer(t, np.uint8)) for t in texts.cast(pa.binary()).to_pylist()]
                sizes = np.array([len(c) for c in cuts])
                shares, runs = familiarity(np.concatenate(cuts), np.cumsum(sizes) - sizes, seen)
                long = pa.array(runs >= LEAST_RUNS)
                yield pa.RecordBatch.from_arrays([x.filter(long) for x in (part.column(0), part.column(1), pa.array(shares))],
                                                 names=["l", "h", "share"])

    shares = rows.mapInArrow(run, "l string, h bigint, share double").groupBy("l", "h").agg(F.min("share").alias("share"))
    found = exact_group_quantile(shares, ["l"], "share", FAMILIAR_QUANTILE)
    return {r["l"]: FAMILIAR_PART * r["quantile"] for r in found.collect()}


def _predictor(model: ByteCnn | None, judge: bool = False):
    """Function from an Arrow array of texts to (languages, scores, which are
    familiar; all without ``judge``)."""
    tables = model.tables() if model else None
    seen = _table(model.runs) if judge and model and model.runs is not None else None

    def run(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
        langs, scores, familiar = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if model is None:
            return langs, scores, familiar
        rows = np.flatnonzero(letters)
        cuts = [cut(np.frombuffer(t, np.uint8)) for t in texts.cast(pa.binary()).take(pa.array(rows)).to_pylist()]
        if not cuts:
            return langs, scores, familiar
        windows = np.concatenate(cuts)
        each = np.concatenate([model.scores(windows[i:i + TOGETHER], tables) for i in range(0, len(windows), TOGETHER)])
        sizes = np.array([len(c) for c in cuts])
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(each.astype(np.float64), starts, axis=0) / sizes[:, None]
        best = mean.argmax(axis=1)
        for i, b in zip(rows.tolist(), best.tolist()):
            langs[i] = model.languages[b]
        scores[rows] = np.clip(mean[np.arange(len(rows)), best], 0, 1)
        if seen is not None:
            least = np.array([model.least.get(lang, 0.0) for lang in model.languages])
            familiar[rows] = familiarity(windows, starts, seen)[0] >= least[best]
        return langs, scores, familiar

    return run


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                       F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"))

    def run(batches):
        of = _predictor(model)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                langs, scores, _ = of(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores)],
                                                 names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_documents(docs: DataFrame, model: ByteCnn | None, wanted: list[str] | None = None, min_score: float = 0.0,
                   text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose language is one of ``wanted`` (any that was
    learned) with at least ``min_score`` and whose text is familiar; ``und``
    goes, and so do texts in other languages or scripts and random letters.  A
    clean text that quotes other learned languages has a low score but is
    familiar, so there is no least score unless it is asked for.  Without a
    model nothing can be told apart and all rows stay."""
    if model is None:
        return docs
    wanted = model.languages if wanted is None else wanted

    def run(batches):
        of = _predictor(model, judge=True)
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                langs, scores, familiar = of(texts)
                keep = [lang in wanted and s >= min_score and f for lang, s, f in zip(langs, scores.tolist(), familiar.tolist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
