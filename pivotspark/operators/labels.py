"""Label construction on token sequences.

Raw pivot rows -> one probe row per id with a dense label array
(1 = the position before a pivot token, -1 = a sampled negative, 0 = other).

Per-id work is written as aggregates, not per-id windows, so that one id
holding a third of all rows is still combined map-side:
* the longest row per id is ``max(struct(length, -ord, ...))`` (longest
  wins, first in file order among ties);
* pivot positions are a ``collect_set`` of per-row candidates (bounded by
  the sequence length, deduplicated map-side);
* negative sampling orders each row's candidate positions by a seeded hash
  inside the row (``array_sort``), no explode + window needed.
The tokeniser is a column function ``string -> array<string>`` (default: split
on single spaces, empty tokens dropped).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Tokenizer = Callable[[Column], Column]
DEFAULT_VOCAB = 151936


def pin(df: DataFrame, *cols: str) -> DataFrame:
    """Keep computed array columns as row values.

    Catalyst inlines a column's defining expression into the next projection
    when it is referenced once -- also when that one reference sits inside a
    lambda, where it is then re-evaluated for every array element.  Referencing
    the column twice here stops the inlining, so each value is computed once
    per row."""
    return df.select(*[F.when(F.size(F.col(c)) >= 0, F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _seq(a: Column, b_excl: Column) -> Column:
    """[a, b) as an array; empty when a >= b (``sequence`` would count down)."""
    return F.when(a < b_excl, F.sequence(a, b_excl - 1)).otherwise(F.array().cast("array<int>"))


def _hash_pick(cands: Column, k: Column, seed, key: Column) -> Column:
    """k members of ``cands`` chosen without replacement by seeded hash,
    returned sorted."""
    ranked = F.array_sort(F.transform(cands, lambda p: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), p.cast("string"))).alias("h"),
        p.alias("p"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, F.greatest(k, F.lit(0))), lambda s: s["p"]))


# -- C1 ------------------------------------------------------------------------

def longest_context(rows: DataFrame, id_col: str = "dataset_item_id", ord_col: str = "row_ord") -> DataFrame:
    """Per id the row with the longest ``pivot_context`` (characters), first
    in file order among ties; text = context + token."""
    best = rows.groupBy(id_col).agg(F.max(F.struct(
        F.length("pivot_context").alias("len"), (-F.col(ord_col)).alias("neg_ord"),
        F.col("pivot_context").alias("ctx"), F.col("pivot_token").alias("tok"),
        F.col("query").alias("query"))).alias("b"))
    return best.select(id_col, F.col("b.query").alias("query"),
                       F.concat(F.col("b.ctx"), F.col("b.tok")).alias("longest_text"),
                       (-F.col("b.neg_ord")).alias("longest_ord"))


# -- C2 ------------------------------------------------------------------------

def prefix_digests(texts: DataFrame, id_col: str, text_col: str = "longest_text", sizes_col: str = "sizes") -> DataFrame:
    """(key = id as string, size, digest): SHA-256 of the text's first ``size`` UTF-8 bytes for
    each of its sizes up to its length, in one pass over the text."""
    schema = pa.schema([("key", pa.string()), ("size", pa.int32()), ("digest", pa.string())])

    def run(it):
        for batch in it:
            key, text, sizes = (batch.column(c) for c in ("key", "text", "sizes"))
            rows: list = []
            for i in range(batch.num_rows):
                raw, h, at = memoryview(text[i].as_py().encode()), hashlib.sha256(), 0
                for size in sizes[i].as_py():
                    if size > len(raw):
                        break
                    h.update(raw[at:size])
                    at = size
                    rows.append((key[i].as_py(), size, h.hexdigest()))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.array_sort(sizes_col).alias("sizes")).where(
        "text IS NOT NULL").mapInArrow(run, "key string, size int, digest string")


def pivot_positions(rows: DataFrame, tokenize: Tokenizer = T.whitespace_tokens,
                    id_col: str = "dataset_item_id", ord_col: str = "row_ord",
                    variant: str = "default") -> DataFrame:
    """(id, query, longest_text, tokens, pivots): the longest text gives
    len - 2 (if len > 1); every other row whose context + token is a prefix of
    it gives len(tokens(context)) - 1 (if > 0; the focused variant needs > 1
    tokens).  Divergent rows add nothing; rows without an id are left out.

    No text is joined to the rows of its id: a row sends the length and SHA-256
    of its own, the longest text its digest at the lengths that occur, and the
    two meet on (id, length, digest), so a hot id lies over many tasks."""
    min_len = 1 if variant == "default" else 2
    rows = rows.where(F.col(id_col).isNotNull())
    lg = longest_context(rows, id_col, ord_col)
    text = F.concat("pivot_context", "pivot_token")
    sent = rows.select(id_col, F.octet_length(text).alias("size"), F.sha2(text, 256).alias("digest"),
                       F.size(tokenize(F.col("pivot_context"))).alias("n"), F.col(ord_col).alias("_o"))
    sent = sent.where(F.col("digest").isNotNull() & (F.col("n") >= min_len)).groupBy(id_col, "size", "digest", "n").agg(
        F.min("_o").alias("_first"), F.max("_o").alias("_last"))
    sizes = sent.groupBy(id_col).agg(F.collect_set("size").alias("sizes"))  # at most the longest text's bytes
    known = prefix_digests(lg.join(sizes, id_col).select(id_col, "longest_text", "sizes"), id_col)
    hits = sent.join(known.withColumnsRenamed({"size": "_size", "digest": "_digest"}),
                     (F.col(id_col).cast("string") == F.col("key")) & (F.col("size") == F.col("_size")) & (F.col("digest") == F.col("_digest")))
    # a text's rows with their least and greatest order: the longest row alone is none of the others
    found = hits.groupBy(id_col, F.col("n") - 1).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).toDF(
        id_col, "_p", "_first", "_last")
    per = found.groupBy(id_col).agg(F.collect_set(F.struct("_p", "_first", "_last")).alias("_found"))
    out = lg.join(per, id_col, "left").withColumn("tokens", tokenize(F.col("longest_text")))
    others = F.transform(F.filter("_found", lambda f: (f["_first"] != F.col("longest_ord")) | (f["_last"] != F.col("longest_ord"))),
                         lambda f: f["_p"])
    own = F.when(F.size("tokens") > 1, F.array(F.size("tokens") - 2)).otherwise(F.array().cast("array<int>"))
    pivots = F.array_sort(F.array_union(F.coalesce(others, F.array().cast("array<int>")), own))
    return out.withColumn("pivots", pivots).select(id_col, "query", "longest_text", "longest_ord", "pivots", "tokens")


# -- C3 / C4 -------------------------------------------------------------------

def negative_candidates(df: DataFrame, tokenize: Tokenizer = T.whitespace_tokens, clamp: bool = True) -> DataFrame:
    """Positions [max(0, len(tokens(query)) - 1), len(tokens)) minus pivots."""
    qlen = F.size(tokenize(F.col("query")))
    start = F.greatest(qlen - 1, F.lit(0)) if clamp else qlen - 1
    return df.withColumn("candidates", F.array_except(_seq(start, F.size("tokens")), F.col("pivots")))


def sample_negatives(df: DataFrame, ratio: float = 2.0, seed=42, id_col: str = "dataset_item_id",
                     min_one: bool = True) -> DataFrame:
    """min(max(1, round_half_even(n_pos * ratio)), n_candidates) negatives,
    no replacement, chosen by seeded hash."""
    want = F.bround(F.size("pivots") * F.lit(float(ratio))).cast("int")
    if min_one:
        want = F.greatest(F.lit(1), want)
    k = F.least(want, F.size("candidates"))
    return df.withColumn("negatives", _hash_pick(F.col("candidates"), k, seed, F.col(id_col)))


# -- C5 ------------------------------------------------------------------------

def append_random_tokens(df: DataFrame, k: int, seed=42, vocab: int = DEFAULT_VOCAB,
                         id_col: str = "dataset_item_id") -> DataFrame:
    """``random_ids``: k uniform token ids in [0, vocab) per row, from the
    first 8 hex digits of md5(seed|id|i) (portable and reproducible)."""
    if k <= 0:
        return df.withColumn("random_ids", F.array().cast("array<long>"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(int(k))), lambda i: F.pmod(
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"),
                                             i.cast("string"))), 1, 8), 16, 10).cast("long"),
        F.lit(int(vocab))))
    return df.withColumn("random_ids", ids)


RANDOM_PREFIX = "tok"  # an appended id as it is written in the text


def token_id(token: Column, vocab: int = DEFAULT_VOCAB) -> Column:
    """Id of a token of the default tokenizer: the first 8 hex digits of its
    md5, modulo the vocabulary."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(int(vocab)))


# -- C6 ------------------------------------------------------------------------

def assemble_labels(df: DataFrame, length: Column) -> DataFrame:
    """Dense labels of ``length``: 1 at pivots, -1 at negatives (never
    overwriting a 1), 0 elsewhere; out-of-range positions are ignored."""
    lab = F.transform(_seq(F.lit(0), length), lambda i: F.when(F.array_contains("pivots", i), F.lit(1))
                      .when(F.array_contains("negatives", i), F.lit(-1)).otherwise(F.lit(0)))
    return df.withColumn("labels", lab)


# -- C7 / C8 -------------------------------------------------------------------

def build_probe_rows(rows: DataFrame, tokenize: Tokenizer = T.whitespace_tokens, ratio: float = 2.0,
                     seed=42, add_random_tokens: int = 5, vocab: int = DEFAULT_VOCAB,
                     id_col: str = "dataset_item_id", ord_col: str = "row_ord",
                     variant: str = "default") -> DataFrame:
    """C1-C6 for all ids: (original_dataset_item_id, text, tokens, token_ids,
    random_ids, labels, pivots, negatives).  Labels cover the longest text and
    the appended tokens, and so do ``text`` and ``token_ids``.
    ``variant='focused'`` is the older rule: prefix rows need > 1 token, ratio
    2 without the minimum of one, no clamp of the answer start."""
    focused = variant == "focused"
    p = pivot_positions(rows, tokenize, id_col, ord_col, variant)
    p = negative_candidates(p, tokenize, clamp=not focused)
    p = sample_negatives(p, 2.0 if focused else ratio, seed, id_col, min_one=not focused)
    p = append_random_tokens(p, 0 if focused else add_random_tokens, seed, vocab, id_col)
    appended = F.transform("random_ids", lambda i: F.concat(F.lit(RANDOM_PREFIX), i.cast("string")))
    p = p.withColumn("token_ids", F.concat(F.transform("tokens", lambda t: token_id(t, vocab)), F.col("random_ids")))
    p = p.withColumn("text", F.concat_ws(" ", F.col("longest_text"), appended))
    p = pin(p, "tokens", "negatives", "random_ids", "token_ids")
    p = pin(assemble_labels(p, F.size("tokens") + F.size("random_ids")), "labels")
    return p.select(F.col(id_col).alias("original_dataset_item_id"), "text",
                    "tokens", "token_ids", "random_ids", "labels", "pivots", "negatives")


# -- C9 / C10 / C11 --------------------------------------------------------------

def fit_labels_length(labels: Column, n: Column) -> Column:
    """Pad with 0 or truncate to n."""
    pad = F.array_repeat(F.lit(0), F.greatest(n - F.size(labels), F.lit(0)))
    return F.slice(F.concat(labels, pad), 1, n)


def double_negatives(df: DataFrame, tokenize: Tokenizer = T.whitespace_tokens, seed=42,
                     id_col: str = "original_dataset_item_id", tail_only: bool = False) -> DataFrame:
    """Add as many new -1 as exist.  Labels are first fitted to the token
    count of ``text``; candidates are 0-labelled positions from the first
    labelled one (``tail_only``: positions beyond the original array).  Rows
    without negatives keep their labels as they are."""
    n = F.size(tokenize(F.col("text")))
    orig_len = F.size("labels")
    fitted = fit_labels_length(F.col("labels"), n)
    d = pin(df.withColumn("_lab", fitted), "_lab")
    k = F.size(F.filter("labels", lambda x: x == -1))
    labelled = F.filter(F.transform("_lab", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    start = F.coalesce(F.array_min(labelled), F.lit(0))
    if tail_only:
        start = F.greatest(orig_len, F.lit(0))
    cands = F.filter(_seq(start, n), lambda i: F.element_at("_lab", i + 1) == 0)
    d = d.withColumn("_cands", cands)
    d = pin(d.withColumn("_new", F.when(k > 0, _hash_pick(F.col("_cands"), F.least(k, F.size("_cands")), seed,
                                                          F.col(id_col)))
                         .otherwise(F.array().cast("array<int>"))), "_new", "_lab")
    out = F.transform("_lab", lambda x, i: F.when(F.array_contains("_new", i), F.lit(-1)).otherwise(x))
    return pin(d.withColumn("labels", F.when(k > 0, out).otherwise(F.col("labels"))).drop("_lab", "_new", "_cands"), "labels")


# -- C12 / C13 / C14 ---------------------------------------------------------------

def explode_labeled_tokens(probe: DataFrame, states: DataFrame, id_col: str = "original_dataset_item_id",
                           state_id: str = "id") -> DataFrame:
    """Join long-form hidden states (id, layer, position, activation) with the
    labelled positions: label 1 -> 'pivotal', -1 -> 'non_pivotal'.  An
    equi-join on (id, position) keeps exactly the positions below
    min(len(states), len(labels)).

    ``posexplode_outer`` is used on computed label arrays on purpose: the
    plain generator makes the optimizer infer ``size(labels) > 0`` and push
    it (with the whole label expression substituted) into the join below,
    where it would be re-evaluated per candidate pair."""
    lab = probe.select(F.col(id_col).alias(state_id), F.posexplode_outer("labels").alias("position", "label")) \
        .where(F.col("label") != 0)
    j = states.join(lab, [state_id, "position"])
    return j.withColumn("bucket", F.when(F.col("label") == 1, "pivotal").otherwise("non_pivotal"))


def truncation_audit(probe: DataFrame, states: DataFrame, id_col: str = "original_dataset_item_id",
                     state_id: str = "id", max_rate: float = 0.01) -> DataFrame:
    """Rows whose state count differs from their label count, with the rate
    and whether it exceeds ``max_rate`` (then such rows are excluded)."""
    n_states = states.groupBy(state_id, "layer").agg(F.count(F.lit(1)).alias("n_states")) \
        .groupBy(state_id).agg(F.max("n_states").alias("n_states"))
    j = probe.select(F.col(id_col).alias(state_id), F.size("labels").alias("n_labels")).join(
        n_states, state_id, "left").fillna(0, ["n_states"])
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum((F.col("n_states") != F.col("n_labels")).cast("long")).alias("n_mismatched")) \
        .withColumn("rate", F.col("n_mismatched") / F.greatest(F.col("n_rows"), F.lit(1))) \
        .withColumn("exclude_mismatched", F.col("rate") > max_rate)


def label_context_view(probe: DataFrame, id_col: str = "original_dataset_item_id",
                       end_marker: str = "<END>") -> DataFrame:
    """Each labelled position with its token and the next one (or a marker)."""
    e = probe.select(id_col, "tokens", F.posexplode_outer("labels").alias("position", "label")).where(F.col("label") != 0)
    return e.select(id_col, "position", "label",
                    F.try_element_at("tokens", F.col("position") + 1).alias("token"),
                    F.coalesce(F.try_element_at("tokens", F.col("position") + 2), F.lit(end_marker))
                    .alias("next_token"))


# -- C15 / C16 / C17 / C18 ------------------------------------------------------------

def dataset_summary(rows: DataFrame, id_col: str = "dataset_item_id") -> DataFrame:
    first = F.col("query") == F.col("pivot_context")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(id_col).alias("unique_queries"),
                    F.sum(first.cast("long")).alias("first_token_pivotal"),
                    (F.avg(first.cast("double")) * 100).alias("first_token_pivotal_pct"))


def label_counts(acts: DataFrame) -> DataFrame:
    """Positives / negatives per split and layer."""
    return (acts.groupBy("split", "layer").pivot("label", [0, 1]).count().fillna(0)
            .withColumnRenamed("0", "negatives").withColumnRenamed("1", "positives"))


def dataset_diff(a: DataFrame, b: DataFrame, id_col: str = "original_dataset_item_id") -> DataFrame:
    """Per id: are the labels of the two datasets equal (null-safe)?"""
    j = a.select(id_col, F.col("labels").alias("_la")).join(
        b.select(id_col, F.col("labels").alias("_lb")), id_col, "full_outer")
    return j.select(id_col, F.col("_la").eqNullSafe(F.col("_lb")).alias("equal"))
