"""Registered queries for label construction and the
pivot-row scans it starts from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec
from ..operators import labels as L
from ..operators import sampling as S
from ..sources import fixtures as X
from ..sources.sinks import new_path, read_split
from .registry import query, tidy, with_ctes

RATIO, SEED, K_RANDOM, VOCAB = 2.0, 42, 5, 151936


def _tok(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def _pick(cands: str, k: str, key: str) -> str:
    """SQL twin of labels._hash_pick."""
    return (f"list_sort(list_transform(list_sort(list_transform({cands}, lambda p: "
            f"{{'h': md5('{SEED}|' || CAST({key} AS VARCHAR) || '|' || CAST(p AS VARCHAR)), 'p': p}}))"
            f"[1:greatest({k}, 0)], lambda s: s.p))")


def _probe_local(focused: bool = False):
    min_len = 2 if focused else 1
    want = "CAST(round_even(len(pivots) * 2.0, 0) AS INTEGER)" if focused else \
        f"greatest(1, CAST(round_even(len(pivots) * {RATIO}, 0) AS INTEGER))"
    start = f"len({_tok('query')}) - 1" if focused else f"greatest(len({_tok('query')}) - 1, 0)"
    k_rand = 0 if focused else K_RANDOM
    rand = (f"list_transform(range(1, {k_rand + 1}), lambda i: (('0x' || substr(md5('{SEED}|' || "
            f"dataset_item_id || '|' || CAST(i AS VARCHAR)), 1, 8))::BIGINT) % {VOCAB})") if k_rand else \
        "CAST([] AS BIGINT[])"
    return [
        ("lg", """SELECT dataset_item_id, query, pivot_context || pivot_token AS longest_text, row_ord AS longest_ord
                  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_item_id
                                                     ORDER BY length(pivot_context) DESC, row_ord) AS rn
                        FROM pivot_rows) WHERE rn = 1"""),
        ("pos", f"""SELECT r.dataset_item_id,
                      CASE WHEN r.row_ord = l.longest_ord
                           THEN CASE WHEN len({_tok('l.longest_text')}) > 1 THEN len({_tok('l.longest_text')}) - 2 END
                           WHEN starts_with(l.longest_text, r.pivot_context || r.pivot_token)
                                AND len({_tok('r.pivot_context')}) >= {min_len}
                           THEN len({_tok('r.pivot_context')}) - 1 END AS p
                    FROM pivot_rows r JOIN lg l ON r.dataset_item_id = l.dataset_item_id"""),
        ("piv", """SELECT dataset_item_id,
                          coalesce(list_sort(list_distinct(list(p) FILTER (WHERE p IS NOT NULL))), []) AS pivots
                   FROM pos GROUP BY dataset_item_id"""),
        ("cand", f"""SELECT l.dataset_item_id, l.query, l.longest_text, {_tok('l.longest_text')} AS tokens, p.pivots,
                            list_filter(range({start}, len({_tok('l.longest_text')})),
                                        lambda i: NOT list_contains(p.pivots, i)) AS candidates
                     FROM lg l JOIN piv p ON l.dataset_item_id = p.dataset_item_id"""),
        ("neg", f"""SELECT *, {_pick('candidates', f'least({want}, len(candidates))', 'dataset_item_id')}
                               AS negatives,
                           {rand} AS random_ids
                    FROM cand"""),
        ("probe", f"""SELECT dataset_item_id AS original_dataset_item_id,
                            array_to_string(list_concat([longest_text], list_transform(random_ids, lambda i: 'tok' || i)), ' ')
                                AS text, tokens, random_ids,
                            list_concat(list_transform(tokens, lambda t:
                                ('0x' || substr(md5(t), 1, 8))::BIGINT % {VOCAB}), random_ids) AS token_ids,
                            pivots, negatives,
                            list_transform(range(0, len(tokens) + len(random_ids)), lambda i:
                                CASE WHEN list_contains(pivots, i) THEN 1
                                     WHEN list_contains(negatives, i) THEN -1 ELSE 0 END) AS labels
                     FROM neg"""),
    ]


_PROBE_OUT = """SELECT original_dataset_item_id, text, CAST(len(tokens) AS BIGINT) AS n_tokens,
       array_to_string(token_ids, ',') AS token_ids,
       array_to_string(pivots, ',') AS pivots, array_to_string(negatives, ',') AS negatives,
       array_to_string(random_ids, ',') AS random_ids, array_to_string(labels, ',') AS labels FROM probe"""


def probe_rows(spark, sf, variant: str = "default"):
    return L.build_probe_rows(X.pivot_rows(spark, sf), ratio=RATIO, seed=SEED, add_random_tokens=K_RANDOM,
                              vocab=VOCAB, variant=variant)


def _probe_out(df):
    return tidy(df.select("original_dataset_item_id", "text", F.size("tokens").alias("n_tokens"),
                          *[F.array_join(c, ",").alias(c) for c in ("token_ids", "pivots", "negatives", "random_ids", "labels")]))


def _lsql(body: str, focused: bool = False, extra=()):
    return with_ctes(body, "pivot_rows", local=_probe_local(focused) + list(extra))


@query("read_pivot_rows", with_ctes("""
SELECT r.dataset_item_id, query, pivot_context, pivot_token, timestamp, round(prob_delta, 6) AS prob_delta,
       CAST(row_ord AS BIGINT) AS row_ord
FROM pivot_rows r JOIN (
    SELECT dataset_item_id, row_number() OVER (ORDER BY md5('42|' || dataset_item_id), dataset_item_id)
                            <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test
    FROM (SELECT DISTINCT dataset_item_id FROM pivot_rows)) k ON k.dataset_item_id = r.dataset_item_id
WHERE NOT is_test""", "pivot_rows"))
def q_read_pivot_rows(spark, sf):
    """A1: rows stored by split, read with an explicit schema; the split asked
    for does not exist, so the train split is read."""
    path = new_path(spark, "pivot_rows")
    S.split_by_key(X.pivot_rows(spark, sf), "dataset_item_id", SEED, 0.2).write.partitionBy("split").parquet(path)
    return tidy(read_split(spark, path, "validation", X.PIVOT_SCHEMA))


@query("longest_context", _lsql("""
SELECT dataset_item_id, query, longest_text, CAST(longest_ord AS BIGINT) AS longest_ord FROM lg"""))
def q_longest_context(spark, sf):
    """Per id the longest context row (first in file order on ties)."""
    return tidy(L.longest_context(X.pivot_rows(spark, sf)))


@query("pivot_positions", _lsql("""
SELECT dataset_item_id, array_to_string(pivots, ',') AS pivots, CAST(len(tokens) AS BIGINT) AS n_tokens FROM cand"""))
def q_pivot_positions(spark, sf):
    """Pivot positions from the longest text and its prefix rows."""
    p = L.pivot_positions(X.pivot_rows(spark, sf))
    return tidy(p.select("dataset_item_id", F.array_join("pivots", ",").alias("pivots"),
                         F.size("tokens").alias("n_tokens")))


@query("negative_candidates", _lsql("""
SELECT dataset_item_id, array_to_string(candidates, ',') AS candidates FROM cand"""))
def q_negative_candidates(spark, sf):
    """[max(0, len(query) - 1), len) minus the pivots."""
    p = L.negative_candidates(L.pivot_positions(X.pivot_rows(spark, sf)))
    return tidy(p.select("dataset_item_id", F.array_join("candidates", ",").alias("candidates")))


@query("sample_negatives", _lsql("""
SELECT dataset_item_id, array_to_string(negatives, ',') AS negatives FROM neg"""))
def q_sample_negatives(spark, sf):
    """C4: max(1, round_half_even(2 n_pos)) negatives, capped by candidates."""
    p = L.sample_negatives(L.negative_candidates(L.pivot_positions(X.pivot_rows(spark, sf))), RATIO, SEED)
    return tidy(p.select("dataset_item_id", F.array_join("negatives", ",").alias("negatives")))


@query("append_random_tokens", _lsql("""
SELECT dataset_item_id, array_to_string(random_ids, ',') AS random_ids FROM neg"""))
def q_append_random_tokens(spark, sf):
    """5 uniform token ids per row (seeded md5)."""
    p = L.append_random_tokens(L.longest_context(X.pivot_rows(spark, sf)), K_RANDOM, SEED, VOCAB)
    return tidy(p.select("dataset_item_id", F.array_join("random_ids", ",").alias("random_ids")))


@query("assemble_labels", _lsql("""
SELECT original_dataset_item_id, array_to_string(labels, ',') AS labels FROM probe"""))
def q_assemble_labels(spark, sf):
    """Dense label arrays (1, -1, 0)."""
    return tidy(probe_rows(spark, sf).select("original_dataset_item_id",
                                             F.array_join("labels", ",").alias("labels")))


@query("build_probe_rows", _lsql(_PROBE_OUT))
def q_build_probe_rows(spark, sf):
    """Raw pivot rows -> probe rows (C1-C6 composed)."""
    return _probe_out(probe_rows(spark, sf))


@query("focused_labels_variant", _lsql(_PROBE_OUT, focused=True))
def q_focused_labels_variant(spark, sf):
    """The older labelling rule."""
    return _probe_out(probe_rows(spark, sf, "focused"))


def _dn_local(tail: bool):
    start = ("greatest(orig_len, 0)" if tail else
             "coalesce(list_min(list_filter(list_transform(lab, lambda x, i: CASE WHEN x <> 0 THEN i - 1 END), "
             "lambda y: y IS NOT NULL)), 0)")
    src = ("SELECT original_dataset_item_id, text, labels[1:greatest(len(labels) - 3, 0)] AS labels FROM probe"
           if tail else "SELECT original_dataset_item_id, text, labels FROM probe")
    return [
        ("src", src),
        ("fit", f"""SELECT original_dataset_item_id, text, labels, len(labels) AS orig_len, len({_tok('text')}) AS n,
                       CASE WHEN len(labels) >= len({_tok('text')}) THEN labels[1:len({_tok('text')})]
                            ELSE list_concat(labels, list_transform(range(len({_tok('text')}) - len(labels)),
                                                                    lambda x: 0)) END AS lab
                FROM src"""),
        ("dn0", f"""SELECT *, len(list_filter(labels, lambda x: x = -1)) AS k,
                       list_filter(range({start}, n), lambda i: lab[i + 1] = 0) AS cands FROM fit"""),
        ("dn", f"""SELECT original_dataset_item_id,
                      CASE WHEN k = 0 THEN labels ELSE list_transform(lab, lambda x, i: CASE WHEN list_contains(
                          {_pick('cands', 'least(k, len(cands))', 'original_dataset_item_id')}, i - 1)
                          THEN -1 ELSE x END) END AS labels
               FROM dn0"""),
    ]


def _doubled(spark, sf, tail: bool):
    p = probe_rows(spark, sf)
    if tail:
        p = p.withColumn("labels", F.slice("labels", 1, F.greatest(F.size("labels") - 3, F.lit(0))))
    return L.double_negatives(p.select("original_dataset_item_id", "text", "labels"), seed=SEED, tail_only=tail)


@query("double_negatives", _lsql("""
SELECT original_dataset_item_id, array_to_string(labels, ',') AS labels FROM dn""", extra=_dn_local(False)))
def q_double_negatives(spark, sf):
    """As many extra -1 as exist, from 0-labelled positions at/after the
    first labelled one."""
    d = _doubled(spark, sf, False)
    return tidy(d.select("original_dataset_item_id", F.array_join("labels", ",").alias("labels")))


@query("double_negatives_tail", _lsql("""
SELECT original_dataset_item_id, array_to_string(labels, ',') AS labels FROM dn""", extra=_dn_local(True)))
def q_double_negatives_tail(spark, sf):
    """The notebook rule -- only positions beyond the original label
    array (here: labels cut by 3 before doubling)."""
    d = _doubled(spark, sf, True)
    return tidy(d.select("original_dataset_item_id", F.array_join("labels", ",").alias("labels")))


@query("fit_labels_length", _lsql(f"""
SELECT original_dataset_item_id, CAST(len({_tok('text')}) AS BIGINT) AS n,
       array_to_string(CASE WHEN len(labels) >= len({_tok('text')}) THEN labels[1:len({_tok('text')})]
            ELSE list_concat(labels, list_transform(range(len({_tok('text')}) - len(labels)), lambda x: 0)) END, ',')
           AS labels
FROM probe"""))
def q_fit_labels_length(spark, sf):
    """C11: labels padded with 0 or truncated to the token count."""
    p = probe_rows(spark, sf)
    n = F.size(T.whitespace_tokens(F.col("text")))
    return tidy(p.select("original_dataset_item_id", n.alias("n"),
                         F.array_join(L.fit_labels_length(F.col("labels"), n), ",").alias("labels")))


_HS_LOCAL = [
    ("nemb", "SELECT count(*) AS n FROM embeddings"),
    ("hpos", """SELECT id, position, token FROM (
                  SELECT original_dataset_item_id AS id, generate_subscripts(token_ids, 1) - 1 AS position,
                         unnest(token_ids) AS token, len(token_ids) AS n_tok FROM probe)
                WHERE position < n_tok - CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END"""),
    ("hs", """SELECT h.id, CAST(l.layer AS INTEGER) AS layer, h.position,
                     e.embedding[16 * l.layer + 1 : 16 * l.layer + 16] AS activation
              FROM hpos h CROSS JOIN nemb
              JOIN embeddings e ON e.vec_id = (h.token + h.position) % nemb.n
              CROSS JOIN range(4) l(layer)"""),
    ("lab", """SELECT original_dataset_item_id AS id, generate_subscripts(labels, 1) - 1 AS position,
                      unnest(labels) AS label FROM probe"""),
]


def _stored_probe(spark, sf):
    """The probe rows, written once for queries that read them more than once."""
    p, path = probe_rows(spark, sf), new_path(spark, "probe_rows")
    p.write.parquet(path)
    return spark.read.schema(p.schema).parquet(path)


def _states(spark, sf, probe):
    return X.hidden_states(spark, sf, probe)


@query("explode_labeled_tokens", with_ctes("""
SELECT h.id, CAST(h.layer AS BIGINT) AS layer, CAST(h.position AS BIGINT) AS position, CAST(b.label AS BIGINT) AS label,
       CASE WHEN b.label = 1 THEN 'pivotal' ELSE 'non_pivotal' END AS bucket,
       round(list_sum(list_transform(h.activation, lambda x: CAST(x AS DOUBLE))), 6) AS act_sum
FROM hs h JOIN lab b ON h.id = b.id AND h.position = b.position WHERE b.label <> 0""", "pivot_rows",
                                           local=_probe_local() + _HS_LOCAL))
def q_explode_labeled_tokens(spark, sf):
    """Hidden states aligned with labels; 1 -> pivotal, -1 -> non_pivotal."""
    p = _stored_probe(spark, sf)
    e = L.explode_labeled_tokens(p, _states(spark, sf, p))
    return tidy(e.select("id", "layer", "position", "label", "bucket", vec.vsum("activation").alias("act_sum")))


@query("truncation_audit", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n_states <> n_labels THEN 1 ELSE 0 END) AS BIGINT)
           AS n_mismatched,
       round(sum(CASE WHEN n_states <> n_labels THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS rate,
       sum(CASE WHEN n_states <> n_labels THEN 1 ELSE 0 END) / greatest(count(*), 1) > 0.01 AS exclude_mismatched
FROM (SELECT p.original_dataset_item_id, len(p.labels) AS n_labels, coalesce(s.n_states, 0) AS n_states
      FROM probe p LEFT JOIN (SELECT id, max(c) AS n_states FROM (SELECT id, layer, count(*) AS c FROM hs
                                                                 GROUP BY id, layer) GROUP BY id) s
      ON p.original_dataset_item_id = s.id)""", "pivot_rows", local=_probe_local() + _HS_LOCAL))
def q_truncation_audit(spark, sf):
    """Rows whose state count differs from their label count, and rate."""
    p = _stored_probe(spark, sf)
    return tidy(L.truncation_audit(p, _states(spark, sf, p)))


@query("label_context_view", _lsql("""
SELECT original_dataset_item_id, CAST(position AS BIGINT) AS position, CAST(label AS BIGINT) AS label,
       tokens[position + 1] AS token, coalesce(tokens[position + 2], '<END>') AS next_token
FROM (SELECT original_dataset_item_id, tokens, generate_subscripts(labels, 1) - 1 AS position,
             unnest(labels) AS label FROM probe)
WHERE label <> 0"""))
def q_label_context_view(spark, sf):
    """C14: each labelled position with its token and the next one."""
    return tidy(L.label_context_view(probe_rows(spark, sf)))


@query("dataset_summary", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT dataset_item_id) AS BIGINT) AS unique_queries,
       CAST(sum(CASE WHEN query = pivot_context THEN 1 ELSE 0 END) AS BIGINT) AS first_token_pivotal,
       round(avg(CASE WHEN query = pivot_context THEN 1.0 ELSE 0.0 END) * 100, 6) AS first_token_pivotal_pct
FROM pivot_rows""", "pivot_rows"))
def q_dataset_summary(spark, sf):
    """Rows, distinct ids, rows whose query equals the context."""
    return tidy(L.dataset_summary(X.pivot_rows(spark, sf)))


@query("first_token_pivotal_pct", with_ctes("""
SELECT round(100 * avg(CASE WHEN query = pivot_context THEN 1.0 ELSE 0.0 END), 6) AS pct FROM pivot_rows""",
                                            "pivot_rows"))
def q_first_token_pivotal_pct(spark, sf):
    """The same count as a percentage."""
    r = X.pivot_rows(spark, sf)
    return tidy(r.agg((100 * F.avg((F.col("query") == F.col("pivot_context")).cast("double"))).alias("pct")))


@query("label_counts", with_ctes("""
SELECT split, CAST(layer AS BIGINT) AS layer, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS negatives,
       CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS positives
FROM activations GROUP BY split, layer""", "activations"))
def q_label_counts(spark, sf):
    """C17: positives / negatives per split and layer."""
    return tidy(L.label_counts(X.activations(spark, sf)))


@query("dataset_diff", _lsql("""
SELECT equal, CAST(count(*) AS BIGINT) AS n
FROM (SELECT a.labels IS NOT DISTINCT FROM b.labels AS equal
      FROM (SELECT original_dataset_item_id, labels FROM probe) a
      FULL OUTER JOIN dn b ON a.original_dataset_item_id = b.original_dataset_item_id)
GROUP BY equal""", extra=_dn_local(False)))
def q_dataset_diff(spark, sf):
    """Original vs doubled-negative labels: how many rows changed."""
    a = probe_rows(spark, sf)
    d = L.dataset_diff(a, _doubled(spark, sf, False))
    return tidy(d.groupBy("equal").agg(F.count(F.lit(1)).alias("n")))
