"""Registry of named queries and their DuckDB oracle SQL.

Each query is a function (spark, sf_dir) -> DataFrame that reads the given
tables.  Its oracle is the same computation in DuckDB SQL over the same
Parquet tables (pre-registered as views), built from the shared fixture
CTEs below.  Both sides alias every column, cast integers to BIGINT and
round doubles to 6 digits so that results compare value for value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name`` with optional oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Integers -> bigint, floating -> double rounded to ``digits``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


# The oracle's logistic fits: steps of accelerated gradient descent.
LR_STEPS, LR_MOMENTUM = 400, 0.7
# CTEs that are read in every step of a recursion
KEPT = {"lr_rows", "lr_fit", "lr_scores"}
RECURSIVE = {"lr_fit"}

# -- fixture CTEs (DuckDB) ----------------------------------------------------
# name -> (dependencies, body).  The bodies mirror sources/fixtures.py.

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "key_split": ((), """
        SELECT query_id,
               CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT vec_id AS query_id,
                     row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR))), vec_id) AS rn,
                     count(*) OVER () AS cnt
              FROM (SELECT DISTINCT vec_id FROM embeddings))"""),
    "activations": (("key_split",), """
        SELECT s.split, CAST(l.layer AS INTEGER) AS layer, e.vec_id AS query_id, 0 AS position,
               CASE WHEN e.label < 5 THEN 1 ELSE 0 END AS label,
               CASE WHEN e.label < 5 THEN 'pivotal' ELSE 'non_pivotal' END AS bucket,
               e.embedding[16 * l.layer + 1 : 16 * l.layer + 16] AS activation
        FROM embeddings e CROSS JOIN range(4) l(layer) JOIN key_split s ON s.query_id = e.vec_id"""),
    "acts_long": (("activations",), """
        SELECT split, layer, query_id, label, bucket,
               generate_subscripts(activation, 1) - 1 AS dim,
               CAST(unnest(activation) AS DOUBLE) AS x
        FROM activations"""),
    "acts_shifted": (("activations",), """
        SELECT split, layer, query_id, position, label, bucket,
               list_transform(activation, lambda x, i:
                   CASE WHEN i = 1 AND label = 1
                        THEN CAST(x + CAST(CAST(0.3 AS DOUBLE) - CAST(0.05 AS DOUBLE) * layer AS FLOAT) AS FLOAT)
                        ELSE x END) AS activation
        FROM activations"""),
    "train_dir_long": (("acts_long",), """
        SELECT layer, dim,
               avg(x) FILTER (WHERE label >= 0.5) - avg(x) FILTER (WHERE label < 0.5) AS value
        FROM acts_long WHERE split = 'train' GROUP BY layer, dim"""),
    "train_dir": (("train_dir_long",), """
        SELECT layer, list(value ORDER BY dim) AS direction FROM train_dir_long GROUP BY layer"""),
    "pivot_rows": ((), """
        WITH r AS (
          SELECT CAST(conv_id AS VARCHAR) AS dataset_item_id,
                 first(CASE WHEN turn = 0 THEN text END IGNORE NULLS)
                     OVER (PARTITION BY conv_id ORDER BY turn
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS query,
                 coalesce(string_agg(text, ' ' ORDER BY turn)
                     OVER (PARTITION BY conv_id ORDER BY turn
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pivot_context,
                 ' ' || text AS pivot_token,
                 CAST(turn AS VARCHAR) AS timestamp,
                 ((conv_id * 7 + turn * 13) % 21 - 10) / 20.0 AS prob_delta,
                 conv_id, turn
          FROM conversations)
        SELECT dataset_item_id, query, pivot_context, pivot_token, timestamp,
               CAST(prob_delta AS DOUBLE) AS prob_delta, conv_id * 1048576 + turn * 2 AS row_ord
        FROM r WHERE turn >= 1
        UNION ALL
        SELECT dataset_item_id, query, pivot_context, pivot_token, timestamp,
               CAST(prob_delta AS DOUBLE) AS prob_delta, conv_id * 1048576 + turn * 2 + 1 AS row_ord
        FROM r WHERE turn >= 1 AND turn % 3 = 1"""),
    # standardised train rows, a last entry of ones for the intercept
    "lr_scale": (("acts_shifted",), """
        SELECT layer, list(m ORDER BY dim) AS mean, list(CASE WHEN s = 0 THEN 1.0 ELSE s END ORDER BY dim) AS std
        FROM (SELECT layer, dim, avg(x) AS m, stddev_pop(x) AS s
              FROM (SELECT layer, generate_subscripts(activation, 1) AS dim, CAST(unnest(activation) AS DOUBLE) AS x
                    FROM acts_shifted WHERE split = 'train') GROUP BY layer, dim) GROUP BY layer"""),
    "lr_rows": (("lr_scale",), """
        SELECT a.layer, CAST(label AS DOUBLE) AS y,
               list_append(list_transform(activation, lambda x, i: (CAST(x AS DOUBLE) - s.mean[i]) / s.std[i]), 1.0) AS x
        FROM acts_shifted a JOIN lr_scale s ON a.layer = s.layer WHERE split = 'train'"""),
    # the steepest slope of the gradient: a quarter of the Gram matrix's largest row sum
    "lr_bound": (("lr_rows",), """
        SELECT layer, max(b) / 4 AS bound, min(n) AS n
        FROM (SELECT layer, i, sum(abs(g)) AS b, min(n) AS n
              FROM (SELECT layer, i, j, sum(x[i] * x[j]) AS g, count(*) AS n
                    FROM lr_rows CROSS JOIN range(1, 18) a(i) CROSS JOIN range(1, 18) b(j) GROUP BY layer, i, j)
              GROUP BY layer, i) GROUP BY layer"""),
    # accelerated gradient descent for every layer and C
    "lr_fit": (("lr_rows", "lr_bound"), f"""
        SELECT 0 AS it, layer, c, n, bound + 1 / c AS lip, list_transform(range(17), lambda i: CAST(0 AS DOUBLE)) AS w,
               list_transform(range(17), lambda i: CAST(0 AS DOUBLE)) AS v
        FROM lr_bound CROSS JOIN (VALUES (CAST(0.001 AS DOUBLE)), (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) k(c)
        UNION ALL
        SELECT it + 1, layer, c, n, lip, nw, list_transform(nw, lambda e, i: e + {LR_MOMENTUM} * (e - w[i]))
        FROM (SELECT it, layer, c, n, lip, w, list_transform(g, lambda e, i:
                         v[i] - (e + CASE WHEN i < 17 THEN v[i] / c ELSE 0 END) / lip) AS nw
              FROM (SELECT it, layer, c, any_value(n) AS n, any_value(lip) AS lip, any_value(w) AS w, any_value(v) AS v,
                           [{", ".join(f"sum(r * x[{i}])" for i in range(1, 18))}] AS g
                    FROM (SELECT f.*, r.x, 1.0 / (1.0 + exp(-list_dot_product(f.v, r.x))) - r.y AS r
                          FROM lr_fit f JOIN lr_rows r ON f.layer = r.layer WHERE f.it < {LR_STEPS})
                    GROUP BY it, layer, c))"""),
    "lr_probes": (("lr_fit", "lr_scale"), f"""
        SELECT layer, c, n AS n_train, w[1:16] AS coef_scaled, w[17] AS intercept_scaled, raw,
               w[17] - list_dot_product(raw, mean) AS bias
        FROM (SELECT f.*, s.mean, list_transform(w[1:16], lambda e, i: e / s.std[i]) AS raw
              FROM lr_fit f JOIN lr_scale s ON f.layer = s.layer WHERE it = {LR_STEPS})"""),
    # test rows scored, counts at 0.5 and the AUROC over all pairs
    "lr_scores": (("lr_probes",), """
        SELECT a.layer, c, label, 1.0 / (1.0 + exp(-(list_dot_product(list_transform(activation, lambda x: CAST(x AS DOUBLE)), p.raw) + p.bias))) AS prob
        FROM acts_shifted a JOIN lr_probes p ON a.layer = p.layer WHERE a.split = 'test'"""),
    "lr_eval": (("lr_scores",), """
        SELECT q.*, (TP + TN) / (TN + FP + FN + TP) AS accuracy,
               CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS precision,
               CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS recall,
               CASE WHEN 2 * TP + FP + FN > 0 THEN 2 * TP / (2 * TP + FP + FN) ELSE 0.0 END AS f1_score, u.auroc_score,
               p.n_train, sqrt(list_dot_product(p.coef_scaled, p.coef_scaled)) AS coef_norm
        FROM (SELECT layer, c, count(*) FILTER (WHERE label = 0 AND prob < 0.5) AS TN, count(*) FILTER (WHERE label = 0 AND prob >= 0.5) AS FP,
                     count(*) FILTER (WHERE label = 1 AND prob < 0.5) AS FN, count(*) FILTER (WHERE label = 1 AND prob >= 0.5) AS TP
              FROM lr_scores GROUP BY layer, c) q
        JOIN (SELECT a.layer, a.c, avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END) AS auroc_score
              FROM lr_scores a JOIN lr_scores b ON a.layer = b.layer AND a.c = b.c AND a.label = 1 AND b.label = 0
              GROUP BY a.layer, a.c) u ON q.layer = u.layer AND q.c = u.c
        JOIN lr_probes p ON q.layer = p.layer AND q.c = p.c"""),
    "vector_corpus": ((), """
        WITH base AS (
          SELECT v.event_id AS row_id, v.event_type AS reasoning_pattern,
                 (v.value - 30) / 100 AS prob_delta,
                 'tok' || CAST(v.user_id % 17 AS VARCHAR) AS pivot_token,
                 e.embedding AS steering_vector, e.label AS cluster_id
          FROM events v JOIN embeddings e ON e.vec_id = v.event_id % (SELECT count(*) FROM embeddings))
        SELECT * FROM base"""),
    "corpus_long": (("vector_corpus",), """
        SELECT row_id, reasoning_pattern, prob_delta, pivot_token, cluster_id,
               generate_subscripts(steering_vector, 1) - 1 AS dim,
               CAST(unnest(steering_vector) AS DOUBLE) AS x
        FROM vector_corpus"""),
    "generations": ((), """
        WITH g AS (
          SELECT l_linenumber AS run, l_orderkey AS idx, max(l_quantity) AS q,
                 min(l_returnflag) AS flag, max(l_tax) AS tax
          FROM lineitem GROUP BY l_linenumber, l_orderkey)
        SELECT CAST(run AS INTEGER) AS run, CAST(idx AS BIGINT) AS idx,
               'How many units are in order ' || CAST(idx AS VARCHAR) || '?' AS question,
               '#### ' || CAST(idx % 4 AS VARCHAR) AS answer,
               CASE WHEN tax = 0 THEN ''
                    WHEN flag = 'R' THEN 'total is ' || CAST(CAST(q AS BIGINT) % 4 AS VARCHAR) || ' units'
                    ELSE 'so #### ' || CAST(CAST(q AS BIGINT) % 4 AS VARCHAR) END AS full_output
        FROM g"""),
    "run_config": ((), """
        SELECT run,
               CASE WHEN run = 1 THEN 'base' WHEN run IN (5, 6, 7) THEN 'random' ELSE 'pivotal' END AS arm,
               CAST(CASE run WHEN 2 THEN 1.2 WHEN 3 THEN 1.4 WHEN 4 THEN 1.6 WHEN 5 THEN 2.0
                             WHEN 6 THEN 0.0 WHEN 7 THEN -1.0 END AS DOUBLE) AS factor
        FROM (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS run FROM lineitem)"""),
    "random_control_config": ((), """
        SELECT run, CASE WHEN run = 1 THEN 'base' WHEN run IN (2, 3) THEN 'pivotal'
                         WHEN run IN (4, 5, 6, 7) THEN 'random' END AS arm,
               CAST(CASE WHEN run IN (2, 4, 5) THEN 1.2 WHEN run IN (3, 6, 7) THEN 1.4 END AS DOUBLE) AS factor
        FROM (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS run FROM lineitem)"""),
    "token_texts": ((), """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'steered' END AS run, doc_id, text, source AS task
        FROM documents"""),
    "gate_probe": ((), """
        SELECT list(w ORDER BY dim) AS w, list(v ORDER BY dim) AS v, -sum(w * (p + q) / 2) - 0.5 AS b
        FROM (SELECT dim, p, q, v, 100.0 * (p - q) AS w
              FROM (SELECT dim, avg(x) FILTER (WHERE label < 5) AS p, avg(x) FILTER (WHERE label >= 5) AS q,
                           avg(x) FILTER (WHERE label = 0) AS v
                    FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim,
                                 CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim))"""),
    "gate_steps": (("gate_probe",), """
        SELECT run, step, event_id, CASE WHEN step = 1 OR step % 13 = 0 THEN 'prefill' ELSE 'decode' END AS phase,
               1.0 / (1.0 + exp(-(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * p.w[i])) + p.b)))
                   AS prob,
               0.5 * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
                   * sqrt(list_sum(list_transform(p.v, lambda x: x * x)))
                   / (sqrt(list_sum(list_transform(p.v, lambda x: x * x))) + 1e-8) AS delta_norm
        FROM (SELECT user_id AS run, event_id,
                     CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step FROM events) s
        CROSS JOIN gate_probe p JOIN embeddings e ON e.vec_id = s.event_id % (SELECT count(*) FROM embeddings)"""),
}


def with_ctes(body: str, *names: str, local: list[tuple[str, str]] | tuple = (), recursive: bool = False) -> str:
    """Prefix ``body`` with the named fixture CTEs (and their dependencies),
    then the query's own ``local`` (name, sql) CTEs in the given order."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        deps, _ = CTES[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    recursive = recursive or bool(RECURSIVE & set(order))
    parts = [f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({CTES[n][1]}\n)" for n in order] + [f"{n} AS ({q}\n)" for n, q in local]
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
