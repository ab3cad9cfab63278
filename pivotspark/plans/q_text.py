"""Registered queries for word statistics and corpus summaries (§2.F23-F30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators import textstats as TS
from ..operators import vectors as V
from ..sources import fixtures as X
from .registry import query, tidy, with_ctes

_SQL_PUNCT = TS.PUNCT_CLASS.replace("'", "''")
_SQL_STOP = "[" + ", ".join(f"'{w}'" for w in TS.STOPWORDS) + "]"
_WORDS = f"""SELECT run, task, unnest(list_filter(
                 regexp_split_to_array(regexp_replace(lower(text), '{_SQL_PUNCT}', ' ', 'g'), '[\\s\\x{{85}}\\p{{Z}}\\x{{b}}\\x{{1c}}-\\x{{1f}}]+'),
                 lambda t: t <> '' AND NOT regexp_full_match(t, '\\p{{Nd}}+') AND NOT list_contains({_SQL_STOP}, t)))
                 AS word
             FROM token_texts"""


def _ratio_local(task_expr: str):
    return [
        ("words", _WORDS),
        ("counts", f"SELECT {task_expr} AS task, run, word, count(*) AS n FROM words GROUP BY ALL"),
        ("tot", "SELECT task, run, sum(n) AS tot FROM counts GROUP BY ALL"),
        ("rates", """SELECT c.task, c.word,
                            coalesce(sum(CASE WHEN c.run = 'base' THEN c.n / greatest(t.tot, 1) * 1e6 END), 0.0)
                                AS freq_base,
                            coalesce(sum(CASE WHEN c.run = 'steered' THEN c.n / greatest(t.tot, 1) * 1e6 END), 0.0)
                                AS freq_steered
                     FROM counts c JOIN tot t ON c.task = t.task AND c.run = t.run GROUP BY c.task, c.word"""),
        ("ratios", """SELECT *, ln((freq_steered + 1) / (freq_base + 1)) AS log_ratio FROM rates
                      WHERE freq_base + freq_steered >= 5"""),
    ]


def _texts(spark, sf):
    return X.token_texts(spark, sf)


@query("token_counts", with_ctes("""
SELECT run, word, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY run, word""", "token_texts",
                                 local=[("words", _WORDS)]))
def q_token_counts(spark, sf):
    """word counts per run (lower, punctuation -> space, no digits-only
    tokens, no stopwords)."""
    return tidy(TS.token_counts(_texts(spark, sf)))


@query("promoted_suppressed", with_ctes("""
SELECT direction, CAST(rank AS BIGINT) AS rank, word, round(log_ratio, 6) AS log_ratio,
       round(freq_base, 6) AS freq_base, round(freq_steered, 6) AS freq_steered
FROM (SELECT 'promoted' AS direction, row_number() OVER (ORDER BY log_ratio DESC, word) AS rank, * FROM ratios
      UNION ALL
      SELECT 'suppressed', row_number() OVER (ORDER BY log_ratio ASC, word), * FROM ratios)
WHERE rank <= 20""", "token_texts", local=_ratio_local("'all'")))
def q_promoted_suppressed(spark, sf):
    """per-million rates, ln((fs+1)/(fb+1)), top 20 each way."""
    r = TS.word_log_ratios(TS.token_counts(_texts(spark, sf)))
    out = TS.promoted_suppressed(r, top_n=20)
    return tidy(out.select("direction", "rank", "word", "log_ratio", "freq_base", "freq_steered"))


@query("promoted_by_task", with_ctes("""
SELECT task, CAST(rank AS BIGINT) AS rank, word, round(log_ratio, 6) AS log_ratio
FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY log_ratio DESC, word) AS rank FROM ratios)
WHERE rank <= 3""", "token_texts", local=_ratio_local("task")))
def q_promoted_by_task(spark, sf):
    """the first 3 promoted words per task (document source)."""
    c = TS.token_counts(_texts(spark, sf), ["task", "run"])
    r = TS.word_log_ratios(c, ["task"])
    top = S.topk_per_group(r, ["task"], [F.col("log_ratio").desc(), F.col("word")], 3)
    return tidy(top.select("task", "rank", "word", "log_ratio"))


@query("pattern_counts", with_ctes("""
SELECT 'pattern' AS kind, reasoning_pattern AS key, CAST(count(*) AS BIGINT) AS n FROM vector_corpus GROUP BY 2
UNION ALL
SELECT 'cluster', CAST(cluster_id AS VARCHAR), n FROM (
    SELECT cluster_id, CAST(count(*) AS BIGINT) AS n FROM vector_corpus GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 5)
""", "vector_corpus"))
def q_pattern_counts(spark, sf):
    """rows per pattern; the top-5 clusters by rows."""
    c = X.vector_corpus(spark, sf)
    pat = c.groupBy(F.col("reasoning_pattern").alias("key")).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("pattern").alias("kind"), "key", "n")
    clu = (c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "cluster_id").limit(5)
           .select(F.lit("cluster").alias("kind"), F.col("cluster_id").cast("string").alias("key"), "n"))
    return tidy(pat.unionByName(clu))


_HIST_SQL = """SELECT '{w}' AS which, CAST(b AS BIGINT) AS bin, round(lo + b * (hi - lo) / 40, 8) AS "left",
       round(lo + (b + 1) * (hi - lo) / 40, 8) AS "right", CAST(count(*) AS BIGINT) AS count
FROM (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 40)), 39) END AS b, lo, hi
      FROM (SELECT {e} AS v, min({e}) OVER () AS lo, max({e}) OVER () AS hi FROM vector_corpus))
GROUP BY b, lo, hi"""


@query("delta_histogram", with_ctes(
    _HIST_SQL.format(w="signed", e="prob_delta") + "\nUNION ALL\n" + _HIST_SQL.format(w="abs", e="abs(prob_delta)"),
    "vector_corpus"))
def q_delta_histogram(spark, sf):
    """40 equal-width bins of prob_delta and |prob_delta|."""
    c = X.vector_corpus(spark, sf).withColumn("abs_delta", F.abs("prob_delta"))
    a = TS.delta_histogram(c, "prob_delta").withColumn("which", F.lit("signed"))
    b = TS.delta_histogram(c, "abs_delta").withColumn("which", F.lit("abs"))
    # edges are multiples of a 400,000th: 6 digits would cut many in the middle
    return tidy(a.unionByName(b).select("which", "bin", "left", "right", "count"), 8)


@query("top_tokens_median", with_ctes("""
SELECT 'abs' AS kind, CAST(rank AS BIGINT) AS rank, pivot_token, round(med, 6) AS median
FROM (SELECT pivot_token, med, row_number() OVER (ORDER BY med DESC, pivot_token) AS rank
      FROM (SELECT pivot_token, median(abs(prob_delta)) AS med FROM vector_corpus GROUP BY 1))
WHERE rank <= 20
UNION ALL
SELECT 'positive', CAST(rank AS BIGINT), pivot_token, round(med, 6)
FROM (SELECT pivot_token, med, row_number() OVER (ORDER BY med DESC, pivot_token) AS rank
      FROM (SELECT pivot_token, median(prob_delta) AS med FROM vector_corpus WHERE prob_delta > 0 GROUP BY 1)) t
WHERE rank <= 3 AND (SELECT count(*) FROM vector_corpus v WHERE v.pivot_token = t.pivot_token) >= 2""", "vector_corpus"))
def q_top_tokens_median(spark, sf):
    """top-20 tokens by median |delta|; the top-3 by median positive
    delta, of which those with fewer than two rows in all are skipped."""
    from ..operators.textstats import top_tokens_by_median
    c = X.vector_corpus(spark, sf)
    a = top_tokens_by_median(c.withColumn("abs_delta", F.abs("prob_delta")), "pivot_token", "abs_delta", 20)
    p = top_tokens_by_median(c.where(F.col("prob_delta") > 0), "pivot_token", "prob_delta", 3)
    n = c.groupBy("pivot_token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    a, p = a.withColumn("kind", F.lit("abs")), p.join(n, "pivot_token").withColumn("kind", F.lit("positive"))
    cols = ["kind", "rank", "pivot_token", "median"]
    return tidy(a.select(*cols).unionByName(p.select(*cols)))


_PATTERNS = ("click", "error", "purchase", "signup", "view")


@query("crosstab", with_ctes("""
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, {cols}
FROM vector_corpus GROUP BY cluster_id""".format(cols=", ".join(
    f"CAST(count(*) FILTER (WHERE reasoning_pattern = '{p}') AS BIGINT) AS {p}" for p in _PATTERNS)),
    "vector_corpus"))
def q_crosstab(spark, sf):
    """cluster x pattern counts (zeros filled)."""
    c = X.vector_corpus(spark, sf)
    t = c.groupBy("cluster_id").pivot("reasoning_pattern", list(_PATTERNS)).count().fillna(0)
    return tidy(t)


_TASK_LOCAL = [
    ("big", """SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS rk FROM vector_corpus GROUP BY 1"""),
    ("toks", """SELECT pivot_token FROM (
                  SELECT pivot_token, row_number() OVER (ORDER BY median(prob_delta) DESC, pivot_token) AS rk
                  FROM vector_corpus WHERE prob_delta > 0 GROUP BY 1) t
                WHERE rk <= 3 AND (SELECT count(*) FROM vector_corpus v WHERE v.pivot_token = t.pivot_token) >= 2"""),
    ("groups", """
SELECT 'all' AS task, 'all' AS grp, row_id, abs(prob_delta) AS key FROM vector_corpus
UNION ALL SELECT 'sign', CASE WHEN prob_delta > 0 THEN 'pos' ELSE 'neg' END, row_id, abs(prob_delta)
          FROM vector_corpus WHERE prob_delta <> 0
UNION ALL SELECT 'magnitude', 'high', row_id, abs(prob_delta) FROM vector_corpus
          WHERE abs(prob_delta) >= (SELECT quantile_cont(abs(prob_delta), 0.75) FROM vector_corpus)
UNION ALL SELECT 'magnitude', 'low', row_id, abs(prob_delta) FROM vector_corpus
          WHERE abs(prob_delta) <= (SELECT quantile_cont(abs(prob_delta), 0.25) FROM vector_corpus)
UNION ALL SELECT 'pattern', reasoning_pattern, row_id, abs(prob_delta) FROM vector_corpus
UNION ALL SELECT 'cluster_vs_raw', 'c' || CAST(cluster_id AS VARCHAR), row_id, abs(prob_delta)
          FROM vector_corpus WHERE cluster_id IN (SELECT cluster_id FROM big WHERE rk = 1)
UNION ALL SELECT 'token_targeted', pivot_token, row_id, abs(prob_delta)
          FROM vector_corpus WHERE pivot_token IN (SELECT pivot_token FROM toks)"""),
    ("means", """SELECT g.task, g.grp, l.dim, avg(l.x) AS v FROM groups g JOIN corpus_long l USING (row_id) GROUP BY 1, 2, 3"""),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY task, grp ORDER BY key DESC, row_id) AS rk FROM groups"),
    ("tops", """SELECT r.task, r.grp, 'top' || k AS arm, l.dim, sum(l.x) AS v
                FROM ranked r JOIN (VALUES (1), (2)) ks(k) ON r.rk <= k JOIN corpus_long l USING (row_id)
                WHERE r.task <> 'all' AND (r.task <> 'cluster_vs_raw' OR k = 2) GROUP BY 1, 2, 3, 4"""),
    ("cvec", "SELECT cluster_id, dim, avg(x) AS v FROM corpus_long GROUP BY 1, 2"),
    ("arms", """
SELECT task, grp, 'mean' AS arm, dim, v FROM means
UNION ALL SELECT t.task, t.grp, t.arm, t.dim, t.v * m.ref / sqrt(sum(t.v * t.v) OVER (PARTITION BY t.task, t.grp, t.arm))
          FROM tops t JOIN (SELECT task, grp, sqrt(sum(v * v)) AS ref FROM means GROUP BY 1, 2) m USING (task, grp)
UNION ALL SELECT k.task, 'c' || CAST(cluster_id AS VARCHAR), 'cluster_vector', dim, v FROM cvec JOIN big USING (cluster_id)
          JOIN (VALUES ('cluster', 5), ('cluster_vs_raw', 1)) k(task, most) ON rk <= most
UNION ALL SELECT 'weighted', 'all', 'weighted_mean_signed', dim, sum(prob_delta * x) / greatest(1e-8, sum(abs(prob_delta)))
          FROM corpus_long GROUP BY dim
UNION ALL SELECT 'weighted', 'all', 'weighted_mean_abs', dim, sum(abs(prob_delta) * x) / greatest(1e-8, sum(abs(prob_delta)))
          FROM corpus_long GROUP BY dim"""),
]


@query("task_vectors", with_ctes("""
SELECT task, grp AS "group", arm, CAST(dim AS BIGINT) AS dim, round(v, 6) AS value,
       round(sqrt(sum(v * v) OVER (PARTITION BY task, grp, arm)), 6) AS norm FROM arms""",
                                 "vector_corpus", "corpus_long", local=_TASK_LOCAL))
def q_task_vectors(spark, sf):
    """the vectors of the eight grouping tasks as one long table (task,
    group, arm, dim, value, norm).  Arms: the group's mean; the sums of its
    top 1 and 2 rows, norm-matched to the mean; the cluster vector (of the
    five largest clusters, and beside mean and top 2 of the largest); the
    signed and absolute weighted means; the top tokens by median delta."""
    c = X.vector_corpus(spark, sf).withColumn("abs_delta", F.abs("prob_delta"))
    return tidy(TS.task_vectors(c))
