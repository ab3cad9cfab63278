"""Registered queries for the vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import vectors as V
from ..sources import fixtures as X
from .registry import query, tidy, with_ctes


def _train(spark, sf):
    return X.activations(spark, sf).where(F.col("split") == "train")


@query("centroid_diff", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(dim AS BIGINT) AS dim,
       round(avg(x) FILTER (WHERE label >= 0.5), 6) AS mean_pos,
       round(avg(x) FILTER (WHERE label < 0.5), 6) AS mean_neg,
       round(avg(x) FILTER (WHERE label >= 0.5) - avg(x) FILTER (WHERE label < 0.5), 6) AS value
FROM acts_long WHERE split = 'train' GROUP BY layer, dim""", "acts_long"))
def q_centroid_diff(spark, sf):
    """D3: train-split centroid difference per layer, long form."""
    return tidy(V.centroid_diff_long(_train(spark, sf), ["layer"], "label", "activation"))


@query("centroid", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, bucket, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS value
FROM acts_long GROUP BY layer, bucket, dim""", "acts_long"))
def q_centroid(spark, sf):
    """Element-wise mean per (layer, bucket)."""
    return tidy(V.centroid_long(X.activations(spark, sf), ["layer", "bucket"], "activation"))


@query("topk_dims", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(rank AS BIGINT) AS rank, CAST(dim AS BIGINT) AS dim,
       round(value, 6) AS value, CAST(sign(value) AS BIGINT) AS sign
FROM (SELECT layer, dim, value,
             row_number() OVER (PARTITION BY layer ORDER BY abs(value) DESC, dim) AS rank
      FROM train_dir_long)
WHERE rank <= 5""", "train_dir_long"))
def q_topk_dims(spark, sf):
    """Top-5 dims of the train direction by |value|, with sign."""
    d = V.centroid_diff_long(_train(spark, sf), ["layer"], "label", "activation")
    return tidy(V.topk_dims(d.select("layer", "dim", "value"), ["layer"], 5)
                .select("layer", "rank", "dim", "value", "sign"))


def _test(spark, sf):
    return X.activations(spark, sf).where(F.col("split") == "test")


def _train_dirs(spark, sf):
    """(layer, direction array<double>) from the train split."""
    return V.assemble(V.centroid_diff_long(_train(spark, sf), ["layer"], "label", "activation"),
                      ["layer"], out_col="direction")


def _long(df, keys, vec_col, value="value"):
    """Array column -> long form (keys..., dim, value) for comparison."""
    return df.select(*keys, F.posexplode(vec_col).alias("dim", value))


# SQL helpers: a vector as long form, norms and dots on DOUBLE[] lists
_SQL_NORM = "sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_SQL_DOT = "list_sum(list_transform({a}, lambda x, i: CAST(x AS DOUBLE) * CAST(({b})[i] AS DOUBLE)))"


def _n(v):
    return _SQL_NORM.format(v=v)


def _d(a, b):
    return _SQL_DOT.format(a=a, b=b)


@query("layer_matrix", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, query_id, split,
       CASE WHEN bucket = 'pivotal' THEN 1.0 ELSE 0.0 END AS y,
       round(list_sum(list_transform(activation, lambda x: CAST(x AS DOUBLE))), 6) AS act_sum
FROM activations
WHERE layer IN (SELECT layer FROM activations GROUP BY layer HAVING count(DISTINCT bucket) = 2)""",
                                 "activations"))
def q_layer_matrix(spark, sf):
    """(X, y) rows per layer; layers with an empty bucket drop out."""
    m = V.layer_matrix(X.activations(spark, sf))
    return tidy(m.select("layer", "query_id", "split", "y", vec.vsum("activation").alias("act_sum")))


@query("weighted_mean_signed", with_ctes("""
SELECT reasoning_pattern, CAST(dim AS BIGINT) AS dim,
       round(sum(prob_delta * x) / greatest(1e-8, sum(abs(prob_delta))), 6) AS value
FROM corpus_long GROUP BY reasoning_pattern, dim""", "corpus_long"))
def q_weighted_mean_signed(spark, sf):
    """sum(w v) / max(1e-8, sum|w|) per reasoning pattern, w = prob_delta."""
    c = X.vector_corpus(spark, sf)
    return tidy(V.weighted_mean_long(c, ["reasoning_pattern"], "steering_vector", "prob_delta"))


@query("weighted_mean_abs", with_ctes("""
SELECT reasoning_pattern, CAST(dim AS BIGINT) AS dim,
       round(sum(abs(prob_delta) * x) / greatest(1e-8, sum(abs(prob_delta))), 6) AS value
FROM corpus_long GROUP BY reasoning_pattern, dim""", "corpus_long"))
def q_weighted_mean_abs(spark, sf):
    """The same with |w|."""
    c = X.vector_corpus(spark, sf)
    return tidy(V.weighted_mean_long(c, ["reasoning_pattern"], "steering_vector", "prob_delta", absolute=True))


_TOPK_SQL = """
SELECT reasoning_pattern, CAST(dim AS BIGINT) AS dim, round(sum(x), 6) AS value
FROM corpus_long
WHERE row_id IN (SELECT row_id FROM (
        SELECT row_id, row_number() OVER (PARTITION BY reasoning_pattern
                                          ORDER BY abs(prob_delta) DESC, row_id) AS rk
        FROM vector_corpus) WHERE rk <= 2)
GROUP BY reasoning_pattern, dim"""


@query("topk_vector_sum", with_ctes(_TOPK_SQL, "corpus_long", "vector_corpus"))
def q_topk_vector_sum(spark, sf):
    """Sum of the 2 rows with the largest |prob_delta| per pattern."""
    c = X.vector_corpus(spark, sf).withColumn("abs_prob_delta", F.abs("prob_delta"))
    return tidy(V.topk_vector_sum_long(c, ["reasoning_pattern"], "steering_vector", "abs_prob_delta",
                                       "row_id", 2))


@query("group_representative", with_ctes("""
SELECT pivot_token, CAST(dim AS BIGINT) AS dim, round(v, 6) AS value
FROM (SELECT pivot_token, arg_min(cluster_id, row_id) AS cluster_id FROM vector_corpus GROUP BY 1)
JOIN (SELECT cluster_id, dim, avg(x) AS v FROM corpus_long GROUP BY 1, 2) USING (cluster_id)""",
                                         "corpus_long", "vector_corpus"))
def q_group_representative(spark, sf):
    """The cluster vector of the first row of each token's rows."""
    c = X.vector_corpus_clustered(spark, sf)
    rep = V.group_representative(c, "pivot_token", "cluster_vector", "row_id")
    return tidy(_long(rep, ["pivot_token"], "vector"))


_TOPK_RAW = """
SELECT reasoning_pattern, dim, sum(x) AS value FROM corpus_long
WHERE row_id IN (SELECT row_id FROM (
        SELECT row_id, row_number() OVER (PARTITION BY reasoning_pattern
                                          ORDER BY abs(prob_delta) DESC, row_id) AS rk
        FROM vector_corpus) WHERE rk <= 2)
GROUP BY reasoning_pattern, dim"""
_WMEAN_RAW = """
SELECT reasoning_pattern, dim, sum(prob_delta * x) / greatest(1e-8, sum(abs(prob_delta))) AS value
FROM corpus_long GROUP BY reasoning_pattern, dim"""


@query("match_norm", with_ctes("""
SELECT reasoning_pattern, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim,
       round(unnest(v), 6) AS value FROM r""", "corpus_long", "vector_corpus", local=[
    ("topk", _TOPK_RAW), ("wm", _WMEAN_RAW),
    ("t", "SELECT reasoning_pattern, list(value ORDER BY dim) AS v FROM topk GROUP BY reasoning_pattern"),
    ("m", "SELECT reasoning_pattern, sqrt(sum(value * value)) AS ref FROM wm GROUP BY reasoning_pattern"),
    ("r", f"""SELECT t.reasoning_pattern,
                     CASE WHEN {_n('t.v')} > 1e-8 THEN list_transform(t.v, lambda x: x * (m.ref / {_n('t.v')}))
                          ELSE t.v END AS v
              FROM t JOIN m USING (reasoning_pattern)""")]))
def q_match_norm(spark, sf):
    """The top-2 sum rescaled to the norm of the pattern's weighted mean."""
    c = X.vector_corpus(spark, sf).withColumn("abs_prob_delta", F.abs("prob_delta"))
    top = V.assemble(V.topk_vector_sum_long(c, ["reasoning_pattern"], "steering_vector", "abs_prob_delta",
                                            "row_id", 2), ["reasoning_pattern"], out_col="v")
    ref = (V.weighted_mean_long(c, ["reasoning_pattern"], "steering_vector", "prob_delta")
           .groupBy("reasoning_pattern").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("ref")))
    out = top.join(ref, "reasoning_pattern").select("reasoning_pattern",
                                                    V.match_norm("v", F.col("ref")).alias("v"))
    return tidy(_long(out, ["reasoning_pattern"], "v"))


@query("l2_norm_unit", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(dim AS BIGINT) AS dim,
       round(value / greatest(1e-12, nrm), 6) AS value, round(nrm, 6) AS norm
FROM (SELECT layer, dim, value, sqrt(sum(value * value) OVER (PARTITION BY layer)) AS nrm
      FROM train_dir_long)""", "train_dir_long"))
def q_l2_norm_unit(spark, sf):
    """Norm and unit vector of the train direction per layer."""
    d = V.l2_norm_unit(_train_dirs(spark, sf), "direction")
    return tidy(d.select("layer", "norm", F.posexplode("unit").alias("dim", "value")))


_TEST_DIR = """
SELECT layer, dim, avg(x) FILTER (WHERE label >= 0.5) - avg(x) FILTER (WHERE label < 0.5) AS value
FROM acts_long WHERE split = 'test' GROUP BY layer, dim"""


@query("cosine", with_ctes("""
SELECT CAST(a.layer AS BIGINT) AS layer,
       round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value)) + 1e-12), 6)
           AS cos_train_test
FROM train_dir_long a JOIN test_dir_long b ON a.layer = b.layer AND a.dim = b.dim
GROUP BY a.layer""", "train_dir_long", "acts_long", local=[("test_dir_long", _TEST_DIR)]))
def q_cosine(spark, sf):
    """Cosine between the train and the test direction per layer."""
    test = V.assemble(V.centroid_diff_long(_test(spark, sf), ["layer"], "label", "activation"),
                      ["layer"], out_col="tdir")
    j = _train_dirs(spark, sf).join(test, "layer")
    return tidy(j.select("layer", vec.cosine("direction", "tdir").alias("cos_train_test")))


@query("cosine_vs_reference", with_ctes(f"""
SELECT row_id, round(c, 6) AS cosine, c > 0 AS same_sign
FROM (SELECT row_id, {_d('steering_vector', 'ref')} / ({_n('steering_vector')} * {_n('ref')} + 1e-12) AS c
      FROM vector_corpus CROSS JOIN refv)""", "vector_corpus", "corpus_long", local=[
    ("refl", "SELECT dim, avg(x) AS value FROM corpus_long GROUP BY dim"),
    ("refv", "SELECT list(value ORDER BY dim) AS ref FROM refl")]))
def q_cosine_vs_reference(spark, sf):
    """Every corpus vector against one reference (the corpus mean),
    which travels as a scalar subquery."""
    c = X.vector_corpus(spark, sf)
    ref = V.assemble(V.centroid_long(c.withColumn("_all", F.lit(1)), ["_all"], "steering_vector"),
                     ["_all"], out_col="ref").select("ref").scalar()
    out = V.cosine_vs_reference(c, ref, "steering_vector")
    return tidy(out.select("row_id", "cosine", "same_sign"))


_SEP_LOCAL = [
    ("u", f"""SELECT layer, query_id, label >= 0.5 AS pos,
                    list_transform(activation, lambda x: CAST(x AS DOUBLE) /
                        CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END) AS u
             FROM (SELECT *, {_n('activation')} AS nrm FROM activations WHERE split = 'train')"""),
    ("p", f"""SELECT a.layer, a.pos AS pa, b.pos AS pb, {_d('a.u', 'b.u')} AS s
             FROM u a JOIN u b ON a.layer = b.layer AND a.query_id < b.query_id"""),
    ("agg", """SELECT layer,
                      avg(s) FILTER (WHERE pa AND pb) AS ip, avg(s) FILTER (WHERE NOT pa AND NOT pb) AS ineg,
                      avg(s) FILTER (WHERE pa = pb) AS io, avg(s) FILTER (WHERE pa <> pb) AS x
               FROM p GROUP BY layer"""),
    ("cnt", """SELECT layer, sum(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS n_pos,
                      sum(CASE WHEN label >= 0.5 THEN 0 ELSE 1 END) AS n_neg
               FROM activations WHERE split = 'train' GROUP BY layer"""),
]


# The oracle is the brute-force pair average (all pairs, small fixture); the
# Spark side is the linear closed form.
@query("separability", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
       round(coalesce(ip, 0.0), 6) AS mean_intra_pivotal, round(coalesce(ineg, 0.0), 6) AS mean_intra_nonpivotal,
       round(coalesce(io, 0.0), 6) AS mean_intra_overall, round(coalesce(x, 0.0), 6) AS mean_inter,
       round(coalesce(io, 0.0) - coalesce(x, 0.0), 6) AS separability_gap
FROM cnt LEFT JOIN agg USING (layer)""", "activations", local=_SEP_LOCAL))
def q_separability(spark, sf):
    """Class separability of the train split per layer, closed form."""
    return tidy(V.separability(_train(spark, sf)))


def _steered_test(spark, sf, mode, coef, mask=None):
    t = _test(spark, sf).join(F.broadcast(_train_dirs(spark, sf)), "layer")  # one row per layer
    if mask is None:
        out = t.withColumn("v", V.steer("activation", "direction", coef, mode))
    else:
        out = t.withColumn("v", V.steer_masked("activation", "direction", coef, mask, mode))
    return tidy(_long(out, ["layer", "query_id"], "v"))


def _steer_sql(expr: str, where: str = "a.split = 'test'") -> str:
    return with_ctes(f"""
SELECT CAST(layer AS BIGINT) AS layer, query_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim,
       round(unnest(v), 6) AS value
FROM (SELECT a.layer, a.query_id, {expr} AS v
      FROM activations a JOIN train_dir d ON a.layer = d.layer WHERE {where})""", "activations", "train_dir")


_VHAT = "(d.direction[i] / ({n} + 1e-8))".format(n=_n("d.direction"))


@query("steer_additive_raw", _steer_sql(
    "list_transform(a.activation, lambda x, i: CAST(x AS DOUBLE) + 1.5 * d.direction[i])"))
def q_steer_additive_raw(spark, sf):
    """H + c v on the test activations, v = train direction, c = 1.5."""
    return _steered_test(spark, sf, "additive_raw", 1.5)


@query("steer_additive_normalized", _steer_sql(
    f"list_transform(a.activation, lambda x, i: CAST(x AS DOUBLE) + 0.5 * {_n('a.activation')} * {_VHAT})"))
def q_steer_additive_normalized(spark, sf):
    """H + c |h| v / (|v| + 1e-8), c = 0.5."""
    return _steered_test(spark, sf, "additive_normalized", 0.5)


_PROJ = ("list_transform(a.activation, lambda x, i: CAST(x AS DOUBLE) + ({c} - 1.0) * "
         "list_sum(list_transform(a.activation, lambda y, j: CAST(y AS DOUBLE) * "
         "(d.direction[j] / ({n} + 1e-8)))) * {vh})")


@query("steer_projection", _steer_sql(_PROJ.format(c="0.0", n=_n("d.direction"), vh=_VHAT)))
def q_steer_projection(spark, sf):
    """H + (c - 1)(h . v_hat) v_hat with c = 0 (ablation)."""
    return _steered_test(spark, sf, "projection", 0.0)


@query("steer_masked", _steer_sql(
    "CASE WHEN a.label = 1 THEN list_transform(a.activation, lambda x, i: CAST(x AS DOUBLE) + 2.0 * d.direction[i])"
    " ELSE list_transform(a.activation, lambda x: CAST(x AS DOUBLE)) END"))
def q_steer_masked(spark, sf):
    """Additive steering (c = 2) only at positions with label 1."""
    return _steered_test(spark, sf, "additive_raw", 2.0, mask=F.col("label") == 1)


def _injections(spark, sf):
    """Two injections per layer L: its own direction, then that of layer
    (L+1) mod 4, both with coefficient 0.2."""
    d = _train_dirs(spark, sf)
    own = d.select("layer", F.lit(0).alias("inj_ord"), F.lit(0.2).alias("coef"), "direction")
    nxt = d.select(((F.col("layer") + 3) % 4).alias("layer"), F.lit(1).alias("inj_ord"),
                   F.lit(0.2).alias("coef"), "direction")
    return own.unionByName(nxt).withColumn("variant", F.concat(F.lit("L"), F.col("layer").cast("string")))


_MULTI_LOCAL = [
    ("s1", f"""SELECT a.layer, a.query_id,
                   list_transform(a.activation, lambda x, i: CAST(x AS DOUBLE) + 0.2 * {_n('a.activation')} * {_VHAT})
                       AS h
               FROM activations a JOIN train_dir d ON a.layer = d.layer WHERE a.split = 'test'"""),
    ("s2", f"""SELECT s1.layer, s1.query_id,
                   list_transform(s1.h, lambda x, i: x + 0.2 * {_n('s1.h')} * {_VHAT}) AS v
               FROM s1 JOIN train_dir d ON d.layer = (s1.layer + 1) % 4"""),
]


@query("steer_multi", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, query_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim,
       round(unnest(v), 6) AS value FROM s2""", "activations", "train_dir", local=_MULTI_LOCAL))
def q_steer_multi(spark, sf):
    """Two normalized injections on each layer, applied in order."""
    out = V.steer_multi(_test(spark, sf), _injections(spark, sf), mode="additive_normalized")
    return tidy(_long(out, ["layer", "query_id"], "steered"))


@query("injected_energy", with_ctes(f"""
SELECT 'L' || CAST(a.layer AS VARCHAR) AS variant, round(0.2 * {_n('a.direction')} + 0.2 * {_n('b.direction')}, 6)
           AS energy
FROM train_dir a JOIN train_dir b ON b.layer = (a.layer + 1) % 4""", "train_dir"))
def q_injected_energy(spark, sf):
    """Sum |c| |v| per injection variant."""
    return tidy(V.injected_energy(_injections(spark, sf)))


@query("layer_range_spec", with_ctes("""
SELECT CAST(p.layer AS BIGINT) AS probe_layer, CAST(o.off AS BIGINT) AS offset,
       array_to_string(list(v.layer ORDER BY v.layer), ',') AS layers, CAST(count(*) AS BIGINT) AS n_layers
FROM (SELECT DISTINCT layer FROM train_dir) p CROSS JOIN (VALUES (2), (4), (6)) o(off)
JOIN (SELECT DISTINCT layer FROM train_dir) v ON v.layer BETWEEN p.layer - o.off AND p.layer
WHERE p.layer - o.off >= 1
GROUP BY p.layer, o.off HAVING count(*) >= 2""", "train_dir"))
def q_layer_range_spec(spark, sf):
    """Layer ranges [p - off, p] with a vector at >= 2 layers, start >= 1."""
    d = _train_dirs(spark, sf)
    out = V.layer_range_spec(d, d)
    return tidy(out.select("probe_layer", "offset", F.array_join("layers", ",").alias("layers"), "n_layers"))


_CLUSTER_B = "CASE WHEN prob_delta < -0.25 THEN -1 ELSE cluster_id % 4 END"


@query("clustering_agreement", with_ctes(f"""
SELECT round(CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0
                  ELSE (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) END, 6)
           AS ari,
       round(noise_rate, 6) AS noise_rate, CAST(n_clusters AS BIGINT) AS n_clusters, CAST(n AS BIGINT) AS n
FROM (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM c),
     (SELECT sum(x * (x - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS x FROM c GROUP BY a)),
     (SELECT sum(x * (x - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS x FROM c GROUP BY b)),
     (SELECT avg(CASE WHEN {_CLUSTER_B} = -1 THEN 1.0 ELSE 0.0 END) AS noise_rate,
             count(DISTINCT CASE WHEN {_CLUSTER_B} <> -1 THEN {_CLUSTER_B} END) AS n_clusters
      FROM vector_corpus)""", "vector_corpus", local=[
    ("c", f"SELECT cluster_id AS a, {_CLUSTER_B} AS b, count(*) AS nij FROM vector_corpus GROUP BY 1, 2")]))
def q_clustering_agreement(spark, sf):
    """Adjusted Rand index between the given clusters and a second
    labelling (noise = -1), with noise rate and cluster count."""
    c = X.vector_corpus(spark, sf).withColumn(
        "b", F.when(F.col("prob_delta") < -0.25, F.lit(-1)).otherwise(F.col("cluster_id") % 4))
    return tidy(V.clustering_agreement(c, "cluster_id", "b"))


@query("token_logprob", """
SELECT vec_id, CAST(label AS BIGINT) AS token_id,
       round(CAST(embedding[label + 1] AS DOUBLE) - m
             - ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - m)))), 6) AS logp
FROM (SELECT *, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings)""")
def q_token_logprob(spark, sf):
    """log_softmax(logits)[token] (stable), logits = the 64-d embedding."""
    from ..sources.tables import load
    e = load(spark, sf, "embeddings")
    return tidy(e.select("vec_id", F.col("label").alias("token_id"),
                         V.token_logprob("embedding", "label").alias("logp")))
