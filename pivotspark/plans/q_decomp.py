"""Registered queries for thinning, PCA and visualisation tables
(SURVEY §2.B6, B10, D4, D16-D18, D26, D27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import decomp as DC
from ..operators import sampling as S
from ..operators import training as TR
from ..operators import vectors as V
from ..operators.ranking import exact_group_quantile
from ..sources import fixtures as X
from .q_train import _COSINES
from .q_vectors import _train, _train_dirs
from .registry import query, tidy, with_ctes

_THIN_SQL = """
SELECT CAST(layer AS BIGINT) AS layer, query_id, CAST(label AS BIGINT) AS label, CAST((rn - 1) // step AS BIGINT) AS row_index,
       CAST(j AS BIGINT) AS dim, round(CAST(activation[j * dstep + 1] AS DOUBLE), 6) AS value
FROM (SELECT *, greatest(1, cnt // {mr}) AS step, greatest(1, len(activation) // {md}) AS dstep
      FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY label DESC, query_id) AS rn,
                   count(*) OVER (PARTITION BY layer) AS cnt
            FROM activations WHERE split = 'train')),
     LATERAL (SELECT unnest(range(0, least({md}, CAST(ceil(len(activation) / dstep) AS INTEGER)))) AS j)
WHERE (rn - 1) % step = 0 AND (rn - 1) // step < {mr}"""


def _thin_long(df):
    return df.select("layer", "query_id", "label", "row_index", F.posexplode("activation").alias("dim", "value"))


@query("heatmap_rows", with_ctes(_THIN_SQL.format(mr=50, md=8), "activations"))
def q_heatmap_rows(spark, sf):
    """Per layer, train rows by label desc (then id), thinned to 50 rows
    and 8 dims; ranks without a single-task window."""
    return tidy(_thin_long(DC.heatmap_rows(_train(spark, sf), 50, 8)))


@query("stride_sample", with_ctes(_THIN_SQL.format(mr=30, md=5), "activations"))
def q_stride_sample(spark, sf):
    """Per layer, every step-th row (step = n // 30) and every step-th dim
    (first 5)."""
    a = _train(spark, sf)
    return tidy(_thin_long(DC.stride_sample(a, DC.by_label_then_id(), 30, "activation", 5, ["layer"])))


_UNIFORM = "(CAST(('0x' || substr(md5(CAST(seed AS VARCHAR) || '|' || CAST(layer AS VARCHAR) || '|' || CAST(dim AS VARCHAR) || '|{k}'), 1, 8)) AS BIGINT) / 4294967296.0)"


@query("random_directions", with_ctes(f"""
SELECT CAST(layer AS BIGINT) AS layer, CAST(seed AS BIGINT) AS seed, round(sqrt(sum(r * r)), 6) AS norm,
       round(sum(g * r) / (sqrt(sum(g * g)) * sqrt(sum(r * r)) + 1e-12), 6) AS cos_to_reference
FROM (SELECT layer, seed, dim, value AS r,
             sqrt(-2.0 * ln(1.0 - {_UNIFORM.format(k='a')})) * cos(2 * pi() * {_UNIFORM.format(k='b')}) AS g
      FROM train_dir_long CROSS JOIN (VALUES (1), (2), (3)) s(seed))
GROUP BY layer, seed""", "train_dir_long"))
def q_random_directions(spark, sf):
    """Three seeded Gaussian directions per layer, rescaled to the train
    direction's norm, with their cosine to it."""
    r = DC.random_directions(_train_dirs(spark, sf), (1, 2, 3))
    return tidy(r.select("layer", "seed", "norm", "cos_to_reference"))


# The oracle's eigenvectors: a matrix squared again and again becomes the
# product of its top eigenvector with itself.

def _powers(name: str, matrix: str) -> tuple[str, str]:
    return name, f"""
SELECT 0 AS it, g, i, j, x / max(abs(x)) OVER (PARTITION BY g) AS x FROM {matrix}
UNION ALL
SELECT it + 1, g, i, j, x / max(abs(x)) OVER (PARTITION BY g)
FROM (SELECT a.it, a.g, a.i, b.j, sum(a.x * b.x) AS x FROM {name} a JOIN {name} b ON a.g = b.g AND a.j = b.i
      WHERE a.it < 40 GROUP BY a.it, a.g, a.i, b.j)"""


def _top(name: str, powers: str) -> tuple[str, str]:
    """The column with the largest diagonal entry, of length 1, its largest
    entry positive."""
    return name, f"""
SELECT g, i, x / sqrt(sum(x * x) OVER (PARTITION BY g)) * sign(first_value(x) OVER (PARTITION BY g ORDER BY abs(x) DESC, i)) AS v
FROM {powers} JOIN (SELECT g, arg_max(i, x) AS j FROM {powers} WHERE it = 40 AND i = j GROUP BY g) USING (g, j) WHERE it = 40"""


def _value(name: str, matrix: str, vectors: str) -> tuple[str, str]:
    return name, f"""
SELECT g, sum(m.x * a.v * b.v) AS value FROM {matrix} m JOIN {vectors} a USING (g, i) JOIN {vectors} b ON b.g = m.g AND b.i = m.j GROUP BY g"""


_PCA_LOCAL = [
    ("cov", """
SELECT layer AS g, a.dim AS i, b.dim AS j, sum(a.x * b.x) AS x
FROM (SELECT layer, query_id, dim, x - avg(x) OVER (PARTITION BY layer, dim) AS x FROM acts_long) a
JOIN (SELECT layer, query_id, dim, x - avg(x) OVER (PARTITION BY layer, dim) AS x FROM acts_long) b USING (layer, query_id)
GROUP BY layer, a.dim, b.dim"""),
    _powers("pow1", "cov"), _top("vec1", "pow1"), _value("val1", "cov", "vec1"),
    ("rest", """
SELECT g, m.i, m.j, m.x - value * a.v * b.v AS x FROM cov m JOIN val1 USING (g) JOIN vec1 a USING (g, i) JOIN vec1 b ON b.g = m.g AND b.i = m.j"""),
    _powers("pow2", "rest"), _top("vec2", "pow2"), _value("val2", "cov", "vec2")]


@query("pca_2d", with_ctes("""
SELECT CAST(g AS BIGINT) AS layer, bucket, round(sum(c * a.v), 6) AS pc1, round(sum(c * b.v), 6) AS pc2,
       round(any_value(val1.value / t), 6) AS evr1, round(any_value(val2.value / t), 6) AS evr2
FROM (SELECT layer AS g, bucket, dim AS i, avg(x) AS c
      FROM (SELECT layer, bucket, dim, x - avg(x) OVER (PARTITION BY layer, dim) AS x FROM acts_long) GROUP BY ALL)
JOIN vec1 a USING (g, i) JOIN vec2 b USING (g, i) JOIN val1 USING (g) JOIN val2 USING (g)
JOIN (SELECT g, sum(x) AS t FROM cov WHERE i = j GROUP BY g) USING (g)
GROUP BY g, bucket""", "acts_long", local=_PCA_LOCAL, recursive=True))
def q_pca_2d(spark, sf):
    """Per layer, 2-component centred PCA of the activations: explained
    variance ratio and the projected class centroids."""
    a = X.activations(spark, sf)
    model = DC.pca(a)
    centroids = DC.project(a, model).groupBy("layer", "bucket").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
    return tidy(centroids.join(model, "layer").select(
        "layer", "bucket", "pc1", "pc2", F.col("ratio")[0].alias("evr1"), F.col("ratio")[1].alias("evr2")))


@query("pc1_outlier_filter", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(n - floor(0.05 * (n - 1)) - CASE WHEN 0.05 * (n - 1) = floor(0.05 * (n - 1)) THEN 0 ELSE 1 END
       AS BIGINT) AS n_kept
FROM (SELECT layer, count(*) AS n FROM activations GROUP BY layer)""", "activations"))
def q_pc1_outlier_filter(spark, sf):
    """Per layer, rows with pc1 below a bound dropped (bound: the exact
    5th percentile of the layer's pc1 here, -30 in the notebook's units)."""
    a = X.activations(spark, sf)
    rows = DC.project(a, DC.pca(a, 1), 1)
    bounds = exact_group_quantile(rows, ["layer"], "pc1", 0.05, "bound")
    rows = rows.join(F.broadcast(bounds), "layer")  # one row a layer
    kept = S.pc1_outlier_filter(rows, layer=F.col("layer"), bound=F.col("bound"))
    return tidy(kept.groupBy("layer").agg(F.count(F.lit(1)).alias("n_kept")))


@query("pca_column_order", with_ctes("""
SELECT row_number() OVER (ORDER BY v DESC, i) - 1 AS position, CAST(i AS BIGINT) AS dim FROM vec1""", "corpus_long", local=[
    ("gram", """
SELECT 0 AS g, a.dim AS i, b.dim AS j, sum(a.x * b.x) AS x
FROM (SELECT row_id, dim, x - avg(x) OVER (PARTITION BY row_id) AS x FROM corpus_long) a
JOIN (SELECT row_id, dim, x - avg(x) OVER (PARTITION BY row_id) AS x FROM corpus_long) b USING (row_id) GROUP BY a.dim, b.dim"""),
    _powers("pow1", "gram"), _top("vec1", "pow1")], recursive=True))
def q_pca_column_order(spark, sf):
    """Corpus dims ordered by the first PC of the transposed matrix."""
    order = DC.pca_column_order(X.vector_corpus(spark, sf))
    return spark.createDataFrame([(i, d) for i, d in enumerate(order)], "position long, dim long")


@query("cluster_heatmap", with_ctes("""
SELECT row_id, CAST(cluster_id AS BIGINT) AS cluster_id, row_id IN (
           SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY cluster_id
                                   ORDER BY reasoning_pattern, prob_delta, row_id) AS rn FROM vector_corpus) WHERE rn = 1) AS boundary,
       CAST(dim AS BIGINT) AS dim,
       round(least(greatest(x, (SELECT quantile_cont(x, 0.01) FROM corpus_long)), (SELECT quantile_cont(x, 0.99) FROM corpus_long)), 6) AS x
FROM corpus_long""", "corpus_long", "vector_corpus"))
def q_cluster_heatmap(spark, sf):
    """Every cell of the corpus, clipped to the 1st..99th percentile,
    with the cluster boundaries (the order of the dims is D27's)."""
    return tidy(DC.cluster_heatmap(X.vector_corpus(spark, sf)).select("row_id", "cluster_id", "boundary", "dim", "x"))


@query("probe_weight_direction", with_ctes("""
SELECT CAST(p.layer AS BIGINT) AS layer, round(sqrt(list_dot_product(raw, raw)), 6) AS norm, cos > 0 AS agrees_with_centroid
FROM lr_probes p JOIN cosines k ON p.layer = k.layer AND p.c = k.c WHERE p.c = 1.0""", "lr_probes", local=_COSINES))
def q_probe_weight_direction(spark, sf):
    """Trained probe weights (raw space) used as a direction; their norm
    and sign agreement with the train centroid difference."""
    train = X.activations_shifted(spark, sf).where(F.col("split") == "train")
    p = V.probe_weight_direction(TR.train_logreg_layers(train), "coef_raw")
    cent = V.centroid_diff(train, ["layer"], "label", "activation").select("layer", F.col("direction").alias("c"))
    j = p.join(cent, "layer")
    return tidy(j.select("layer", vec.norm("direction").alias("norm"),
                         (vec.cosine("direction", "c") > 0).alias("agrees_with_centroid")))
