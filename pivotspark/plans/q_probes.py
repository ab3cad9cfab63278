"""Registered queries for probe scoring and metrics.

Probes with fixed weights (the per-layer train centroid difference, bias 0)
score the test split; training itself lives in ``operators.training`` and is
checked by invariants in the tests, not by SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import probes as P
from ..operators import vectors as V
from .q_vectors import _d, _test, _train, _train_dirs
from .registry import query, tidy, with_ctes


def fixed_probes(spark, sf):
    """backend 'centroid': w = train direction, b = 0."""
    return _train_dirs(spark, sf).select("layer", F.col("direction").alias("weights"),
                                         F.lit(0.0).alias("bias"))


def midpoint_probes(spark, sf):
    """backend 'centroid_mid': same w, b = -w . (mu_pos + mu_neg) / 2; it has
    no probe for layer 0 (exercises missing layers)."""
    t = V.centroid_diff_long(_train(spark, sf), ["layer"], "label", "activation")
    mid = t.withColumn("mid", (F.col("mean_pos") + F.col("mean_neg")) / 2)
    w = V.assemble(mid, ["layer"], out_col="weights")
    m = V.assemble(mid, ["layer"], value_col="mid", out_col="mid")
    return (w.join(m, "layer").where(F.col("layer") != 0)
            .select("layer", "weights", (-vec.dot("weights", "mid")).alias("bias")))


def scored_test(spark, sf, probes=None):
    return P.score(_test(spark, sf), probes if probes is not None else fixed_probes(spark, sf))


_PROBE_LOCAL = [
    ("probes", "SELECT layer, direction AS w, 0.0 AS b FROM train_dir"),
    ("scored", f"""SELECT a.layer, a.query_id, a.label,
                          1.0 / (1.0 + exp(-({_d('a.activation', 'p.w')} + p.b))) AS prob
                   FROM activations a JOIN probes p ON a.layer = p.layer WHERE a.split = 'test'"""),
    ("cm", """SELECT layer,
                     sum(CASE WHEN label < 0.5 AND prob < 0.5 THEN 1 ELSE 0 END) AS TN,
                     sum(CASE WHEN label < 0.5 AND prob >= 0.5 THEN 1 ELSE 0 END) AS FP,
                     sum(CASE WHEN label >= 0.5 AND prob < 0.5 THEN 1 ELSE 0 END) AS FN,
                     sum(CASE WHEN label >= 0.5 AND prob >= 0.5 THEN 1 ELSE 0 END) AS TP
              FROM scored GROUP BY layer"""),
    ("met", """SELECT layer, TN, FP, FN, TP,
                      CASE WHEN TN + FP + FN + TP > 0 THEN (TP + TN) / (TN + FP + FN + TP) ELSE 0.0 END AS accuracy,
                      CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS precision,
                      CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS recall,
                      CASE WHEN 2 * TP + FP + FN > 0 THEN 2 * TP / (2 * TP + FP + FN) ELSE 0.0 END AS f1_score,
                      CASE WHEN FN > 0 THEN FP / FN WHEN FP > 0 THEN NULL ELSE 0.0 END AS fp_fn_ratio,
                      FN = 0 AND FP > 0 AS fp_fn_inf
               FROM (SELECT layer, CAST(TN AS DOUBLE) AS TN, CAST(FP AS DOUBLE) AS FP,
                            CAST(FN AS DOUBLE) AS FN, CAST(TP AS DOUBLE) AS TP FROM cm)"""),
    ("auc", """SELECT layer, CASE WHEN count(*) > 0 THEN
                        avg(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0.0 END) END
                        AS auroc_score
               FROM (SELECT layer, prob FROM scored WHERE label >= 0.5) p
               JOIN (SELECT layer, prob FROM scored WHERE label < 0.5) n USING (layer)
               GROUP BY layer"""),
]


def _probe_sql(body: str, extra=()):
    return with_ctes(body, "activations", "train_dir", local=_PROBE_LOCAL + list(extra))


@query("standard_scaler", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS mean,
       round(CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END, 6) AS std
FROM acts_long WHERE split = 'train' GROUP BY layer, dim""", "acts_long"))
def q_standard_scaler(spark, sf):
    """Per-layer, per-dim mean and population std of the train split."""
    return tidy(P.standard_scaler_long(_train(spark, sf)))


@query("score_probe", _probe_sql("""
SELECT CAST(layer AS BIGINT) AS layer, query_id, CAST(label AS BIGINT) AS label, round(prob, 6) AS prob
FROM scored"""))
def q_score_probe(spark, sf):
    """sigmoid(w . x + b) per test row and layer."""
    return tidy(scored_test(spark, sf).select("layer", "query_id", "label", "prob"))


@query("confusion_counts", _probe_sql("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(TN AS BIGINT) AS TN, CAST(FP AS BIGINT) AS FP,
       CAST(FN AS BIGINT) AS FN, CAST(TP AS BIGINT) AS TP FROM cm"""))
def q_confusion_counts(spark, sf):
    """TN, FP, FN, TP at prob >= 0.5."""
    return tidy(P.confusion_counts(scored_test(spark, sf)))


_MET_COLS = """CAST(layer AS BIGINT) AS layer, CAST(TN AS BIGINT) AS TN, CAST(FP AS BIGINT) AS FP,
       CAST(FN AS BIGINT) AS FN, CAST(TP AS BIGINT) AS TP, round(accuracy, 6) AS accuracy,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(fp_fn_ratio, 6) AS fp_fn_ratio, fp_fn_inf"""


@query("binary_metrics", _probe_sql(f"SELECT {_MET_COLS} FROM met"))
def q_binary_metrics(spark, sf):
    """Accuracy, precision, recall, F1, FP/FN ratio per layer."""
    m = P.binary_metrics(scored_test(spark, sf)).drop("confusion_matrix")
    return tidy(m)


# The oracle AUROC is the brute-force pair average; the Spark side buckets
# scores and never builds pairs.
@query("auroc", _probe_sql("SELECT CAST(layer AS BIGINT) AS layer, round(auroc_score, 6) AS auroc_score FROM auc"))
def q_auroc(spark, sf):
    """Exact ROC AUC per layer, ties averaged."""
    return tidy(P.auroc(scored_test(spark, sf)))


@query("evaluate_probes", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
       round(auroc_score, 6) AS auroc_score, 0.4 AS threshold
FROM met4 JOIN auc USING (layer) WHERE layer IN (1, 2, 3)""", "activations", "train_dir",
                                    local=_PROBE_LOCAL + [
    ("met4", """SELECT layer,
                       avg(CASE WHEN (label >= 0.5) = (prob >= 0.4) THEN 1.0 ELSE 0.0 END) AS accuracy,
                       CASE WHEN 2 * sum(CASE WHEN label >= 0.5 AND prob >= 0.4 THEN 1 ELSE 0 END)
                                 + sum(CASE WHEN (label >= 0.5) <> (prob >= 0.4) THEN 1 ELSE 0 END) > 0
                            THEN 2.0 * sum(CASE WHEN label >= 0.5 AND prob >= 0.4 THEN 1 ELSE 0 END)
                                 / (2 * sum(CASE WHEN label >= 0.5 AND prob >= 0.4 THEN 1 ELSE 0 END)
                                    + sum(CASE WHEN (label >= 0.5) <> (prob >= 0.4) THEN 1 ELSE 0 END))
                            ELSE 0.0 END AS f1_score
                FROM scored GROUP BY layer""")]))
def q_evaluate_probes(spark, sf):
    """Re-score with stored probes, threshold 0.4, layers {1, 2, 3}."""
    e = P.evaluate_probes(_test(spark, sf), fixed_probes(spark, sf), threshold=0.4, layers=[1, 2, 3])
    return tidy(e.select("layer", "accuracy", "f1_score", "auroc_score", "threshold"))


@query("best_layer", _probe_sql("""
SELECT CAST(layer AS BIGINT) AS best_layer, round(accuracy, 6) AS best_accuracy
FROM met ORDER BY accuracy DESC, layer LIMIT 1"""))
def q_best_layer(spark, sf):
    """Argmax accuracy, first selected layer on ties."""
    m = P.binary_metrics(scored_test(spark, sf))
    sel = m.select("layer", F.col("layer").alias("sel_ord"))
    return tidy(P.best_layer(m, sel))


@query("topn_layers", _probe_sql("""
SELECT CAST(layer AS BIGINT) AS layer, round(accuracy, 6) AS accuracy, CAST(rank AS BIGINT) AS rank
FROM (SELECT layer, accuracy, row_number() OVER (ORDER BY accuracy DESC, layer) AS rank FROM met)
WHERE rank <= 2"""))
def q_topn_layers(spark, sf):
    """The 2 most accurate layers."""
    return tidy(P.topn_layers(P.binary_metrics(scored_test(spark, sf)), 2))


_MID_LOCAL = [
    ("mid", """SELECT layer, list(value ORDER BY dim) AS w,
                      list((mp + mn) / 2 ORDER BY dim) AS m
               FROM (SELECT layer, dim,
                            avg(x) FILTER (WHERE label >= 0.5) AS mp, avg(x) FILTER (WHERE label < 0.5) AS mn,
                            avg(x) FILTER (WHERE label >= 0.5) - avg(x) FILTER (WHERE label < 0.5) AS value
                     FROM acts_long WHERE split = 'train' GROUP BY layer, dim)
               GROUP BY layer"""),
    ("scored_mid", f"""SELECT a.layer, a.label,
                              1.0 / (1.0 + exp(-({_d('a.activation', 'p.w')} - {_d('p.w', 'p.m')}))) AS prob
                       FROM activations a JOIN mid p ON a.layer = p.layer
                       WHERE a.split = 'test' AND a.layer <> 0"""),
    ("acc_mid", """SELECT layer, avg(CASE WHEN (label >= 0.5) = (prob >= 0.5) THEN 1.0 ELSE 0.0 END) AS accuracy
                   FROM scored_mid GROUP BY layer"""),
]


def _mid_sql(body):
    return with_ctes(body, "activations", "train_dir", "acts_long", local=_PROBE_LOCAL + _MID_LOCAL)


def _acc_pair(spark, sf):
    a = P.binary_metrics(scored_test(spark, sf))
    b = P.binary_metrics(scored_test(spark, sf, midpoint_probes(spark, sf)))
    return a, b


@query("backend_accuracy_compare", _mid_sql("""
SELECT CAST(coalesce(a.layer, b.layer) AS BIGINT) AS layer, round(a.accuracy, 6) AS acc_centroid,
       round(b.accuracy, 6) AS acc_centroid_mid
FROM met a FULL OUTER JOIN acc_mid b ON a.layer = b.layer"""))
def q_backend_accuracy_compare(spark, sf):
    """Two backends' accuracy per layer side by side (full outer join)."""
    a, b = _acc_pair(spark, sf)
    return tidy(P.backend_accuracy_compare(a, b, "centroid", "centroid_mid"))


@query("accuracy_map_equal", _mid_sql("""
SELECT coalesce(bool_and(a.accuracy IS NOT DISTINCT FROM b.accuracy), true) AS equal,
       CAST(sum(CASE WHEN a.accuracy IS NOT DISTINCT FROM b.accuracy THEN 0 ELSE 1 END) AS BIGINT) AS n_diff
FROM met a FULL OUTER JOIN acc_mid b ON a.layer = b.layer"""))
def q_accuracy_map_equal(spark, sf):
    """Are the two backends' accuracy maps identical?"""
    a, b = _acc_pair(spark, sf)
    return tidy(P.accuracy_map_equal(a, b))


@query("metric_table", _probe_sql("""
SELECT CAST(layer AS BIGINT) AS layer, round(TRY_CAST(acc_s AS DOUBLE), 4) AS accuracy,
       round(TRY_CAST(prec_s AS DOUBLE), 4) AS precision
FROM (SELECT layer, CAST(accuracy AS VARCHAR) AS acc_s,
             CASE WHEN layer = 2 THEN 'n/a' ELSE CAST(precision AS VARCHAR) END AS prec_s FROM met)"""))
def q_metric_table(spark, sf):
    """A string-typed metrics report coerced back to numbers (bad ->
    null), 4 decimals."""
    m = P.binary_metrics(scored_test(spark, sf))
    raw = m.select("layer", F.col("accuracy").cast("string").alias("accuracy"),
                   F.when(F.col("layer") == 2, F.lit("n/a")).otherwise(F.col("precision").cast("string"))
                   .alias("precision"))
    return tidy(P.metric_table(raw, ["accuracy", "precision"]), digits=4)
