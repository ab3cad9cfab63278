"""Registered queries for probe training.

The oracle of the logistic probes reaches the same optimum by accelerated
gradient descent in a recursive CTE.  The Adam probes follow a hash order
that DuckDB lacks: no SQL; the tests compare them with a sequential loop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import probes as P
from ..operators import sampling as S
from ..operators import training as TR
from ..operators import vectors as V
from ..sources import fixtures as X
from .registry import query, tidy, with_ctes


def _split(spark, sf):
    a = X.activations_shifted(spark, sf)
    return a.where(F.col("split") == "train"), a.where(F.col("split") == "test")


def logreg_metrics(spark, sf, C: float = 1.0, layers=None):
    """Train per layer, score the test split with the raw-space weights,
    binary metrics + AUROC per layer."""
    train, test = _split(spark, sf)
    probes = TR.train_logreg_layers(train, layers=layers, C=C)
    ev = P.evaluate_probes(test, probes.select("layer", "c", F.col("coef_raw").alias("weights"),
                                               F.col("bias_raw").alias("bias"), "n_train"),
                           extra_keys=["c", "n_train"])
    return ev.join(probes.select("layer", "c", vec.norm("coef_scaled").alias("coef_norm")), ["layer", "c"])


def flagship(spark, sf):
    ev = logreg_metrics(spark, sf)
    return tidy(ev.select("layer", "n_train", "TN", "FP", "FN", "TP", "accuracy", "precision", "recall",
                          "f1_score", "auroc_score", "coef_norm"))


# the raw weights' cosine with the train centroid difference
_COSINES = [("cosines", """
SELECT p.layer, p.c, list_cosine_similarity(p.raw, d.direction) AS cos
FROM lr_probes p JOIN (SELECT layer, list(v ORDER BY dim) AS direction
      FROM (SELECT layer, dim, avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0) AS v
            FROM (SELECT layer, label, generate_subscripts(activation, 1) AS dim, CAST(unnest(activation) AS DOUBLE) AS x
                  FROM acts_shifted WHERE split = 'train') GROUP BY layer, dim) GROUP BY layer) d ON p.layer = d.layer""")]


@query("train_logreg", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, n_train, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
       round(auroc_score, 6) AS auroc_score, round(coef_norm, 6) AS coef_norm
FROM lr_eval WHERE c = 1.0 AND layer = 1""", "lr_eval"))
def q_train_logreg(spark, sf):
    """L2 logistic probe (C = 1) for layer 1 with validation metrics."""
    ev = logreg_metrics(spark, sf, layers=[1])
    return tidy(ev.select("layer", "n_train", "accuracy", "f1_score", "auroc_score", "coef_norm"))


@query("train_logreg_layers", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, n_train, TN, FP, FN, TP, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(auroc_score, 6) AS auroc_score, round(coef_norm, 6) AS coef_norm
FROM lr_eval WHERE c = 1.0""", "lr_eval"))
def q_train_logreg_layers(spark, sf):
    """The probe for every layer (layers without two classes skipped)."""
    return flagship(spark, sf)


@query("c_sweep", with_ctes("""
SELECT CAST(e.layer AS BIGINT) AS layer, round(e.c, 6) AS c, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
       round(auroc_score, 6) AS auroc_score, round(coef_norm, 6) AS coef_norm, round(cos, 6) AS cos_to_centroid,
       first_value(e.c) OVER (PARTITION BY e.layer ORDER BY accuracy DESC, e.c) AS best_c_by_accuracy,
       first_value(e.c) OVER (PARTITION BY e.layer ORDER BY cos DESC, e.c) AS best_c_by_cosine
FROM lr_eval e JOIN cosines k ON e.layer = k.layer AND e.c = k.c""", "lr_eval", local=_COSINES))
def q_c_sweep(spark, sf):
    """C in {0.001, 0.01, 0.1, 1}: accuracy, F1, AUROC, |w| and cosine of
    the raw weights with the train centroid difference; best C by accuracy
    and by cosine per layer."""
    train, test = _split(spark, sf)
    probes = TR.c_sweep(train, (0.001, 0.01, 0.1, 1.0))
    ev = P.evaluate_probes(test, probes.select("layer", "c", F.col("coef_raw").alias("weights"),
                                               F.col("bias_raw").alias("bias")), extra_keys=["c"])
    cent = V.centroid_diff(train, ["layer"], "label", "activation")
    j = (ev.join(probes.select("layer", "c", "coef_raw", vec.norm("coef_scaled").alias("coef_norm")), ["layer", "c"])
         .join(cent.select("layer", "direction"), "layer")
         .withColumn("cos_to_centroid", vec.cosine("coef_raw", "direction")))
    best_acc = S.topk_per_group(j, ["layer"], [F.col("accuracy").desc(), F.col("c")], 1, "_r1", salt_buckets=0)
    best_cos = S.topk_per_group(j, ["layer"], [F.col("cos_to_centroid").desc(), F.col("c")], 1, "_r2",
                                salt_buckets=0)
    out = (j.join(best_acc.select("layer", F.col("c").alias("best_c_by_accuracy")), "layer")
           .join(best_cos.select("layer", F.col("c").alias("best_c_by_cosine")), "layer"))
    return tidy(out.select("layer", "c", "accuracy", "f1_score", "auroc_score", "coef_norm", "cos_to_centroid",
                           "best_c_by_accuracy", "best_c_by_cosine"))


@query("logreg_coefficients", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, round(c, 6) AS c, CAST(unnest(range(17)) AS BIGINT) AS dim,
       round(unnest(list_append(coef_scaled, intercept_scaled)), 6) AS w FROM lr_probes""", "lr_probes"))
def q_logreg_coefficients(spark, sf):
    """Every scaled coefficient of every layer and C, the intercept as
    the last dim."""
    p = TR.c_sweep(_split(spark, sf)[0], (0.001, 0.01, 0.1, 1.0))
    return tidy(p.select("layer", "c", F.posexplode(F.concat("coef_scaled", F.array("intercept_scaled"))).alias("dim", "w")))


@query("logreg_stationarity", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, round(c, 6) AS c, CAST(count(*) AS BIGINT) AS n_train, true AS stationary
FROM acts_shifted CROSS JOIN (VALUES (CAST(0.001 AS DOUBLE)), (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) v(c)
WHERE split = 'train' GROUP BY layer, c""", "acts_shifted"))
def q_logreg_stationarity(spark, sf):
    """At each trained probe the gradient of sum(loss) + |w|^2 / (2 C)
    in scaled space vanishes (largest entry below 1e-3 a row)."""
    train, _ = _split(spark, sf)
    p = TR.c_sweep(train, (0.001, 0.01, 0.1, 1.0)).select("layer", "c", "coef_scaled", "intercept_scaled", "mean", "std")
    rows = train.select("layer", "label", "activation").join(F.broadcast(p), "layer")  # one probe per layer and C
    xs = F.zip_with(F.zip_with("activation", "mean", lambda x, m: x.cast("double") - m), "std", lambda x, s: x / s)
    rows = rows.withColumn("xs", xs)
    rows = rows.withColumn("r", vec.sigmoid(vec.dot("xs", "coef_scaled") + F.col("intercept_scaled"))
                           - (F.col("label") >= 0.5).cast("double"))
    # the intercept's entry is a last dim of ones with no penalty
    entries = F.arrays_zip(F.concat("xs", F.array(F.lit(1.0))).alias("x"), F.concat("coef_scaled", F.array(F.lit(0.0))).alias("w"))
    g = rows.select("layer", "c", "r", F.posexplode(entries).alias("dim", "e")).groupBy("layer", "c", "dim").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("r") * F.col("e.x")) + F.max("e.w") / F.col("c")).alias("g"))
    return tidy(g.groupBy("layer", "c").agg(
        F.max("n").alias("n_train"), (F.max(F.abs("g") / F.col("n")) < 1e-3).alias("stationary")))


def _adam(spark, sf, epochs=10):
    train, test = _split(spark, sf)
    probes, losses = TR.train_adam_layers(train, epochs=epochs)
    return P.evaluate_probes(test, probes), losses


@query("train_adam_probe")
def q_train_adam_probe(spark, sf):
    """E5: Adam probes (lr 1e-3, batch 32, 10 epochs) by parameter averaging."""
    ev, _ = _adam(spark, sf)
    return tidy(ev.select("layer", "accuracy", "f1_score", "auroc_score"))


@query("epoch_loss_table")
def q_epoch_loss_table(spark, sf):
    """Mean batch loss per layer and epoch."""
    _, losses = _adam(spark, sf, epochs=5)
    return tidy(losses)


@query("training_summary", with_ctes("""
SELECT 'spark_logreg' AS backend, CAST(layer AS BIGINT) AS best_layer, round(accuracy, 6) AS best_accuracy,
       (SELECT string_agg(CAST(layer AS VARCHAR), ',' ORDER BY CAST(layer AS VARCHAR)) FROM lr_eval WHERE c = 1.0) AS selected_layers,
       (SELECT CAST(max(len(activation)) AS BIGINT) FROM activations) AS input_dim
FROM lr_eval WHERE c = 1.0 ORDER BY accuracy DESC, layer LIMIT 1""", "lr_eval"))
def q_training_summary(spark, sf):
    """Backend, selected layers, input dim, best layer and accuracy."""
    ev = logreg_metrics(spark, sf)
    sel = ev.select("layer", F.col("layer").alias("sel_ord"))
    best = P.best_layer(ev, sel)
    dims = X.activations(spark, sf).agg(F.max(F.size("activation")).alias("input_dim"))
    summ = ev.agg(F.array_join(F.array_sort(F.collect_list(F.col("layer").cast("string"))), ",")
                  .alias("selected_layers"))
    out = best.select(F.lit("spark_logreg").alias("backend"), "best_layer", "best_accuracy",
                      summ.scalar().alias("selected_layers"), dims.scalar().alias("input_dim"))
    return tidy(out)


@query("smoke_train")
def q_smoke_train(spark, sf):
    """One layer, one epoch, at most 64 rows per class, both trainers."""
    train, test = _split(spark, sf)
    capped = S.cap_per_class(train.where(F.col("layer") == 1), ["layer", "label"], "query_id", 64)
    lr = TR.train_logreg_layers(capped, C=1.0)
    ev_lr = P.evaluate_probes(test, lr.select("layer", F.col("coef_raw").alias("weights"),
                                              F.col("bias_raw").alias("bias")))
    adam, _ = TR.train_adam_layers(capped, epochs=1)
    ev_ad = P.evaluate_probes(test, adam)
    out = (ev_lr.select("layer", F.lit("logreg").alias("backend"), "accuracy")
           .unionByName(ev_ad.select("layer", F.lit("adam").alias("backend"), "accuracy")))
    n = capped.groupBy("layer").agg(F.count(F.lit(1)).alias("n_train"))
    return tidy(out.join(n, "layer"))
