"""Probe training, scoring and metrics.

Scoring and metrics are pure DataFrame work: a probe is a row
(layer, weights, bias); scoring is a join on layer plus a dot product; every
metric is a conditional aggregate.  AUROC is exact (ties averaged) and never
sorts a whole layer in one task: scores are first cut into per-layer
quantile buckets, negatives below each bucket come from a small running sum,
and only distinct scores inside one bucket are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .ranking import group_rank
from .vectors import explode_dims, assemble


def _g(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# -- E1 ------------------------------------------------------------------------

def standard_scaler_long(df: DataFrame, group_cols=("layer",), vec_col: str = "activation") -> DataFrame:
    """Per group and dim: mean and POPULATION std (ddof 0); a zero std is
    reported as 1.0 so that scaling leaves the column unchanged."""
    g = _g(group_cols)
    ex = explode_dims(df, vec_col, g)
    st = ex.groupBy(*g, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("_sd"))
    return st.select(*g, "dim", "mean", F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd")).alias("std"))


def scaler_arrays(df: DataFrame, group_cols=("layer",), vec_col: str = "activation") -> DataFrame:
    """(group..., mean array, std array), ordered by dim."""
    g = _g(group_cols)
    st = standard_scaler_long(df, g, vec_col)
    m = assemble(st, g, value_col="mean", out_col="mean")
    s = assemble(st, g, value_col="std", out_col="std")
    return m.join(s, g)


def apply_scaler(df: DataFrame, scaler: DataFrame, group_cols=("layer",), vec_col: str = "activation",
                 out_col: str = "scaled") -> DataFrame:
    """(x - mean) / std per dim; the scaler has one row per layer."""
    g = _g(group_cols)
    j = df.join(F.broadcast(scaler), g)
    scaled = F.zip_with(F.zip_with(F.col(vec_col), F.col("mean"), lambda x, m: x.cast("double") - m),
                        F.col("std"), lambda d, s: d / s)
    return j.withColumn(out_col, scaled).drop("mean", "std")


# -- E6 ------------------------------------------------------------------------

def score(df: DataFrame, probes: DataFrame, vec_col: str = "activation", weights_col: str = "weights",
          bias_col: str = "bias", layer_col: str = "layer") -> DataFrame:
    """prob = sigmoid(w . x + b) per row; rows of layers without a probe are
    dropped (inner join).  The probe table has one row per layer (and per
    backend/C), so it is broadcast."""
    p = probes.select(layer_col, F.col(weights_col).alias("_w"), F.col(bias_col).alias("_b"),
                      *[c for c in probes.columns if c not in (layer_col, weights_col, bias_col)])
    j = df.join(F.broadcast(p), layer_col)
    return j.withColumn("prob", vec.sigmoid(vec.dot(vec_col, "_w") + F.col("_b"))).drop("_w", "_b")


# -- E7 / E8 -------------------------------------------------------------------

def confusion_counts(scored: DataFrame, group_cols=("layer",), label_col: str = "label",
                     prob_col: str = "prob", threshold=0.5) -> DataFrame:
    """TN, FP, FN, TP at prob >= threshold (labels >= 0.5 are positive)."""
    g = _g(group_cols)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y = F.col(label_col) >= 0.5
    p = F.col(prob_col) >= t
    c = lambda e: F.sum(e.cast("long"))
    return scored.groupBy(*g).agg(c(~y & ~p).alias("TN"), c(~y & p).alias("FP"),
                                  c(y & ~p).alias("FN"), c(y & p).alias("TP"))


def metrics_from_counts(cm: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 (0 on zero division), fp_fn_ratio
    (FP/FN; +inf when FN = 0 < FP, reported as null plus ``fp_fn_inf``; 0
    when both are 0) and the 2x2 matrix [[TN, FP], [FN, TP]]."""
    tn, fp, fn, tp = (F.col(c) for c in ("TN", "FP", "FN", "TP"))
    n = tn + fp + fn + tp
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return cm.select(
        "*",
        F.when(n > 0, (tp + tn) / n).otherwise(0.0).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"), f1.alias("f1_score"),
        F.when(fn > 0, fp / fn).when(fp > 0, F.lit(None)).otherwise(0.0).cast("double").alias("fp_fn_ratio"),
        ((fn == 0) & (fp > 0)).alias("fp_fn_inf"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"))


def binary_metrics(scored: DataFrame, group_cols=("layer",), label_col: str = "label",
                   prob_col: str = "prob", threshold=0.5) -> DataFrame:
    return metrics_from_counts(confusion_counts(scored, group_cols, label_col, prob_col, threshold))


# -- E9 ------------------------------------------------------------------------

def negatives_below(scored: DataFrame, group_cols=("layer",), label_col: str = "label", prob_col: str = "prob") -> DataFrame:
    """Per (group, distinct score s): positives p, negatives n at s and the
    number of negatives with a lower score (``_below``) -- exact, without
    sorting a whole group in one task."""
    g = _g(group_cols)
    y = F.col(label_col) >= 0.5
    per_score = scored.groupBy(*g, F.col(prob_col).alias("s")).agg(
        F.sum(y.cast("long")).alias("p"), F.sum((~y).cast("long")).alias("n"))
    return group_rank(per_score, g, [F.col("s")], rank_col="_below", weight="n")


def _u_stats() -> list[Column]:
    """Mann-Whitney U and class sizes over the rows of ``negatives_below``."""
    return [F.sum(F.col("p") * (F.col("_below") + F.col("n") * 0.5)).alias("_u"),
            F.sum("p").alias("_n1"), F.sum("n").alias("_n0")]


def _auroc_col() -> Column:
    return F.when((F.col("_n1") > 0) & (F.col("_n0") > 0), F.col("_u") / (F.col("_n1") * F.col("_n0")))


def auroc(scored: DataFrame, group_cols=("layer",), label_col: str = "label", prob_col: str = "prob") -> DataFrame:
    """Exact ROC AUC per group (Mann-Whitney U / (n1 n0), ties count 1/2);
    null when the group has a single class."""
    g = _g(group_cols)
    u = negatives_below(scored, g, label_col, prob_col).groupBy(*g).agg(*_u_stats())
    return u.select(*g, _auroc_col().alias("auroc_score"))


# -- E10 -----------------------------------------------------------------------

def evaluate_probes(data: DataFrame, probes: DataFrame, threshold=0.5, layers: Sequence[int] | None = None,
                    vec_col: str = "activation", label_col: str = "label",
                    weights_col: str = "weights", bias_col: str = "bias",
                    extra_keys: Sequence[str] = ()) -> DataFrame:
    """Re-score stored data with stored probes and report metrics + AUROC per
    layer; layers missing on either side are skipped."""
    if layers:
        data = data.where(F.col("layer").isin(list(layers)))
    keys = ["layer", *extra_keys]
    s = score(data, probes, vec_col, weights_col, bias_col)
    # rows are scored once: counts per score give the matrix and the AUROC
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col("s") >= t
    count = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0))
    per = negatives_below(s, keys, label_col, "prob").groupBy(*keys).agg(
        count(~hit, "n").alias("TN"), count(hit, "n").alias("FP"), count(~hit, "p").alias("FN"), count(hit, "p").alias("TP"),
        *_u_stats())
    m = metrics_from_counts(per.withColumn("auroc_score", _auroc_col()).drop("_u", "_n1", "_n0"))
    return m.withColumn("threshold", t.cast("double"))


# -- E11 / E12 ------------------------------------------------------------------

def best_layer(metrics: DataFrame, selected: DataFrame | None = None, acc_col: str = "accuracy") -> DataFrame:
    """Argmax accuracy over the selected layers, first selected on ties;
    selected layers without metrics count as accuracy 0.0."""
    if selected is not None:
        m = selected.join(metrics.select("layer", acc_col), "layer", "left").fillna(0.0, [acc_col])
    else:
        m = metrics.withColumn("sel_ord", F.col("layer"))
    return m.orderBy(F.col(acc_col).desc(), F.col("sel_ord")).limit(1).select(
        F.col("layer").alias("best_layer"), F.col(acc_col).alias("best_accuracy"))


def topn_layers(metrics: DataFrame, n: int | None = None, acc_col: str = "accuracy") -> DataFrame:
    """Layers by accuracy (desc, then layer); the first n, or all."""
    w = Window.orderBy(F.col(acc_col).desc(), F.col("layer"))  # one row per layer: bounded
    r = metrics.select("layer", acc_col).withColumn("rank", F.row_number().over(w))
    return r if n is None else r.where(F.col("rank") <= int(n))


# -- E15 / E16 / E17 -------------------------------------------------------------

def backend_accuracy_compare(a: DataFrame, b: DataFrame, name_a: str, name_b: str,
                             acc_col: str = "accuracy") -> DataFrame:
    return (a.select("layer", F.col(acc_col).alias(f"acc_{name_a}"))
            .join(b.select("layer", F.col(acc_col).alias(f"acc_{name_b}")), "layer", "full_outer"))


def accuracy_map_equal(a: DataFrame, b: DataFrame, acc_col: str = "accuracy") -> DataFrame:
    """One row: are the two (layer -> accuracy) tables identical?"""
    j = (a.select("layer", F.col(acc_col).alias("_a"))
         .join(b.select("layer", F.col(acc_col).alias("_b")), "layer", "full_outer"))
    return j.agg(F.coalesce(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))), F.lit(True)).alias("equal"),
                 F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")).alias("n_diff"))


def metric_table(raw: DataFrame, metric_cols: Sequence[str], digits: int = 4) -> DataFrame:
    """String-typed metrics -> numbers (unparsable -> null), rounded."""
    return raw.select("layer", *[F.round(F.col(c).try_cast("double"), digits).alias(c) for c in metric_cols])
