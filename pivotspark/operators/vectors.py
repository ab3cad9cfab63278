"""Vector operators.

Cross-row reductions (centroids, weighted sums, top-k sums) are written as
``posexplode`` + ``groupBy(group, dim)`` aggregates: Spark combines them
map-side, so what is shuffled is (partitions x groups x dims) partial sums,
never the rows.  Results come in long form (group..., dim, value) and are
re-assembled into arrays only when a caller needs the vector as a value;
the array then has one element per dimension, so its size is bounded by the
hidden size and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .sampling import topk_per_group


def _g(group_cols) -> list[str]:
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


# -- long form <-> arrays ----------------------------------------------------

def explode_dims(df: DataFrame, vec_col: str, keep: Sequence[str], dim_col: str = "dim",
                 value_col: str = "x") -> DataFrame:
    """One row per (row, dim); ``dim`` is 0-based."""
    return df.select(*keep, F.posexplode(vec_col).alias(dim_col, value_col)).withColumn(
        value_col, F.col(value_col).cast("double"))


def assemble(long_df: DataFrame, group_cols, value_col: str = "value", dim_col: str = "dim",
             out_col: str = "vector") -> DataFrame:
    """(group..., dim, value) -> (group..., vector) ordered by dim."""
    g = _g(group_cols)
    return long_df.groupBy(*g).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(dim_col).alias("d"),
                                                         F.col(value_col).alias("v")))),
                    lambda s: s["v"]).alias(out_col))


# -- D1 ------------------------------------------------------------------------

def layer_matrix(acts: DataFrame, layer_col: str = "layer", bucket_col: str = "bucket") -> DataFrame:
    """(layer, y, activation) for every layer whose two buckets are both
    non-empty: pivotal -> 1.0, non_pivotal -> 0.0."""
    y = F.when(F.col(bucket_col) == "pivotal", 1.0).otherwise(0.0)
    both = (acts.groupBy(layer_col).agg(F.countDistinct(bucket_col).alias("_nb"))
            .where(F.col("_nb") == 2).select(layer_col))
    return acts.join(both, layer_col, "left_semi").withColumn("y", y)


# -- D2 / D3 -----------------------------------------------------------------

def centroid_long(df: DataFrame, group_cols, vec_col: str) -> DataFrame:
    """Element-wise mean per group in long form (group..., dim, value)."""
    g = _g(group_cols)
    ex = explode_dims(df, vec_col, g)
    return ex.groupBy(*g, "dim").agg(F.avg("x").alias("value"))


def centroid_arrays(df: DataFrame, group_cols, vec_col: str, out_col: str = "centroid") -> DataFrame:
    return assemble(centroid_long(df, group_cols, vec_col), group_cols, out_col=out_col)


def centroid_diff_long(df: DataFrame, group_cols=("layer",), label_col: str = "label",
                       vec_col: str = "activation", pos_threshold: float = 0.5) -> DataFrame:
    """mu_pos - mu_neg per group and dim in ONE aggregation (conditional
    means); positives are label >= 0.5.  Groups missing a class get null."""
    g = _g(group_cols)
    ex = df.select(*g, (F.col(label_col) >= pos_threshold).alias("_pos"),
                   F.posexplode(vec_col).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    agg = ex.groupBy(*g, "dim").agg(
        F.avg(F.when(F.col("_pos"), F.col("x"))).alias("mean_pos"),
        F.avg(F.when(~F.col("_pos"), F.col("x"))).alias("mean_neg"))
    return agg.withColumn("value", F.col("mean_pos") - F.col("mean_neg"))


def class_counts(df: DataFrame, group_cols=("layer",), label_col: str = "label",
                 pos_threshold: float = 0.5) -> DataFrame:
    g = _g(group_cols)
    pos = F.col(label_col) >= pos_threshold
    return df.groupBy(*g).agg(F.sum(pos.cast("long")).alias("n_pos"),
                              F.sum((~pos).cast("long")).alias("n_neg"))


def centroid_diff(df: DataFrame, group_cols=("layer",), label_col: str = "label",
                  vec_col: str = "activation", out_col: str = "direction") -> DataFrame:
    """(group..., direction, n_pos, n_neg); direction null when a class is empty."""
    g = _g(group_cols)
    vecs = assemble(centroid_diff_long(df, g, label_col, vec_col), g, out_col=out_col)
    out = vecs.join(class_counts(df, g, label_col), g)
    return out.withColumn(out_col, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col(out_col)))


# -- D4 ------------------------------------------------------------------------

def probe_weight_direction(probes: DataFrame, weights_col: str = "coef_raw") -> DataFrame:
    """Flattened probe weights as a direction."""
    return probes.select("layer", F.col(weights_col).alias("direction"))


# -- D5 / D6 -----------------------------------------------------------------

def weighted_mean_long(df: DataFrame, group_cols, vec_col: str, weight_col: str,
                       absolute: bool = False) -> DataFrame:
    """sum(w * v) / max(1e-8, sum(|w|)) per group and dim; ``absolute`` uses
    |w| as the weight."""
    g = _g(group_cols)
    w = F.abs(F.col(weight_col)) if absolute else F.col(weight_col)
    ex = df.select(*g, w.cast("double").alias("_w"), F.posexplode(vec_col).alias("dim", "x"))
    num = ex.groupBy(*g, "dim").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("_num"))
    den = df.groupBy(*g).agg(F.sum(F.abs(F.col(weight_col))).alias("_den"))
    return (num.join(den, g).select(*g, "dim", (F.col("_num") / F.greatest(F.lit(1e-8), F.col("_den")))
                                    .alias("value")))


# -- D7 ------------------------------------------------------------------------

def topk_vector_sum_long(df: DataFrame, group_cols, vec_col: str, key_col: str, id_col: str,
                         k: int) -> DataFrame:
    """Sum of the k rows with the largest ``key_col`` per group (ties by id)."""
    g = _g(group_cols)
    top = topk_per_group(df, g, [F.col(key_col).desc(), F.col(id_col)], k, rank_col="_rk")
    ex = explode_dims(top, vec_col, g)
    return ex.groupBy(*g, "dim").agg(F.sum("x").alias("value"))


# -- D8 ------------------------------------------------------------------------

def group_representative(df: DataFrame, group_col: str, vec_col: str, id_col: str) -> DataFrame:
    """Vector of the first row (smallest id) per group; min_by is a
    map-side-combinable aggregate, so a hot group costs no single task."""
    return df.groupBy(group_col).agg(F.min_by(F.col(vec_col), F.col(id_col)).alias("vector"))


# -- D9 / D10 / D11 ------------------------------------------------------------

def match_norm(v, ref_norm) -> Column:
    """Rescale ``v`` to ``ref_norm`` when its own norm exceeds 1e-8."""
    n = vec.norm(v)
    ref = ref_norm if isinstance(ref_norm, Column) else F.lit(float(ref_norm))
    return F.when(n > F.lit(1e-8), vec.scale(v, ref / n)).otherwise(vec.to_double(v))


def l2_norm_unit(df: DataFrame, vec_col: str) -> DataFrame:
    return (df.withColumn("norm", vec.norm(vec_col))
            .withColumn("unit", vec.unit_export(vec_col)))


def cosine_vs_reference(cands: DataFrame, ref_vector: Column, vec_col: str = "vector") -> DataFrame:
    """Cosine of each candidate with one reference vector (a scalar
    subquery column, evaluated once and shipped as a literal)."""
    # bind the reference to a column first: subqueries may not sit inside
    # higher-order functions
    with_ref = cands.withColumn("_ref", ref_vector)
    c = vec.cosine(vec_col, "_ref")
    return with_ref.withColumn("cosine", c).withColumn("same_sign", F.col("cosine") > 0).drop("_ref")


# -- D14 -----------------------------------------------------------------------

def separability(df: DataFrame, group_cols=("layer",), label_col: str = "label",
                 vec_col: str = "activation") -> DataFrame:
    """Mean pairwise cosine inside each class, across classes, and the gap,
    in closed form (linear in rows, no pairs are built):

        sum_{i<j} u_i.u_j = (|sum u|^2 - sum |u|^2) / 2,   inter = S_pos . S_neg

    with u = v / |v| (zero rows stay zero).  Means are 0.0 without pairs."""
    g = _g(group_cols)
    n = vec.norm(vec_col)
    unit = vec.scale(vec_col, F.lit(1.0) / F.when(n == 0, F.lit(1.0)).otherwise(n))
    pos = F.col(label_col) >= 0.5
    u = df.select(*g, pos.alias("_pos"), unit.alias("_u"))
    u = u.withColumn("_q", vec.sq_norm("_u"))
    per_class = u.groupBy(*g, "_pos").agg(F.count(F.lit(1)).alias("_n"), F.sum("_q").alias("_q"))
    sums = explode_dims(u, "_u", g + ["_pos"]).groupBy(*g, "_pos", "dim").agg(F.sum("x").alias("_s"))
    # per group: |S_pos|^2, |S_neg|^2 and S_pos.S_neg from the dim-level sums
    dims = sums.groupBy(*g, "dim").agg(
        F.sum(F.when(F.col("_pos"), F.col("_s"))).alias("_sp"),
        F.sum(F.when(~F.col("_pos"), F.col("_s"))).alias("_sn"))
    dots = dims.groupBy(*g).agg(
        F.sum(F.coalesce(F.col("_sp"), F.lit(0.0)) ** 2).alias("_ss_pos"),
        F.sum(F.coalesce(F.col("_sn"), F.lit(0.0)) ** 2).alias("_ss_neg"),
        F.sum(F.coalesce(F.col("_sp"), F.lit(0.0)) * F.coalesce(F.col("_sn"), F.lit(0.0))).alias("_x"))
    cls = per_class.groupBy(*g).agg(
        F.coalesce(F.sum(F.when(F.col("_pos"), F.col("_n"))), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.when(~F.col("_pos"), F.col("_n"))), F.lit(0)).alias("n_neg"),
        F.coalesce(F.sum(F.when(F.col("_pos"), F.col("_q"))), F.lit(0.0)).alias("_q_pos"),
        F.coalesce(F.sum(F.when(~F.col("_pos"), F.col("_q"))), F.lit(0.0)).alias("_q_neg"))
    t = dots.join(cls, g)
    pp = F.col("n_pos") * (F.col("n_pos") - 1) / 2
    pn = F.col("n_neg") * (F.col("n_neg") - 1) / 2
    sp = (F.col("_ss_pos") - F.col("_q_pos")) / 2
    sn = (F.col("_ss_neg") - F.col("_q_neg")) / 2
    ni = F.col("n_pos") * F.col("n_neg")
    t = t.select(
        *g, "n_pos", "n_neg",
        F.when(pp > 0, sp / pp).otherwise(0.0).alias("mean_intra_pivotal"),
        F.when(pn > 0, sn / pn).otherwise(0.0).alias("mean_intra_nonpivotal"),
        F.when(pp + pn > 0, (sp + sn) / (pp + pn)).otherwise(0.0).alias("mean_intra_overall"),
        F.when(ni > 0, F.col("_x") / ni).otherwise(0.0).alias("mean_inter"))
    return t.withColumn("separability_gap", F.col("mean_intra_overall") - F.col("mean_inter"))


# -- D15 -----------------------------------------------------------------------

def topk_dims(long_df: DataFrame, group_cols, k: int, value_col: str = "value") -> DataFrame:
    """Top-k dims by |value| per group, with sign; ties by dim."""
    g = _g(group_cols)
    out = topk_per_group(long_df, g, [F.abs(F.col(value_col)).desc(), F.col("dim")], k, rank_col="rank")
    return out.withColumn("sign", F.signum(F.col(value_col)).cast("int"))


# -- D19 - D23 steering transforms ---------------------------------------------

STEER_MODES = ("additive_raw", "additive_normalized", "projection")


def steer(h, v, coef, mode: str = "additive_raw") -> Column:
    """One steering transform of hidden vector ``h`` by direction ``v``:

    additive_raw:        h + c v
    additive_normalized: h + c |h| v / (|v| + 1e-8)
    projection:          h + (c - 1) (h . v_hat) v_hat,  v_hat = v / (|v| + 1e-8)
    """
    if mode not in STEER_MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {STEER_MODES}")
    c = coef if isinstance(coef, Column) else F.lit(float(coef))
    if mode == "additive_raw":
        return vec.axpy(h, v, c)
    vhat = vec.unit(v, vec.EPS_DIRECTION)
    if mode == "additive_normalized":
        return vec.axpy(h, vhat, c * vec.norm(h))
    return vec.axpy(h, vhat, (c - F.lit(1.0)) * vec.dot(h, vhat))


def steer_masked(h, v, coef, mask, mode: str = "additive_raw") -> Column:
    """Apply ``steer`` only where ``mask`` is true."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.when(m, steer(h, v, coef, mode)).otherwise(vec.to_double(h))


def steer_table(df: DataFrame, vec_col: str, direction: Column, coef, mode: str,
                out_col: str = "steered") -> DataFrame:
    return df.withColumn(out_col, steer(vec_col, direction, coef, mode))


def steer_multi(states: DataFrame, injections: DataFrame, vec_col: str = "activation",
                layer_col: str = "layer", mode: str = "additive_raw") -> DataFrame:
    """Apply several injections (layer, inj_ord, direction, coef) to the
    states of their layer, one after another in ``inj_ord`` order (each sees
    the output of the previous one, as chained hooks do).  Injections are a
    handful per layer (a spec, not data), so they are gathered per layer and
    folded over the vector with ``aggregate``."""
    per_layer = injections.groupBy(layer_col).agg(
        F.array_sort(F.collect_list(F.struct("inj_ord", F.col("coef").cast("double").alias("coef"),
                                             vec.to_double("direction").alias("direction")))).alias("_inj"))
    j = states.join(F.broadcast(per_layer), layer_col, "left")
    empty = F.array().cast(per_layer.schema["_inj"].dataType)
    folded = F.aggregate(F.coalesce(F.col("_inj"), empty), vec.to_double(vec_col),
                         lambda acc, s: steer(acc, s["direction"], s["coef"], mode))
    return j.withColumn("steered", folded).drop("_inj")


# -- D24 / D25 -----------------------------------------------------------------

def layer_range_spec(probes: DataFrame, vectors: DataFrame, offsets=(2, 4, 6),
                     layer_col: str = "layer") -> DataFrame:
    """For each probe layer p and offset, the layers in [p - off, p] that have
    a vector; kept when there are >= 2 of them and the start is >= 1.  A
    range join on a small layer table."""
    p = probes.select(F.col(layer_col).alias("probe_layer")).distinct().withColumn(
        "offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
    v = vectors.select(F.col(layer_col).alias("vlayer")).distinct()
    j = p.join(F.broadcast(v), (F.col("vlayer") >= F.col("probe_layer") - F.col("offset"))
               & (F.col("vlayer") <= F.col("probe_layer")))
    g = j.groupBy("probe_layer", "offset").agg(
        F.array_sort(F.collect_list("vlayer")).alias("layers"), F.count(F.lit(1)).alias("n_layers"),
        F.min("vlayer").alias("start_layer"))
    return g.where((F.col("n_layers") >= 2) & (F.col("probe_layer") - F.col("offset") >= 1))


def injected_energy(injections: DataFrame, group_col: str = "variant") -> DataFrame:
    """sum |c| * |v| per variant."""
    return injections.groupBy(group_col).agg(
        F.sum(F.abs(F.col("coef")) * vec.norm("direction")).alias("energy"))


# -- D28 -----------------------------------------------------------------------

def clustering_agreement(df: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """Adjusted Rand index between two label columns (closed form over the
    contingency table), noise rate of ``b`` (label -1) and cluster count."""
    cont = df.groupBy(a_col, b_col).agg(F.count(F.lit(1)).alias("nij"))
    c2 = lambda c: c * (c - 1) / 2
    sij = cont.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    ai = cont.groupBy(a_col).agg(F.sum("nij").alias("_ra")).agg(F.sum(c2(F.col("_ra"))).alias("sa"))
    bj = cont.groupBy(b_col).agg(F.sum("nij").alias("_rb")).agg(F.sum(c2(F.col("_rb"))).alias("sb"))
    stats = df.agg(F.avg((F.col(b_col) == -1).cast("double")).alias("noise_rate"),
                   F.countDistinct(F.when(F.col(b_col) != -1, F.col(b_col))).alias("n_clusters"))
    # every side is a one-row aggregate: combine them as scalar subqueries
    sa, sb = ai.scalar(), bj.scalar()
    t = sij.select("sij", "n", sa.alias("sa"), sb.alias("sb"),
                   stats.select("noise_rate").scalar().alias("noise_rate"),
                   stats.select("n_clusters").scalar().alias("n_clusters"))
    expected = F.col("sa") * F.col("sb") / c2(F.col("n"))
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx == expected, F.lit(1.0)).otherwise((F.col("sij") - expected) / (mx - expected))
    return t.select(ari.alias("ari"), "noise_rate", F.col("n_clusters").cast("long"), F.col("n").cast("long"))


# -- D29 -----------------------------------------------------------------------

def token_logprob(logits, token_id) -> Column:
    return vec.log_softmax_at(logits, token_id)
