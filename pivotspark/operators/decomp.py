"""Decomposition and visualisation tables.

The plotted data are produced as tables; rendering is out of scope.  PCA of
all layers is one job: each task sums the Gram matrices of its rows, layer
after layer, the sums are added by matrix row, and each layer's eigen step
(d x d, d = hidden size) is a task.  Beyond ``GRAM_DIMS`` dims the matrix is
never built: block subspace iteration moves d x (k + EXTRA) values a pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.keys import uniform01
from .ranking import exact_quantiles, global_rank, group_rank


def thin_dims(v, max_dims: int) -> Column:
    """Every step-th element (step = max(1, d // max_dims)), the first
    ``max_dims`` of them."""
    c = F.col(v) if isinstance(v, str) else v
    d = F.size(c)
    step = F.greatest(F.lit(1), F.floor(d / max_dims).cast("int"))
    n = F.least(F.lit(max_dims), F.ceil(d / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(c, i * step + 1))


def stride_sample(df: DataFrame, order_cols, max_rows: int, vec_col: str | None = None,
                  max_dims: int | None = None, group_cols=()) -> DataFrame:
    """Rank the rows of each group, keep every step-th (step = max(1, n //
    max_rows)), the first ``max_rows``; optionally thin the vector's dims."""
    g = list(group_cols)
    if g:
        r = group_rank(df, g, order_cols, rank_col="_r").join(
            df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), g)
    else:
        r = global_rank(df, order_cols, rank_col="_r").withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_rows))
    r = r.where((F.col("_r") % step == 0) & (F.floor(F.col("_r") / step) < max_rows)) \
        .withColumn("row_index", F.floor(F.col("_r") / step).cast("long")).drop("_r", "_n")
    if vec_col and max_dims:
        r = r.withColumn(vec_col, thin_dims(vec_col, max_dims))
    return r


def by_label_then_id() -> list[Column]:
    """Label descending, then id."""
    return [F.col("label").desc(), F.col("query_id")]


def heatmap_rows(acts: DataFrame, max_rows: int = 50, max_dims: int = 8) -> DataFrame:
    """Per layer, rows by label desc then id (stable), thinned rows and
    dims."""
    return stride_sample(acts, by_label_then_id(), max_rows, "activation", max_dims, ["layer"])


def cluster_heatmap(corpus: DataFrame, vec_col: str = "steering_vector") -> DataFrame:
    """(row_id, cluster_id, boundary, dim, position, x): every cell, its
    dim's place in PCA column order, its value clipped to the 1st..99th
    percentile of all cells.  In (cluster, pattern, delta, id) order a
    boundary starts every cluster: the first row of each, by a grouped min."""
    firsts = corpus.groupBy("cluster_id").agg(
        F.min(F.struct("reasoning_pattern", "prob_delta", "row_id")).getField("row_id").alias("row_id"))
    rows = corpus.join(firsts.withColumn("boundary", F.lit(True)), ["cluster_id", "row_id"], "left").fillna(False, ["boundary"])
    cells = rows.select("row_id", "cluster_id", "boundary", F.posexplode(vec_col).alias("dim", "x")).withColumn(
        "x", F.col("x").cast("double"))
    q = exact_quantiles(cells, "x", (0.01, 0.99))
    place = {d: i for i, d in enumerate(pca_column_order(corpus, vec_col))}
    position = F.element_at(F.array(*[F.lit(place[d]) for d in range(len(place))]), F.col("dim") + 1)
    return cells.withColumn("position", position).withColumn("x", F.least(F.greatest(F.col("x"), q.getItem(0)), q.getItem(1)))


def random_directions(reference: DataFrame, seeds=(1, 2, 3), vec_col: str = "direction") -> DataFrame:
    """Per seed a Gaussian vector (hash-seeded Box-Muller, one value per
    dim) rescaled to the reference's norm, with its cosine to it."""
    ref = reference.select("layer", F.col(vec_col).alias("_ref"))
    ref = ref.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    idx = F.sequence(F.lit(0), F.size("_ref") - 1)
    g = F.transform(idx, lambda i: F.sqrt(-2.0 * F.log(F.lit(1.0) - uniform01(F.col("seed"), F.col("layer"), i, F.lit("a"))))
                    * F.cos(2 * np.pi * uniform01(F.col("seed"), F.col("layer"), i, F.lit("b"))))
    ref = ref.withColumn("_g", g)
    rnd = ref.withColumn("vector", vec.scale("_g", vec.norm("_ref") / vec.norm("_g")))
    return rnd.select("layer", "seed", "vector", vec.norm("vector").alias("norm"),
                      vec.cosine("vector", "_ref").alias("cos_to_reference"))


def _sign_fix(comp: np.ndarray) -> np.ndarray:
    """Largest |loading| of every component made positive."""
    idx = np.argmax(np.abs(comp), axis=0)
    s = np.sign(comp[idx, np.arange(comp.shape[1])])
    s[s == 0] = 1
    return comp * s


GRAM_DIMS = 2048         # 32 MB of doubles
EXTRA = 8                # columns of the block beyond the wanted ones
BLOCK_VALUES = 1 << 20   # values of one matrix product


def _gram_sums(rows: DataFrame, means: dict | None, basis: dict | None = None) -> DataFrame:
    """(layer, i, row): per layer the sum of x x^T over the rows (layer int, x
    array<double>), less the layer's mean or, without ``means``, less the
    row's own; times the layer's ``basis`` (d x b), if given."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def out(layer, m):
        d, b = m.shape
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(d, layer, np.int32)), pa.array(np.arange(d, dtype=np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * b), pa.array(m.ravel()))],
            names=["layer", "i", "row"])

    def run(it):
        now, m = None, None
        for batch in it:
            layers = batch.column("layer").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(layers[1:] != layers[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(layers)]):
                if a == b:
                    continue
                if now != int(layers[a]):
                    if m is not None:
                        yield out(now, m)
                    now, m = int(layers[a]), None
                step = max(1, BLOCK_VALUES // max(1, len(batch.column("x")[int(a)])))
                for lo in range(a, b, step):
                    n = min(step, b - lo)
                    x = batch.column("x").slice(lo, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    x = x - (x.mean(axis=1, keepdims=True) if means is None else means[now])
                    part = x.T @ (x if basis is None else x @ basis[now])
                    m = part if m is None else m + part
        if m is not None:
            yield out(now, m)

    parts = rows.sortWithinPartitions("layer").mapInArrow(run, "layer int, i int, row array<double>")
    return parts.groupBy("layer", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))


def _eigen(grams: DataFrame, k: int) -> dict:
    """{layer: (values, vectors d x k)}, largest first, one task a layer."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, u = np.linalg.eigh(np.stack(pdf.sort_values("i")["row"].to_numpy()))
        return pd.DataFrame([[int(pdf["layer"].iloc[0]), w[::-1][:k], u[:, ::-1][:, :k].T.ravel()]], columns=["layer", "w", "u"])

    got = grams.groupBy("layer").applyInPandas(run, "layer int, w array<double>, u array<double>").collect()
    return {r["layer"]: (np.array(r["w"]), np.array(r["u"]).reshape(len(r["w"]), -1).T) for r in got}


def _subspace(rows: DataFrame, means: dict, k: int, tol: float, passes: int) -> dict:
    """As ``_eigen`` by block subspace iteration with a Rayleigh-Ritz step: one
    pass over the rows for all layers, till every wanted pair's residual is
    below ``tol`` of the layer's largest value."""
    rng = np.random.default_rng(0)
    basis = {layer: np.linalg.qr(rng.normal(size=(len(m), min(len(m), k + EXTRA))))[0] for layer, m in means.items()}
    out: dict = {}
    for _ in range(passes):
        if not basis:
            break
        z: dict = {}
        for r in _gram_sums(rows.where(F.col("layer").isin(list(basis))), means, basis).orderBy("layer", "i").collect():
            z.setdefault(r["layer"], []).append(r["row"])
        for layer, got in z.items():
            y, q = np.array(got), basis[layer]
            w, u = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            w, u = w[::-1], u[:, ::-1]
            gap = np.linalg.norm(y @ u[:, :k] - q @ u[:, :k] * w[:k], axis=0)
            out[layer] = (w[:k], (q @ u)[:, :k])
            if gap.max() <= tol * max(w[0], 1e-300):
                del basis[layer]
            else:
                basis[layer] = np.linalg.qr(y @ u)[0]
    return out


def pca(df: DataFrame, k: int = 2, vec_col: str = "activation", gram_dims: int = GRAM_DIMS, tol: float = 1e-10,
        passes: int = 1000) -> DataFrame:
    """D26 for all layers: (layer, n, mean, components array of k vectors,
    ratio array of k explained shares).  Rows are centred on the layer's mean;
    each component's largest loading is positive.  Rows without layer or
    vector are left out; a layer without variance has shares 0."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    rows = df.select(F.col("layer").cast("int").alias("layer"), vec.to_double(vec_col).alias("x")).dropna()
    st = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n"),
                                   Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s"))
    stats = {r["layer"]: (r["n"], np.array(r["mean"]), (r["n"] - 1) * float(np.sum(r["var"]))) for r in st.select(
        "layer", "n", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var")).collect()}
    means = {layer: m for layer, (_, m, _) in stats.items()}
    wide = [layer for layer, m in means.items() if len(m) > gram_dims]
    small = [layer for layer in means if layer not in wide]
    pairs = _eigen(_gram_sums(rows.where(F.col("layer").isin(small)), means), k) if small else {}
    if wide:
        pairs |= _subspace(rows.where(F.col("layer").isin(wide)), {layer: means[layer] for layer in wide}, k, tol, passes)
    out = []
    for layer, (w, u) in sorted(pairs.items()):
        n, mean, total = stats[layer]
        ratio = np.maximum(w, 0.0) / total if total > 0 else np.zeros(len(w))
        out.append((layer, n, mean.tolist(), _sign_fix(u).T.tolist(), ratio.tolist()))
    return df.sparkSession.createDataFrame(out, "layer int, n long, mean array<double>, components array<array<double>>, "
                                                "ratio array<double>")


def project(df: DataFrame, model: DataFrame, k: int = 2, vec_col: str = "activation") -> DataFrame:
    """Rows with their scores pc1 .. pck; the model has one row a layer."""
    out = df.join(F.broadcast(model.select("layer", F.col("mean").alias("_mean"), F.col("components").alias("_comp"))), "layer")
    out = out.withColumn("_centred", vec.sub(vec_col, "_mean"))
    for j in range(k):
        out = out.withColumn(f"pc{j + 1}", vec.dot("_centred", F.col("_comp")[j]))
    return out.drop("_mean", "_comp", "_centred")


def pca_column_order(df: DataFrame, vec_col: str = "steering_vector") -> list[int]:
    """Dims ordered by their score on the first principal component of
    the transposed matrix (samples row-centred): the top eigenvector of the
    row-centred rows' Gram matrix.  Rows without a vector are left out."""
    rows = df.select(F.lit(0).alias("layer"), vec.to_double(vec_col).alias("x")).dropna()
    for w, u in _eigen(_gram_sums(rows, None), 1).values():
        top = _sign_fix(u)[:, 0] * np.sqrt(max(w[0], 0.0))
        return [int(i) for i in np.argsort(-top, kind="stable")]
    return []
