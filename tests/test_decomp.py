"""PCA of all layers against numpy, by Gram matrices and by subspace iteration."""

import numpy as np
from pyspark.sql import functions as F

from pivotspark.operators import decomp as DC


def _numpy_pca(x, k):
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    v = vt[:k].T
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return v.T, s[:k] ** 2 / (s ** 2).sum()


def _layers():
    rng = np.random.default_rng(4)
    shape = np.diag([5.0, 3.0, 2.0, 1.5, 1.2, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3])
    return {layer: rng.normal(size=(n, 13)) @ shape + 10 * layer for layer, n in ((0, 300), (5, 40), (8, 15))}


def test_pca_of_all_layers_both_ways(spark):
    """Interleaved layers of unlike sizes, repeated rows, rows to leave out."""
    data = _layers()
    data[0][50:60] = data[0][0]
    rows = [(layer, [float(v) for v in r]) for layer, x in data.items() for r in x]
    np.random.default_rng(0).shuffle(rows)
    rows += [(5, None), (None, [0.0] * 13)]
    df = spark.createDataFrame(rows, "layer int, activation array<double>").repartition(5)
    for gram_dims in (2048, 4):
        got = {r.layer: r for r in DC.pca(df, 2, gram_dims=gram_dims).collect()}
        assert set(got) == set(data)
        for layer, x in data.items():
            comp, ratio = _numpy_pca(x, 2)
            assert got[layer].n == len(x) and np.allclose(got[layer].mean, x.mean(axis=0), atol=1e-9)
            assert np.allclose(got[layer].components, comp, atol=1e-6)
            assert np.allclose(got[layer].ratio, ratio, atol=1e-9)
    model = DC.pca(df, 2)
    scores = DC.project(df.where("activation IS NOT NULL"), model).where("layer = 8").agg(
        F.avg("pc1"), F.var_samp("pc1"), F.covar_samp("pc1", "pc2")).first()
    c = data[8] - data[8].mean(axis=0)
    assert np.allclose(scores, [0, np.linalg.svd(c)[1][0] ** 2 / 14, 0], atol=1e-8)


def test_pca_of_nothing_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "layer int, activation array<float>")
    assert DC.pca(empty).count() == 0 and DC.pca_column_order(empty, "activation") == []
    same = spark.createDataFrame([(1, [2.0, 3.0, 4.0])] * 6, "layer int, activation array<float>")
    for gram_dims in (2048, 1):
        r = DC.pca(same, 2, gram_dims=gram_dims).first()
        assert r.n == 6 and list(r.ratio) == [0.0, 0.0] and np.allclose(r.mean, [2, 3, 4])


def test_column_order_is_the_transposed_matrix_pca(spark):
    x = _layers()[0]
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "steering_vector array<double>").repartition(3)
    t = x.T - x.T.mean(axis=0)
    u = np.linalg.svd(t)[0][:, 0]
    u = u * np.sign(u[np.argmax(np.abs(u))])
    assert DC.pca_column_order(df) == [int(i) for i in np.argsort(-u, kind="stable")]
