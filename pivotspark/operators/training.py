"""Probe training.

* Logistic probes: per layer, standardised with the population std (E1); the
  L2 logistic regression with inverse strength C and a free intercept, by
  damped Newton steps.  All layers and all C advance together: a step is one
  pass over the rows, which sums loss, gradient and Hessian of every model
  that still moves.  Tasks hold the sums of one layer, the sums are added by
  rows of the Hessian, and each model's system is solved in a task of its own;
  only vectors of hidden size come back to the driver.
* Adam probes: one Spark job per epoch for all layers.  A layer of up to
  ``SHARD_ROWS`` rows is sequential mini-batch Adam; a larger one is cut into
  shards of that size, whose parameters and moments are averaged each epoch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.sinks import new_path

# -- E2-E4: logistic probes ------------------------------------------------------

BLOCK_VALUES = 1 << 20   # values of one matrix product


def _newton_sums(models: dict, stats: dict):
    """The function of one pass: for every run of rows of one layer and every
    model of it, d + 1 rows (layer, model, i, [loss, gradient i, Hessian row
    i]); the loss is in row 0.  ``models`` has {layer: {model: weights with
    the intercept last}}, ``stats`` {layer: (mean, std, weight of class 0, of
    class 1)}."""
    schema = pa.schema([("layer", pa.int32()), ("model", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def out(layer: int, sums: dict) -> Iterator[pa.RecordBatch]:
        for model, m in sums.items():
            d = len(m)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(d, layer, np.int32)), pa.array(np.full(d, model, np.int32)),
                pa.array(np.arange(d, dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * (d + 2)), pa.array(m.ravel()))],
                schema=schema)

    def add(sums: dict, layer: int, x: np.ndarray, y: np.ndarray) -> None:
        mean, std, w0, w1 = stats[layer]
        x = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
        s = np.where(y > 0, w1, w0)
        for model, w in models[layer].items():
            z = x @ w
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            m = sums.setdefault(model, np.zeros((len(w), len(w) + 2)))
            m[0, 0] += (s * (np.logaddexp(0.0, z) - z * y)).sum()
            m[:, 1] += x.T @ (s * (p - y))
            m[:, 2:] += x.T @ (x * (s * p * (1.0 - p))[:, None])

    def run(it):
        now, sums = None, {}
        for batch in it:
            layers, ys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("layer", "y"))
            edges = np.flatnonzero(layers[1:] != layers[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(layers)]):
                if a == b or int(layers[a]) not in models:
                    continue
                if now != int(layers[a]):
                    yield from out(now, sums)
                    now, sums = int(layers[a]), {}
                step = max(1, BLOCK_VALUES // len(stats[now][0]))
                for lo in range(a, b, step):
                    n = min(step, b - lo)
                    flat = batch.column("x").slice(lo, n).flatten().to_numpy(zero_copy_only=False)
                    add(sums, now, flat.reshape(n, -1).astype(np.float64), ys[lo:lo + n])
        yield from out(now, sums)
    return run


def _newton_step(models: dict, cs: Sequence[float]):
    """The function that solves one model: its penalised loss, largest
    gradient entry, step and the gradient along the step."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        layer, model = int(pdf["layer"].iloc[0]), int(pdf["model"].iloc[0])
        m = np.stack(pdf.sort_values("i")["row"].to_numpy())
        w, pen = models[layer][model], np.full(len(m), 1.0 / cs[model])
        pen[-1] = 0.0  # the intercept is free
        g = m[:, 1] + pen * w
        h = m[:, 2:] + np.diag(pen)
        # an intercept without curvature (every probability 0 or 1) gets a little
        h[np.diag_indices_from(h)] += 1e-14 * max(np.trace(h), 1e-300)
        step = -np.linalg.solve(h, g)
        loss = m[0, 0] + 0.5 * float(pen @ (w * w))
        return pd.DataFrame([[layer, model, loss, float(np.abs(g).max()), float(g @ step), step]],
                            columns=["layer", "model", "loss", "g_max", "slope", "step"])
    return run


def _fit(data: DataFrame, stats: dict, counts: dict, cs: Sequence[float], max_iter: int, tol: float) -> dict:
    """{(layer, model): weights}: damped Newton steps from 0.  A step that does
    not lower the loss enough is halved; a model leaves when the largest entry
    of its gradient is below ``tol`` a row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    zero = {layer: np.zeros(len(st[0]) + 1) for layer, st in stats.items()}
    w = {(layer, k): zero[layer] for layer in stats for k in range(len(cs))}
    trial, base, size = dict(w), {}, {}
    for _ in range(max_iter):
        if not trial:
            break
        models: dict = {}
        for (layer, k), v in trial.items():
            models.setdefault(layer, {})[k] = v
        parts = data.where(F.col("layer").isin(list(models))).mapInArrow(
            _newton_sums(models, stats), "layer int, model int, i int, row array<double>")
        total = parts.groupBy("layer", "model", "i").agg(
            vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
        got = total.groupBy("layer", "model").applyInPandas(
            _newton_step(models, cs), "layer int, model int, loss double, g_max double, slope double, step array<double>").collect()
        for r in got:
            key = r["layer"], r["model"]
            last = base.get(key)
            # the loss is a sum of many rows: its last digits do not count
            if last is None or r["loss"] <= last[0] + 1e-4 * size[key] * last[1] + 1e-12 * abs(last[0]):
                w[key], base[key], size[key] = trial[key], (r["loss"], r["slope"], np.array(r["step"])), 1.0
                if r["g_max"] <= tol * counts[key[0]]:
                    del trial[key]
                    continue
            else:
                size[key] /= 2
                if size[key] < 1e-9:
                    del trial[key]
                    continue
            trial[key] = w[key] + size[key] * base[key][2]
    return w


def train_logreg_layers(train: DataFrame, layers: Sequence[int] | None = None, C: float = 1.0,
                        class_weight: str | None = None, max_iter: int = 100, tol: float = 1e-10,
                        vec_col: str = "activation", label_col: str = "label",
                        cs: Sequence[float] | None = None) -> DataFrame:
    """(layer, c, n_train, coef_scaled, intercept_scaled, coef_raw, bias_raw,
    mean, std).  ``coef_raw``/``bias_raw`` act on raw vectors and give the
    same probabilities as the scaled model.  Layers with one class have no
    row; rows without layer, vector or label are left out."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = train.sparkSession
    cs = [float(c) for c in (cs or [C])]
    rows = train.select(F.col("layer").cast("int").alias("layer"), vec.to_double(vec_col).alias("x"),
                        (F.col(label_col) >= 0.5).cast("double").alias("y")).dropna()
    if layers:
        rows = rows.where(F.col("layer").isin([int(x) for x in layers]))
    # written once, read in each pass: a partition holds few layers, a large layer lies over many partitions
    path = new_path(spark, "probe-rows")
    rows.repartitionByRange("layer", F.xxhash64("x", "y")).sortWithinPartitions("layer").write.parquet(path)
    data = spark.read.schema(rows.schema).parquet(path)
    st = data.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"),
        Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s"))
    st = st.select("layer", "n", "n1", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))
    stats, counts = {}, {}
    for r in st.collect():  # one row a layer
        n, n1 = r["n"], r["n1"]
        if n1 in (0, n):
            continue
        sd = np.sqrt(np.array(r["var"]) * (n - 1) / n)  # ddof 0
        balanced = class_weight == "balanced"
        stats[r["layer"]] = (np.array(r["mean"]), np.where(sd == 0, 1.0, sd),
                             n / (2.0 * (n - n1)) if balanced else 1.0, n / (2.0 * n1) if balanced else 1.0)
        counts[r["layer"]] = n
    out = []
    for (layer, k), w in sorted(_fit(data, stats, counts, cs, max_iter, tol).items()):
        mean, sd = stats[layer][:2]
        raw = w[:-1] / sd
        out.append((layer, cs[k], counts[layer], w[:-1].tolist(), float(w[-1]), raw.tolist(),
                    float(w[-1] - raw @ mean), mean.tolist(), sd.tolist()))
    return spark.createDataFrame(out, "layer int, c double, n_train long, coef_scaled array<double>, intercept_scaled double, "
                                      "coef_raw array<double>, bias_raw double, mean array<double>, std array<double>")


def c_sweep(train: DataFrame, cs: Sequence[float] = (0.001, 0.01, 0.1, 1.0), **kw) -> DataFrame:
    """E2 for each C (one table, column ``c``), all in the same passes."""
    return train_logreg_layers(train, cs=list(cs), **kw)


# -- E5: Adam probes -------------------------------------------------------------

SHARD_ROWS = 1 << 16


def _adam_epoch(params: dict, lr: float, batch: int, schema_names: list[str]):
    """The function of one epoch over rows sorted by (layer, shard, order).
    Parameters, moments and the rows of an unfinished mini-batch are carried
    from one Arrow batch to the next; each (layer, shard) gives one row."""

    class Shard:
        def __init__(self, layer: int, shard: int):
            self.key = layer, shard
            w, mw, vw, self.t = params[layer]
            # the bias is the last entry, next to the weights
            self.w, self.mw, self.vw = (np.array(a, dtype=np.float64) for a in (w, mw, vw))
            self.n, self.loss, self.steps = 0, 0.0, 0
            self.x: list = []
            self.y: list = []

        def add(self, x: np.ndarray, y: np.ndarray) -> None:
            self.x.append(x)
            self.y.append(y)
            if sum(map(len, self.y)) >= batch:
                xs, ys = np.concatenate(self.x), np.concatenate(self.y)
                whole = len(ys) // batch * batch
                for s in range(0, whole, batch):
                    self.step(xs[s:s + batch], ys[s:s + batch])
                self.x, self.y = [xs[whole:]], [ys[whole:]]

        def step(self, x: np.ndarray, y: np.ndarray) -> None:
            z = x @ self.w[:-1] + self.w[-1]
            d = (1.0 / (1.0 + np.exp(-z)) - y) / len(y)
            self.loss += float(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))))
            g = np.append(d @ x, d.sum())
            self.t, self.steps, self.n = self.t + 1, self.steps + 1, self.n + len(y)
            self.mw = 0.9 * self.mw + 0.1 * g
            self.vw = 0.999 * self.vw + 0.001 * g * g
            self.w = self.w - lr * (self.mw / (1 - 0.9 ** self.t)) / (np.sqrt(self.vw / (1 - 0.999 ** self.t)) + 1e-8)

        def row(self) -> pd.DataFrame:
            if self.y and len(rest := np.concatenate(self.y)):
                self.step(np.concatenate(self.x), rest)
            return pd.DataFrame([[*self.key, self.n, self.t, self.loss, self.steps, self.w, self.mw, self.vw]],
                                columns=schema_names)

    def run(it):
        now = None
        for pdf in it:
            keys = pdf[["layer", "shard"]].to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)]):
                if a == b:
                    continue
                key = int(keys[a, 0]), int(keys[a, 1])
                if now is None or now.key != key:
                    if now is not None:
                        yield now.row()
                    now = Shard(*key)
                now.add(np.stack(pdf["x"].iloc[a:b].to_numpy()).astype(np.float64), pdf["y"].iloc[a:b].to_numpy())
        if now is not None:
            yield now.row()
    return run


def train_adam_layers(train: DataFrame, epochs: int = 10, lr: float = 1e-3, batch: int = 32,
                      shard_rows: int = SHARD_ROWS, seed: int = 42, vec_col: str = "activation",
                      label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """Returns (probes(layer, weights, bias), epoch_losses(layer, epoch, loss)).

    A layer of up to ``shard_rows`` rows is one shard: mini-batch Adam in a
    hash order of its rows, a new one each epoch, with one optimizer over all
    epochs.  A larger layer is cut into shards of about that many rows; after
    each epoch the shards' parameters and moments are averaged by rows.  The
    result does not depend on partitions or Arrow batches."""
    spark = train.sparkSession
    rows = train.select(F.col("layer").cast("int").alias("layer"), F.col(vec_col).alias("x"),
                        (F.col(label_col) >= 0.5).cast("double").alias("y"))
    sizes = {r["layer"]: (r["n"], r["d"]) for r in rows.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).collect()}
    if not sizes:
        return (spark.createDataFrame([], "layer int, weights array<double>, bias double"),
                spark.createDataFrame([], "layer int, epoch int, loss double"))
    shards = F.coalesce(*[F.when(F.col("layer") == k, F.lit(-(-n // shard_rows))) for k, (n, _) in sizes.items()])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "x", "y"), shards).cast("int"))
    path = new_path(spark, "adam")
    rows.write.parquet(path)
    data = spark.read.schema(rows.schema).parquet(path)
    params = {k: (np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0) for k, (_, d) in sizes.items()}
    names = ["layer", "shard", "n", "t", "loss", "steps", "w", "mw", "vw"]
    schema = "layer int, shard int, n long, t long, loss double, steps long, w array<double>, mw array<double>, vw array<double>"
    loss_rows = []
    for ep in range(epochs):
        # equal rows are interchangeable, so ties of the order do not matter
        order = F.xxhash64(F.lit(seed), F.lit(ep), "x", "y")
        dealt = data.repartition("layer", "shard").sortWithinPartitions("layer", "shard", order, "x", "y")
        parts = dealt.mapInPandas(_adam_epoch(params, lr, batch, names), schema)
        # averaged by dimension in Spark; hidden size + 1 rows a layer come back
        long = parts.select("layer", "n", "t", "loss", "steps", F.posexplode(F.arrays_zip("w", "mw", "vw")).alias("dim", "z"))
        mean = lambda c: (F.sum(F.col(f"z.{c}") * F.col("n")) / F.sum("n")).alias(c)
        got = long.groupBy("layer", "dim").agg(
            mean("w"), mean("mw"), mean("vw"), F.max("t").alias("t"),
            (F.sum("loss") / F.sum("steps")).alias("loss")).orderBy("layer", "dim").toPandas()
        for layer, g in got.groupby("layer"):
            params[int(layer)] = (g["w"].to_numpy(), g["mw"].to_numpy(), g["vw"].to_numpy(), int(g["t"].iloc[0]))
            loss_rows.append((int(layer), ep + 1, float(g["loss"].iloc[0])))
    probes = spark.createDataFrame([(k, v[0][:-1].tolist(), float(v[0][-1])) for k, v in params.items()],
                                   "layer int, weights array<double>, bias double")
    losses = spark.createDataFrame(loss_rows, "layer int, epoch int, loss double")
    return probes, losses
