"""Invariants of the iterative (rows-only) operators: training, bootstrap."""

import numpy as np
from pyspark.sql import functions as F

from pivotspark.operators import nie as N
from pivotspark.operators import training as TR
from pivotspark.sources import fixtures as X

from .conftest import SF_SMALL


def test_logreg_gradient_is_zero_and_raw_equals_scaled(spark):
    a = X.activations_shifted(spark, SF_SMALL).where((F.col("split") == "train") & (F.col("layer") == 0))
    p = TR.train_logreg_layers(a, C=1.0).first()
    rows = a.select("activation", "label").collect()
    x = np.array([r.activation for r in rows], dtype=np.float64)
    y = np.array([r.label for r in rows], dtype=np.float64)
    xs = (x - np.array(p.mean)) / np.array(p.std)
    w, b = np.array(p.coef_scaled), p.intercept_scaled
    prob = 1 / (1 + np.exp(-(xs @ w + b)))
    grad_w = w + 1.0 * xs.T @ (prob - y)          # 1/2|w|^2 + C * sum(loss), C = 1
    assert np.max(np.abs(grad_w)) < 1e-3 * len(y)
    raw = 1 / (1 + np.exp(-(x @ np.array(p.coef_raw) + p.bias_raw)))
    assert np.allclose(raw, prob, atol=1e-9)


def _newton(x, y, c, s=None, steps=60):
    """Scaled weights, intercept last, by plain Newton steps on all rows."""
    s = np.ones(len(y)) if s is None else s
    sd = x.std(axis=0)
    xb = np.hstack([(x - x.mean(axis=0)) / np.where(sd == 0, 1, sd), np.ones((len(x), 1))])
    pen, w = np.append(np.full(x.shape[1], 1 / c), 0.0), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(xb @ w)))
        g = xb.T @ (s * (p - y)) + pen * w
        w = w - np.linalg.solve((xb * (s * p * (1 - p))[:, None]).T @ xb + np.diag(pen), g)
    return w


def _scaled(row):
    return np.append(row.coef_scaled, row.intercept_scaled)


def test_all_layers_and_c_in_one_solver(spark):
    """Two layers of unlike sizes, a layer of one class, a constant dim, nulls,
    repeated rows; small Arrow batches."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for layer, n in ((3, 900), (7, 60)):
        x = np.hstack([rng.normal(size=(n, 4)).round(2), np.full((n, 1), 2.5)])
        y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0).astype(float)
        x[30:50], y[30:50] = x[0], y[0]
        rows += [(layer, [float(v) for v in r], int(k)) for r, k in zip(x, y)]
        want[layer] = (x, y)
    rows += [(9, [0.0] * 5, 1)] * 4 + [(3, None, 1), (3, [9.0] * 5, None), (None, [9.0] * 5, 1)]
    df = spark.createDataFrame(rows, "layer int, activation array<double>, label int")
    key, got = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for parts, size in ((1, "10000"), (7, "37")):
            spark.conf.set(key, size)
            got.append({(r.layer, r.c): _scaled(r) for r in TR.c_sweep(df.repartition(parts), (0.01, 1.0)).collect()})
    finally:
        spark.conf.set(key, before)
    assert set(got[0]) == set(got[1]) == {(layer, c) for layer in (3, 7) for c in (0.01, 1.0)}
    for (layer, c), w in got[0].items():
        assert np.allclose(w, got[1][layer, c], atol=1e-9)
        assert np.allclose(w, _newton(*want[layer], c), atol=1e-7)
    balanced = TR.train_logreg_layers(df, layers=[3], class_weight="balanced").collect()
    x, y = want[3]
    s = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    assert [r.layer for r in balanced] == [3] and np.allclose(_scaled(balanced[0]), _newton(x, y, 1.0, s), atol=1e-7)
    assert TR.train_logreg_layers(df.where("layer = 9")).count() == 0
    assert TR.train_logreg_layers(df.where("false")).count() == 0


def test_newton_on_separable_rows_with_a_weak_penalty(spark):
    """Full steps overshoot here: they are halved until the loss falls."""
    x = np.concatenate([np.linspace(-3, -0.01, 40), np.linspace(0.01, 50, 40)])
    y = (x > 0).astype(int)
    df = spark.createDataFrame([(0, [float(a), float(a) ** 2], int(k)) for a, k in zip(x, y)],
                               "layer int, activation array<double>, label int")
    for c in (1.0, 1e4):
        r = TR.train_logreg_layers(df, C=c).first()
        xs = (np.stack([x, x ** 2], axis=1) - r.mean) / np.array(r.std)
        p = 1 / (1 + np.exp(-(xs @ np.array(r.coef_scaled) + r.intercept_scaled)))
        g = np.append(np.array(r.coef_scaled) / c + xs.T @ (p - y), (p - y).sum())
        assert np.abs(g).max() < 1e-6 * len(y)


def test_adam_loss_decreases(spark):
    a = X.activations_shifted(spark, SF_SMALL).where(F.col("split") == "train")
    _, losses = TR.train_adam_layers(a, epochs=4)
    for layer in range(4):
        ls = [r.loss for r in losses.where(F.col("layer") == layer).orderBy("epoch").collect()]
        assert ls[-1] < ls[0]


def _toy(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(3)
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return x, y, spark.createDataFrame([(0, [float(v) for v in r], int(k)) for r, k in zip(x, y)],
                                       "layer int, activation array<double>, label int")


def _weights(probes):
    r = probes.first()
    return np.append(r.weights, r.bias)


def test_adam_does_not_depend_on_arrow_batches(spark):
    _, _, df = _toy(spark, 1500)
    key, got = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for size in ("100", "10000"):
            spark.conf.set(key, size)
            got.append(_weights(TR.train_adam_layers(df.repartition(int(size) % 7 + 1), epochs=3, shard_rows=400)[0]))
    finally:
        spark.conf.set(key, before)
    assert np.allclose(got[0], got[1], atol=1e-12) and np.abs(got[0]).max() > 0.01


def test_one_shard_is_sequential_adam(spark):
    x, y, df = _toy(spark, 300)
    probes, losses = TR.train_adam_layers(df, epochs=3, lr=0.01, batch=32)
    w, m, v, t, means = np.zeros(6), np.zeros(6), np.zeros(6), 0, []
    xb = np.hstack([x, np.ones((len(x), 1))])
    for ep in range(3):
        order = [r[0] for r in df.select(F.xxhash64(F.lit(42), F.lit(ep), "activation", F.col("label").cast("double"))).collect()]
        order, loss = np.argsort(np.array(order), kind="stable"), []
        for s in range(0, len(y), 32):
            own = order[s:s + 32]
            z = xb[own] @ w
            loss.append(np.mean(np.logaddexp(0, z) - z * y[own]))
            g = xb[own].T @ (1 / (1 + np.exp(-z)) - y[own]) / len(own)
            t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        means.append(np.mean(loss))
    assert np.allclose(_weights(probes), w, atol=1e-9)
    assert np.allclose([r.loss for r in losses.orderBy("epoch").collect()], means, atol=1e-9)


def test_bootstrap_weights_are_poisson():
    keys = np.random.default_rng(3).integers(0, N.PRIME, 4000)
    w = N.poisson_weights(keys, N.replicate_terms(300, 42))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    # sums over rows vary as those of independent weights
    assert 0.75 < w.sum(axis=0).var() / len(keys) < 1.25
    # the cubic in Python's own integers
    terms = N.replicate_terms(3, 42)
    a, k = [int(t) for t in terms[:, 2]], int(keys[5])
    u = (a[3] * k ** 3 + a[2] * k ** 2 + a[1] * k + a[0]) % N.PRIME
    assert N.poisson_weights(keys[5:6], terms)[0, 2] == sum(u >= t for t in N.POISSON_STEPS)


def test_bootstrap_brackets_mean(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(1.0, 2.0, size=400).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "_key long, nie double")
    r = N.bootstrap_ci(df, n_boot=500).first()
    m = float(np.mean(vals))
    assert r.ci_lo < m < r.ci_hi
    se = np.std(vals, ddof=1) / np.sqrt(len(vals))
    assert abs((r.ci_hi - r.ci_lo) - 2 * 1.96 * se) < 0.5 * (2 * 1.96 * se)


def test_stream_equals_batch(spark):
    from pivotspark.plans.q_gate import latched
    from pivotspark.sources.sinks import new_path
    from pivotspark.streaming.gate_stream import run_available_now, write_step_files
    base = new_path(spark, "test_stream")
    write_step_files(X.gate_steps(spark, SF_SMALL), f"{base}/src", slice_steps=40)
    s = run_available_now(spark, f"{base}/src", f"{base}/sink", f"{base}/ckpt", 0.5, 2, files_per_batch=3)
    b = latched(spark, SF_SMALL)
    cols = ["run", "step", "probe_fire", "held", "fired", "latch_remaining"]
    assert sorted(map(tuple, s.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    spent = {r.run: r.e for r in b.groupBy("run").agg(F.sum(F.when(F.col("fired"), F.col("delta_norm")).otherwise(0.0)).alias("e")).collect()}
    assert all(abs(r.e - spent[r.run]) < 1e-9 for r in s.groupBy("run").agg(F.max("energy").alias("e")).collect())
    # the checkpoint knows the files: another start reads none again
    again = run_available_now(spark, f"{base}/src", f"{base}/sink", f"{base}/ckpt", 0.5, 2)
    assert again.count() == s.count()
    # a step that comes late is decided, not dropped
    late = X.gate_steps(spark, SF_SMALL).where("phase = 'decode'").limit(1).select("run", "step", "prob", "phase", "delta_norm")
    late.write.mode("append").parquet(f"{base}/src/part_999")
    assert run_available_now(spark, f"{base}/src", f"{base}/sink", f"{base}/ckpt", 0.5, 2).count() == s.count() + 1


def _sequential(rows, n_hold):
    """(step, fired, latch) of one run's (step, prob) in order."""
    out, latch = [], 0
    for step, prob in sorted(rows):
        fire = prob > 0.5
        held = not fire and latch > 0
        latch = n_hold if fire else max(0, latch - 1)
        out.append((step, fire or held, latch))
    return out


def test_stream_takes_steps_out_of_order(spark, tmp_path):
    """Steps of one micro-batch lie over many files in any order, with repeated
    chunks of a run, gaps inside a batch and one long run."""
    import random

    from pivotspark.streaming import gate_stream as G
    rng = random.Random(5)
    rows = [(run, i + 1, rng.random(), "decode", 1.0) for run, n in ((1, 30000), (2, 700), (3, 1)) for i in range(n)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, G.STEP_SCHEMA).repartition(6).write.parquet(f"{tmp_path}/src")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        out = G.run_available_now(spark, f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/ck", 0.5, 3, files_per_batch=100)
        got = sorted((r.run, r.step, r.fired, r.latch_remaining) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(run, *x) for run in (1, 2, 3) for x in _sequential([(s, p) for r, s, p, *_ in rows if r == run], 3)]
    assert got == want
    ends = {r.run: (r.n, r.e) for r in out.groupBy("run").agg(F.max("n_calls").alias("n"), F.max("energy").alias("e")).collect()}
    assert ends == {run: (n, float(sum(f for r, _, f, _ in want if r == run))) for run, n in ((1, 30000), (2, 700), (3, 1))}


def test_stream_waits_for_a_missing_step_till_patience_ends(spark, tmp_path):
    import time

    from pivotspark.streaming import gate_stream as G
    rows = [(1, s, 0.6 if s == 2 else 0.1, "decode", 1.0) for s in (1, 2, 4, 5)]
    write = lambda r: spark.createDataFrame(r, G.STEP_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    write(rows)
    spark.conf.set(G.STORE, G.ROCKSDB)
    try:
        steps = spark.readStream.schema(G.STEP_SCHEMA).parquet(f"{tmp_path}/src")
        q = (G.gate_stream(steps, 0.5, 2, patience_ms=3_000).writeStream.format("memory").queryName("gate_out").outputMode("append")
             .option("checkpointLocation", f"{tmp_path}/ck").start())
        seen = lambda: sorted((r.step, r.fired) for r in spark.table("gate_out").collect())
        end = time.time() + 120
        while len(seen()) < 2 and time.time() < end:
            time.sleep(0.2)
        assert [s for s, _ in seen()][:2] == [1, 2]
        while len(seen()) < 4 and time.time() < end:
            time.sleep(0.2)
        # Step 3 never came: 4 is the first decision after the fire, 5 the second.
        assert seen() == [(1, False), (2, True), (4, True), (5, True)]
        write([(1, 3, 0.1, "decode", 1.0), (1, 6, 0.1, "decode", 1.0)])
        while len(seen()) < 6 and time.time() < end:
            time.sleep(0.2)
        assert seen() == [(1, False), (2, True), (3, False), (4, True), (5, True), (6, False)]
        q.stop()
    finally:
        spark.conf.unset(G.STORE)


def test_gate_steps_score_a_residual_once(spark):
    """What is computed from vectors is computed below the join with the steps."""
    plan = X.gate_steps(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above, found, below = plan.partition("Join")
    assert found and "lambda" not in above and "lambda" in below


def test_gate_of_short_runs_reads_and_writes_its_state_once():
    import random

    import pandas as pd

    from pivotspark.streaming import gate_stream as G

    class State:
        kept, calls = None, 0

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, kept):
            self.calls += 1
            self.kept = kept

    class Waiting:
        def __init__(self):
            self.rows = []

        def appendList(self, rows):
            self.rows += rows

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

    rng = random.Random(3)
    for shuffled in (False, True):
        gate = G.GateProcessor(0.5, 2)
        gate.gate, gate.ahead = State(), Waiting()
        rows = [(s, rng.random(), "prefill" if s % 13 == 1 else "decode", 1.0) for s in range(1, 60)]
        parts = [rows[:20], rows[20:]]
        got, spent = [], []
        for part in parts:
            if shuffled:
                rng.shuffle(part)
            chunks = [pd.DataFrame(part[i:i + 7], columns=G.AHEAD) for i in range(0, len(part), 7)]
            for out in gate.handleInputRows((4,), iter(chunks), None):
                got += list(zip(out["step"], out["fired"], out["latch_remaining"]))
                spent += list(out["energy"])
        want = _sequential([r[:2] for r in rows if r[2] == "decode"], 2)
        assert got == want
        assert spent == list(np.cumsum([float(f) for _, f, _ in want]))
        assert gate.gate.calls == 2 * len(parts) and not gate.ahead.rows


def test_latch_block_equals_loop():
    from pivotspark.streaming.gate_stream import latch_block
    rng = np.random.default_rng(8)
    for n_hold in (0, 1, 3):
        for latch in range(n_hold + 1):
            fire = rng.random(60) < 0.2
            held, left = latch_block(fire, latch, n_hold)
            now = latch
            for f, h, x in zip(fire, held, left):
                want = not f and now > 0
                now = n_hold if f else now - 1 if want else 0
                assert (h, x) == (want, now)
