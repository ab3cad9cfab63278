"""Registered queries for per-token NIE, the gate arm
comparison (H11) and NIE by sign (I9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import gating as G
from ..operators import nie as N
from ..operators import runs as R
from ..operators import vectors as V
from ..sources import fixtures as X
from ..sources.sinks import new_path
from ..sources.tables import load
from .q_gate import _latch_local, _uniform_sql, decided, latched, stored_steps
from .q_labels import _probe_local, probe_rows
from .q_runs import _RUN_LOCAL, BASE, scored
from .q_vectors import _d, _n
from .registry import query, tidy, with_ctes

MODES = ("additive_raw", "additive_normalized", "projection")
COEFS = (0.5, 2.0)


def _cell_id(v, mode, c):
    return f"{v}__{mode}__c{c}"


def label_vectors(spark, sf):
    """(vector, v): the label-0 and label-1 centroids of the embeddings."""
    e = load(spark, sf, "embeddings").select("label", "embedding")
    e = e.where(F.col("label") <= 1).withColumn("vector", F.concat(F.lit("v"), F.col("label").cast("string")))
    return V.centroid_arrays(e, ["vector"], "embedding", out_col="v")


def logits_rows(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.lit(0).alias("position"),
                    F.col("label").alias("pivot_token_id"), F.col("embedding").alias("logits"))


def grid_samples(spark, sf, vectors=("v0", "v1"), modes=MODES, coefs=COEFS):
    """One NIE sample per (cell, row): the spec grid is a literal array that
    is exploded per row (a few cells), and the two vectors join by name."""
    cells = F.array(*[F.struct(F.lit(v).alias("vector"), F.lit(m).alias("mode"), F.lit(float(c)).alias("coef"))
                      for v in vectors for m in modes for c in coefs])
    base = logits_rows(spark, sf).withColumn("log_p_base", vec.log_softmax_at("logits", "pivot_token_id"))
    rows = base.select("*", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    rows = rows.join(F.broadcast(label_vectors(spark, sf)), "vector")  # two rows, one per vector
    steered = F.lit(None)
    for m in modes:
        steered = F.when(F.col("mode") == m, V.steer("logits", "v", F.col("coef"), m)).otherwise(steered)
    rows = rows.withColumn("steered", steered)
    cell = F.concat_ws("__", "vector", "mode", F.concat(F.lit("c"), F.col("coef").cast("string")))
    return rows.select(cell.alias("cell"), "vector", "mode", "coef", "row_id", "position", "pivot_token_id",
                       "log_p_base", vec.log_softmax_at("steered", "pivot_token_id").alias("log_p_steered")) \
        .withColumn("nie", F.col("log_p_steered") - F.col("log_p_base"))


def _steer_sql(mode: str, c: str, x: str = "e.embedding", v: str = "lv.v") -> str:
    vhat = f"({v}[i] / ({_n(v)} + 1e-8))"
    if mode == "additive_raw":
        return f"list_transform({x}, lambda xx, i: CAST(xx AS DOUBLE) + {c} * {v}[i])"
    if mode == "additive_normalized":
        return f"list_transform({x}, lambda xx, i: CAST(xx AS DOUBLE) + {c} * {_n(x)} * {vhat})"
    dot = f"list_sum(list_transform({x}, lambda y, j: CAST(y AS DOUBLE) * ({v}[j] / ({_n(v)} + 1e-8))))"
    return f"list_transform({x}, lambda xx, i: CAST(xx AS DOUBLE) + ({c} - 1.0) * {dot} * {vhat})"


def _lp_sql(arr: str, tok: str) -> str:
    return (f"(CAST({arr}[{tok} + 1] AS DOUBLE) - list_max(list_transform({arr}, lambda q: CAST(q AS DOUBLE))) - "
            f"ln(list_sum(list_transform({arr}, lambda q: exp(CAST(q AS DOUBLE) - "
            f"list_max(list_transform({arr}, lambda r: CAST(r AS DOUBLE))))))))")


_CASES = " ".join(f"WHEN g.mode = '{m}' THEN {_steer_sql(m, 'g.coef')}" for m in MODES)
_GRID_LOCAL = [
    ("lv", """SELECT 'v' || CAST(label AS VARCHAR) AS vector, list(m ORDER BY dim) AS v
              FROM (SELECT label, dim, avg(x) AS m
                    FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim,
                                 CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label <= 1)
                    GROUP BY label, dim) GROUP BY label"""),
    ("spec", "SELECT * FROM (VALUES " + ", ".join(
        f"('{v}', '{m}', CAST({c} AS DOUBLE))" for v in ("v0", "v1") for m in MODES for c in COEFS)
     + ") t(vector, mode, coef)"),
    ("st", f"""SELECT g.vector, g.mode, g.coef, e.vec_id AS row_id, e.label AS tok, e.embedding AS base,
                      CASE {_CASES} END AS steered
               FROM embeddings e CROSS JOIN spec g JOIN lv ON lv.vector = g.vector"""),
    ("samples", f"""SELECT vector || '__' || mode || '__c' || CAST(coef AS VARCHAR) AS cell, vector, mode, coef,
                           row_id, {_lp_sql('base', 'tok')} AS log_p_base, {_lp_sql('steered', 'tok')} AS log_p_steered
                    FROM st"""),
    ("s2", "SELECT *, log_p_steered - log_p_base AS nie FROM samples"),
]
_SUMMARY_SEL = """(SELECT count(*) FROM embeddings) AS n_rows, CAST(count(DISTINCT row_id) AS BIGINT) AS n_rows_with_samples,
       CAST(count(*) AS BIGINT) AS n_positions, round(avg(nie), 6) AS nie_mean,
       round(CASE WHEN count(*) > 1 THEN stddev_samp(nie) WHEN count(*) = 1 THEN 0.0 END, 6) AS nie_std,
       round(median(nie), 6) AS nie_median, round(avg(log_p_base), 6) AS log_p_base_mean,
       round(avg(log_p_steered), 6) AS log_p_steered_mean"""


def _n_rows(spark, sf):
    return X.n_embeddings(spark, sf)


@query("nie_positions", with_ctes("""
SELECT original_dataset_item_id AS row_id, CAST(position AS BIGINT) AS position, tokens[position + 2] AS pivot_token
FROM (SELECT original_dataset_item_id, tokens, least(len(labels), len(tokens)) AS u,
             generate_subscripts(labels, 1) - 1 AS position, unnest(labels) AS label
      FROM probe WHERE len(tokens) > 1)
WHERE label = 1 AND position < u - 1""", "pivot_rows",
                                  local=_probe_local()))
def q_nie_positions(spark, sf):
    """G1: labelled positions (label 1) usable for NIE, with the pivot token."""
    return tidy(N.nie_positions(probe_rows(spark, sf)))


@query("token_nie", with_ctes("""
SELECT row_id, CAST(0 AS BIGINT) AS position, round(log_p_base, 6) AS log_p_base,
       round(log_p_steered, 6) AS log_p_steered, round(nie, 6) AS nie
FROM s2 WHERE vector = 'v0' AND mode = 'additive_raw' AND coef = 0.5""", local=_GRID_LOCAL))
def q_token_nie(spark, sf):
    """Per-row NIE, steered = logits + 0.5 * (label-0 centroid)."""
    base = logits_rows(spark, sf)
    v0 = label_vectors(spark, sf).where(F.col("vector") == "v0").select("v").scalar()
    steered = base.withColumn("_v", v0).withColumn("logits", V.steer("logits", "_v", 0.5, "additive_raw"))
    out = N.token_nie(base, steered.drop("_v"))
    return tidy(out.select("row_id", "position", "log_p_base", "log_p_steered", "nie"))


@query("nie_summary", with_ctes(f"""
SELECT {_SUMMARY_SEL} FROM s2 WHERE vector = 'v0' AND mode = 'additive_normalized' AND coef = 0.5""",
                                local=_GRID_LOCAL))
def q_nie_summary(spark, sf):
    """NIE summary of one setting (normalized, c = 0.5, label-0 centroid)."""
    s = grid_samples(spark, sf, vectors=("v0",), modes=("additive_normalized",), coefs=(0.5,))
    return tidy(N.nie_summary(s, n_rows=_n_rows(spark, sf)))


@query("nie_candidate_grid", with_ctes(f"""
SELECT cell, vector, mode, round(coef, 6) AS coef, {_SUMMARY_SEL} FROM s2 GROUP BY cell, vector, mode, coef""",
                                       local=_GRID_LOCAL))
def q_nie_candidate_grid(spark, sf):
    """Vector x (mode, coef) cells, one NIE summary each."""
    s = grid_samples(spark, sf)
    return tidy(N.nie_summary(s, ["cell", "vector", "mode", "coef"], _n_rows(spark, sf)))


@query("nie_views", with_ctes(f"""
SELECT s.cell, s.vector, s.mode, round(s.coef, 6) AS coef, round(s.nie_mean, 6) AS nie_mean,
       round({_d('lv.v', 'r.ref')} / ({_n('lv.v')} * {_n('r.ref')} + 1e-12), 6) AS cos_to_reference
FROM (SELECT cell, vector, mode, coef, avg(nie) AS nie_mean FROM s2 GROUP BY ALL) s
JOIN lv ON lv.vector = s.vector CROSS JOIN refv r""", local=_GRID_LOCAL + [
    ("refv", """SELECT list(m ORDER BY dim) AS ref FROM (
                  SELECT dim, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) - 1 AS dim,
                                                       CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
                  GROUP BY dim)""")]))
def q_nie_views(spark, sf):
    """NIE per cell next to the vector's cosine with a reference
    direction (the mean embedding)."""
    s = N.nie_summary(grid_samples(spark, sf), ["cell", "vector", "mode", "coef"])
    e = load(spark, sf, "embeddings").withColumn("_g", F.lit(0))
    ref = V.centroid_arrays(e, ["_g"], "embedding", out_col="ref").select("ref").scalar()
    cos = V.cosine_vs_reference(label_vectors(spark, sf), ref, "v").select("vector", F.col("cosine")
                                                                          .alias("cos_to_reference"))
    return tidy(s.join(cos, "vector").select("cell", "vector", "mode", "coef", "nie_mean", "cos_to_reference"))


@query("nie_by_sign", with_ctes(f"""
SELECT CASE WHEN v.value - 30 > 0 THEN 'pos' WHEN v.value - 30 < 0 THEN 'neg' ELSE 'zero' END AS sign,
       {_SUMMARY_SEL}
FROM s2 JOIN events v ON v.event_id = s2.row_id
WHERE vector = 'v0' AND mode = 'additive_raw' AND coef = 0.5 GROUP BY 1""", local=_GRID_LOCAL))
def q_nie_by_sign(spark, sf):
    """NIE summary by the sign of the row's prob_delta."""
    s = grid_samples(spark, sf, vectors=("v0",), modes=("additive_raw",), coefs=(0.5,))
    c = X.vector_corpus(spark, sf).select(F.col("row_id"), "prob_delta")
    j = s.join(c, "row_id").withColumn("sign", F.when(F.col("prob_delta") > 0, "pos")
                                       .when(F.col("prob_delta") < 0, "neg").otherwise("zero"))
    return tidy(N.nie_summary(j, ["sign"], _n_rows(spark, sf)))


_N_BOOT = 2000
_BOOT_STEPS = " + ".join(f"CAST(u >= {t} AS INT)" for t in N.POISSON_STEPS)
_BOOT_LOCAL = _GRID_LOCAL + [
    ("reps", f"""SELECT b, [CAST('0x' || substr(m, 8 * i + 1, 8) AS BIGINT) % {N.PRIME} FOR i IN [0, 1, 2, 3]] AS a
                 FROM (SELECT b, md5(concat_ws('|', '42', 'rep', CAST(b AS VARCHAR))) AS m FROM range({_N_BOOT}) r(b))"""),
    ("hashed", f"""SELECT vec_id AS row_id, CAST('0x' || substr(md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR))), 1, 8)
                          AS BIGINT) % {N.PRIME} AS k FROM embeddings"""),
    ("weights", f"""SELECT row_id, b, {_BOOT_STEPS} AS w FROM (
                      SELECT row_id, b, (((a[4] * k + a[3]) % {N.PRIME} * k + a[2]) % {N.PRIME} * k + a[1]) % {N.PRIME} AS u
                      FROM hashed CROSS JOIN reps)"""),
    ("means", """SELECT cell, b, sum(w * nie) / sum(w) AS m FROM s2 JOIN weights USING (row_id)
                 WHERE w > 0 GROUP BY cell, b"""),
]


@query("bootstrap_ci", with_ctes("""
SELECT cell, n, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi
FROM means JOIN (SELECT cell, CAST(count(*) AS BIGINT) AS n FROM s2 GROUP BY cell) USING (cell) GROUP BY cell, n""",
                                 local=_BOOT_LOCAL))
def q_bootstrap_ci(spark, sf):
    """95% Poisson-bootstrap interval of the mean NIE per grid cell
    (2000 replicates)."""
    s = grid_samples(spark, sf).withColumn("_key", F.col("row_id"))
    return tidy(N.bootstrap_ci(s, "nie", "_key", ["cell"], n_boot=_N_BOOT))


_ARM_RUNS = [("base", 1), ("always_on", 2), ("detect", 3), ("random", 5)]
_ARMS_SQL = f"""
SELECT a.arm, round(m.accuracy, 6) AS accuracy, round(m.parse_rate, 6) AS parse_rate,
       round(g.fire_rate, 6) AS fire_rate, round(g.energy, 6) AS energy, CAST(f.flips AS BIGINT) AS flips
FROM (VALUES {", ".join(f"('{a}', {r})" for a, r in _ARM_RUNS)}) a(arm, run)
JOIN metrics m ON m.run = a.run
LEFT JOIN (SELECT run, sum(CASE WHEN base_correct IS DISTINCT FROM correct THEN 1 ELSE 0 END) AS flips
           FROM paired GROUP BY run) f ON f.run = a.run
LEFT JOIN (SELECT 'detect' AS arm, fire_rate, (SELECT sum(delta_norm) FROM lat WHERE fired) AS energy FROM det
           UNION ALL SELECT 'always_on', 1.0, (SELECT sum(delta_norm) FROM gate_steps)
           UNION ALL SELECT 'random', (SELECT count(*) FROM rnd WHERE force) / (SELECT count(*) FROM gate_steps),
                            (SELECT sum(delta_norm) FROM rnd WHERE on_)) g ON g.arm = a.arm"""
_ARMS_LOCAL = [
    ("det", "SELECT (SELECT count(*) FROM lat WHERE pf) / greatest(1, count(*)) AS fire_rate FROM gate_steps"),
    ("rnd0", f"""SELECT run, decision_idx, delta_norm, {_uniform_sql('101', 'run', 'decision_idx')}
                       < (SELECT least(greatest(CASE WHEN fire_rate = 0 THEN 0.2 ELSE fire_rate END, 0.05), 0.95) FROM det)
                       AS force FROM dec"""),
    ("rnd", """SELECT *, bool_or(force) OVER (PARTITION BY run ORDER BY decision_idx
                                              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS on_ FROM rnd0"""),
]


@query("arm_compare", with_ctes(_ARMS_SQL, "gate_steps", "generations", "run_config",
                                local=_latch_local("d.pf0") + _RUN_LOCAL + _ARMS_LOCAL, recursive=True))
def q_arm_compare(spark, sf):
    """Base / always-on / detect / random arms side by side: accuracy,
    parse rate, flips against base, and of the arm's own gate its fire rate
    and energy.  Always-on steers every step, prefill included; the random
    arm's pattern has the detector's rate, clamped."""
    arms = spark.createDataFrame(_ARM_RUNS, "arm string, run int")
    steps = stored_steps(spark, sf)
    dec = decided(steps)
    overall = [F.sum("n_fired").alias("f"), F.sum("n_calls").alias("c"), F.sum("energy").alias("energy")]
    rate = F.col("f") / F.greatest(F.lit(1), F.col("c"))
    det = G.gate_stats(latched(spark, sf, dec), steps).agg(*overall).select(rate.alias("fire_rate"), "energy")
    matched = det.select(G.matched_rate(F.col("fire_rate"))).scalar()
    forced = dec.withColumn("probe_fire", G.random_pattern(dec, matched))
    rnd = G.gate_stats(latched(spark, sf, forced), steps).agg(*overall).select(rate.alias("fire_rate"), "energy")
    on = steps.agg(F.lit(1.0).alias("fire_rate"), F.sum("delta_norm").alias("energy"))
    gates = (det.withColumn("arm", F.lit("detect")).unionByName(rnd.withColumn("arm", F.lit("random")))
             .unionByName(on.withColumn("arm", F.lit("always_on"))))
    runs, path = scored(spark, sf).select("run", "idx", "predicted", "correct"), new_path(spark, "scored")
    runs.write.parquet(path)  # read for the metrics, the base run and the others
    runs = spark.read.schema(runs.schema).parquet(path)
    flips = R.pair_with_base(runs, BASE).groupBy("run").agg(
        F.sum((~F.col("base_correct").eqNullSafe(F.col("correct"))).cast("long")).alias("flips"))
    j = arms.join(R.run_metrics(runs), "run").join(flips, "run", "left").join(gates, "arm", "left")
    return tidy(j.select("arm", "accuracy", "parse_rate", "fire_rate", "energy", "flips"))
