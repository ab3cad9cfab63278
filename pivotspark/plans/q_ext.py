"""Registered queries for the second-wave operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extensions as E
from ..operators import gating as G
from ..operators import vectors as V
from ..sources import fixtures as X
from ..sources.tables import load
from .q_gate import N_HOLD, TAU, decisions, stored_steps
from .q_probes import _MID_LOCAL, _PROBE_LOCAL, midpoint_probes, scored_test
from .q_runs import _run_sql, scored
from .q_vectors import _test
from .registry import query, tidy, with_ctes


@query("signed_labels", with_ctes("""
SELECT dataset_item_id, CAST(row_ord AS BIGINT) AS row_ord,
       CAST(CASE WHEN prob_delta > 0.1 THEN 1 ELSE -1 END AS BIGINT) AS signed_label
FROM pivot_rows WHERE prob_delta > 0.1 OR prob_delta < -0.1""", "pivot_rows"))
def q_signed_labels(spark, sf):
    """+1 / -1 outside the +-0.1 dead zone."""
    s = E.signed_labels(X.pivot_rows(spark, sf))
    return tidy(s.select("dataset_item_id", "row_ord", "signed_label"))


@query("signed_centroid_diff", with_ctes("""
SELECT CAST(dim AS BIGINT) AS dim,
       round(avg(x) FILTER (WHERE prob_delta > 0) - avg(x) FILTER (WHERE prob_delta < 0), 6) AS value
FROM corpus_long GROUP BY dim""", "corpus_long"))
def q_signed_centroid_diff(spark, sf):
    """Mean vector of delta > 0 rows minus that of delta < 0 rows."""
    c = X.vector_corpus(spark, sf).where(F.col("prob_delta") != 0).withColumn(
        "pos", (F.col("prob_delta") > 0).cast("int")).withColumn("_g", F.lit(0))
    return tidy(V.centroid_diff_long(c, ["_g"], "pos", "steering_vector").select("dim", "value"))


@query("cascade_gate", with_ctes("""
SELECT CAST(a.layer AS BIGINT) AS layer, a.query_id, round(a.prob * (1 - b.prob), 6) AS p_cascade,
       a.prob > 0.5 AND a.prob * (1 - b.prob) > 0.25 AS fire,
       round(CASE WHEN a.prob > 0.5 AND a.prob * (1 - b.prob) > 0.25 THEN 2.0 * a.prob * (1 - b.prob) ELSE 0.0 END, 6)
           AS strength
FROM scored a JOIN scored_mid2 b ON a.layer = b.layer AND a.query_id = b.query_id""",
                                   "activations", "train_dir", "acts_long", local=_PROBE_LOCAL + _MID_LOCAL + [
    ("scored_mid2", """SELECT a.layer, a.query_id,
                              1.0 / (1.0 + exp(-(list_sum(list_transform(a.activation, lambda x, i:
                                  CAST(x AS DOUBLE) * p.w[i])) - list_sum(list_transform(p.w, lambda x, i: x * p.m[i])))))
                                  AS prob
                       FROM activations a JOIN mid p ON a.layer = p.layer WHERE a.split = 'test' AND a.layer <> 0""")]))
def q_cascade_gate(spark, sf):
    """p1 (centroid probe) * (1 - p2) (midpoint probe), thresholds 0.5
    and 0.25, strength 2 * p."""
    a = scored_test(spark, sf).select("layer", "query_id", F.col("prob").alias("p1"))
    b = scored_test(spark, sf, midpoint_probes(spark, sf)).select("layer", "query_id", F.col("prob").alias("p2"))
    c = E.cascade_gate(a.join(b, ["layer", "query_id"]), "p1", "p2")
    return tidy(c.select("layer", "query_id", "p_cascade", "fire", "strength"))


@query("refractory_gate", with_ctes(f"""
SELECT run, step, round(prob, 6) AS prob, ok AS accepted FROM rf""", "gate_steps", local=[
    ("dec", f"""SELECT run, step, prob, row_number() OVER (PARTITION BY run ORDER BY step) AS i
               FROM gate_steps WHERE phase = 'decode'"""),
    ("rf", f"""SELECT run, i, step, prob, prob > {TAU} AS ok, CASE WHEN prob > {TAU} THEN step + 3 ELSE -1 END AS lock
              FROM dec WHERE i = 1
              UNION ALL
              SELECT d.run, d.i, d.step, d.prob, d.prob > {TAU} AND d.step > r.lock,
                     CASE WHEN d.prob > {TAU} AND d.step > r.lock THEN d.step + 3 ELSE r.lock END
              FROM rf r JOIN dec d ON d.run = r.run AND d.i = r.i + 1""")], recursive=True))
def q_refractory_gate(spark, sf):
    """I4: an accepted fire locks the next 3 steps (sequential per run)."""
    d = decisions(spark, sf)
    return tidy(E.refractory_gate(d, k=3, threshold=TAU))


@query("threshold_at_fpr", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, round(min(t), 6) AS threshold, round(min_by(fpr, t), 6) AS fpr
FROM (SELECT DISTINCT s.layer, s.prob AS t,
             (SELECT count(*) FROM scored n WHERE n.layer = s.layer AND n.label < 0.5 AND n.prob >= s.prob)
             / (SELECT count(*) FROM scored n WHERE n.layer = s.layer AND n.label < 0.5) AS fpr
      FROM scored s)
WHERE fpr <= 0.1 GROUP BY layer""", "activations", "train_dir", local=_PROBE_LOCAL))
def q_threshold_at_fpr(spark, sf):
    """Smallest threshold with false-positive rate <= 0.1 per layer."""
    return tidy(E.threshold_at_fpr(scored_test(spark, sf), 0.1))


_DECODER = "SELECT vec_id AS feature, embedding AS vector FROM embeddings"
_SPARSE = """SELECT user_id AS row_id, event_id % (SELECT count(*) FROM embeddings) AS feature, sum(value / 100) AS weight
             FROM events GROUP BY 1, 2"""


@query("sparse_feature_projection", with_ctes("""
SELECT row_id, CAST(dim AS BIGINT) AS dim, round(sum(weight * x), 6) AS value
FROM (SELECT a.row_id, a.weight, generate_subscripts(d.vector, 1) - 1 AS dim, CAST(unnest(d.vector) AS DOUBLE) AS x
      FROM sp a JOIN dec d ON a.feature = d.feature WHERE a.weight <> 0)
GROUP BY row_id, dim""", local=[("dec", _DECODER), ("sp", _SPARSE)]))
def q_sparse_feature_projection(spark, sf):
    """Sum of weight * decoder row over each row's non-zero features
    (decoder rows = the embeddings; weights from events)."""
    dec = load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("feature"), F.col("embedding").alias("vector"))
    ev, n = load(spark, sf, "events"), X.n_embeddings(spark, sf)
    acts = ev.groupBy(F.col("user_id").alias("row_id"), (F.col("event_id") % n).alias("feature")).agg(
        F.sum(F.col("value") / 100).alias("weight"))
    return tidy(E.sparse_feature_projection(acts, dec))


@query("feature_lift", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(feature AS BIGINT) AS feature, round(act_pivot, 6) AS act_pivot,
       round(act_nonpivot, 6) AS act_nonpivot, round(lift, 6) AS lift, CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY lift DESC, feature) AS rank
      FROM (SELECT layer, dim AS feature, avg(x) FILTER (WHERE label = 1) AS act_pivot,
                   avg(x) FILTER (WHERE label <> 1) AS act_nonpivot,
                   avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label <> 1) AS lift
            FROM acts_long GROUP BY layer, dim))
WHERE rank <= 5""", "acts_long"))
def q_feature_lift(spark, sf):
    """Features (dims) most raised at pivot positions, top 5 per layer."""
    ex = V.explode_dims(X.activations(spark, sf), "activation", ["layer", "label"])
    return tidy(E.feature_lift(ex).select("layer", "feature", "act_pivot", "act_nonpivot", "lift", "rank"))


@query("feature_edit", with_ctes("""
SELECT CAST(a.layer AS BIGINT) AS layer, a.query_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim,
       round(unnest(v), 6) AS value
FROM (SELECT a.layer, a.query_id,
             list_transform(a.activation, lambda x, i: CASE WHEN i - 1 = 2 THEN c.centroid[i]
                                                             WHEN i - 1 = 1 THEN least(CAST(x AS DOUBLE), 0.05)
                                                             WHEN i - 1 IN (0, 3) THEN CAST(x AS DOUBLE) * 2.0
                                                             ELSE CAST(x AS DOUBLE) END) AS v
      FROM activations a JOIN cent c ON a.layer = c.layer WHERE a.split = 'test') a""", "activations", "acts_long",
                                   local=[("cent", """SELECT layer, list(m ORDER BY dim) AS centroid FROM (
                                       SELECT layer, dim, avg(x) AS m FROM acts_long GROUP BY layer, dim)
                                       GROUP BY layer""")]))
def q_feature_edit(spark, sf):
    """I8: amplify dims 0 and 3 (x2), clamp dim 1 at 0.05, patch dim 2 from
    the layer centroid."""
    a = X.activations(spark, sf)
    cent = V.centroid_arrays(a, ["layer"], "activation")
    t = _test(spark, sf).join(F.broadcast(cent), "layer")   # one centroid per layer
    e = t.withColumn("v", E.feature_edit("activation", amplify={0: 2.0, 3: 2.0}, clamp={1: 0.05},
                                         patch=F.col("centroid"), patch_dims=[2]))
    return tidy(e.select("layer", "query_id", F.posexplode("v").alias("dim", "value")))


_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def _sweep_sql() -> str:
    """Per threshold: latched decisions (a fire within the last two), rates
    and the accuracy of the run whose examples the gate would steer."""
    return f"""
SELECT round(t.th, 6) AS threshold, round(f.fire_rate, 6) AS fire_rate, round(f.steered_rate, 6) AS steered_rate,
       round(a.accuracy, 6) AS accuracy, round((a.accuracy - a.base_accuracy) * 100, 6) AS lift_pp
FROM (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in _THRESHOLDS)}) t(th)
JOIN (SELECT th, avg(CASE WHEN pf THEN 1.0 ELSE 0.0 END) AS fire_rate, avg(CASE WHEN on_ THEN 1.0 ELSE 0.0 END) AS steered_rate
      FROM lt GROUP BY th) f ON f.th = t.th
JOIN (SELECT g.th, avg(CASE WHEN CASE WHEN g.steered THEN s.correct ELSE b.correct END THEN 1.0 ELSE 0.0 END) AS accuracy,
             avg(CASE WHEN b.correct THEN 1.0 ELSE 0.0 END) AS base_accuracy
      FROM (SELECT th, run, bool_or(on_) AS steered FROM lt GROUP BY th, run) g
      JOIN (SELECT idx, correct FROM scored WHERE run = 2) s ON s.idx % (SELECT max(user_id) + 1 FROM events) = g.run
      JOIN (SELECT idx, correct FROM scored WHERE run = 1) b ON b.idx = s.idx GROUP BY g.th) a ON a.th = t.th"""


_SWEEP_LOCAL = [
    ("dt", f"""SELECT run, step, prob, prob > th AS pf, th, row_number() OVER (PARTITION BY th, run ORDER BY step) AS i
               FROM gate_steps CROSS JOIN (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in _THRESHOLDS)}) t(th)
               WHERE phase = 'decode'"""),
    ("lt", """SELECT th, run, pf, bool_or(pf) OVER (PARTITION BY th, run ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
                     AS on_ FROM dt"""),
]


@query("accuracy_vs_fire_rate", _run_sql(_sweep_sql(), "gate_steps", local=_SWEEP_LOCAL))
def q_accuracy_vs_fire_rate(spark, sf):
    """Over thresholds: fire rate and steered rate (latch included) of
    the gate's decisions, accuracy of the run it makes, and its lift over
    base.  An example belongs to gate run idx mod the number of
    runs; it has the outcome of
    the steered arm (run 2) if its gate is ever on, else that of the base."""
    steps = G.decision_index(stored_steps(spark, sf))
    ths = F.explode(F.array(*[F.lit(float(t)) for t in _THRESHOLDS])).alias("threshold")
    d = steps.select("run", "step", "prob", "decision_idx", ths).withColumn("probe_fire", F.col("prob") > F.col("threshold"))
    # one latch per (threshold, run)
    d = d.withColumn("key", F.struct("threshold", "run"))
    on = G.hysteresis_latch(d, N_HOLD, run_col="key")
    per = on.groupBy("threshold", "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("probe_fire").cast("long")).alias("f"),
        F.sum(F.col("fired").cast("long")).alias("o"))
    rates = per.groupBy("threshold").agg((F.sum("f") / F.sum("n")).alias("fire_rate"), (F.sum("o") / F.sum("n")).alias("steered_rate"))
    s, n_runs = scored(spark, sf), load(spark, sf, "events").agg(F.max("user_id") + 1).scalar()
    outcome = (s.where("run = 2").select("idx", F.col("correct").alias("steered"))
               .join(s.where("run = 1").select("idx", F.col("correct").alias("base")), "idx")
               # counts per gate run: what meets the sweep is one row a run
               .groupBy((F.col("idx") % n_runs).alias("run")).agg(
                   F.count(F.lit(1)).alias("m"), F.sum(F.col("steered").cast("long")).alias("s"), F.sum(F.col("base").cast("long")).alias("b")))
    acc = per.join(outcome, "run").groupBy("threshold").agg(
        (F.sum(F.when(F.col("o") > 0, F.col("s")).otherwise(F.col("b"))) / F.sum("m")).alias("accuracy"),
        (F.sum("b") / F.sum("m")).alias("base_accuracy"))
    return tidy(rates.join(acc, "threshold").select(
        "threshold", "fire_rate", "steered_rate", "accuracy", ((F.col("accuracy") - F.col("base_accuracy")) * 100).alias("lift_pp")))
