"""Registered queries for the gate over ordered steps.

The oracle runs the latch as a true sequential recursion per run; the Spark
side uses the bounded-lookback window over step blocks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gating as G
from ..sources import fixtures as X
from ..sources.sinks import new_path
from .registry import query, tidy, with_ctes

TAU, N_HOLD, RATE, PATTERN_LEN = 0.5, 2, 0.2, 20


def decisions(spark, sf):
    return decided(X.gate_steps(spark, sf))


def stored_steps(spark, sf):
    """The steps, written once for queries that read them more than once."""
    steps, path = X.gate_steps(spark, sf), new_path(spark, "gate_steps")
    steps.write.parquet(path)
    return spark.read.schema(steps.schema).parquet(path)


def decided(steps):
    return G.decision_index(G.gate_decide(steps, TAU))


def latched(spark, sf, dec=None):
    return G.hysteresis_latch(dec if dec is not None else decisions(spark, sf), N_HOLD)


def _latch_local(force: str = "d.pf"):
    return [
        ("dec", f"""SELECT run, step, prob, delta_norm, prob > {TAU} AS pf0,
                          row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS decision_idx,
                          row_number() OVER (PARTITION BY run ORDER BY step) AS i
                   FROM gate_steps WHERE phase = 'decode'"""),
        ("dec2", f"SELECT *, {force} AS pf FROM dec d"),
        ("lat", f"""SELECT run, i, step, prob, delta_norm, pf, pf AS fired, false AS held,
                          CASE WHEN pf THEN {N_HOLD} ELSE 0 END AS latch
                   FROM dec2 WHERE i = 1
                   UNION ALL
                   SELECT d.run, d.i, d.step, d.prob, d.delta_norm, d.pf, d.pf OR l.latch > 0, NOT d.pf AND l.latch > 0,
                          CASE WHEN d.pf THEN {N_HOLD} WHEN l.latch > 0 THEN l.latch - 1 ELSE 0 END
                   FROM lat l JOIN dec2 d ON d.run = l.run AND d.i = l.i + 1"""),
    ]


def _gsql(body: str, *extra, force: str = "d.pf0", local=()):
    return with_ctes(body, "gate_steps", *extra, local=_latch_local(force) + list(local), recursive=True)


@query("gate_decide", with_ctes(f"""
SELECT run, step, round(prob, 6) AS prob, prob > {TAU} AS probe_fire FROM gate_steps WHERE phase = 'decode'""",
                                "gate_steps"))
def q_gate_decide(spark, sf):
    """H1: p = sigmoid(...) logged per step, fire when p > 0.5."""
    return tidy(decisions(spark, sf).select("run", "step", "prob", "probe_fire"))


@query("hysteresis_latch", _gsql("""
SELECT run, step, pf AS probe_fire, held, fired, CAST(latch AS BIGINT) AS latch_remaining FROM lat"""))
def q_hysteresis_latch(spark, sf):
    """H2: a fire latches the gate on for 2 more steps."""
    return tidy(latched(spark, sf).select("run", "step", "probe_fire", "held", "fired", "latch_remaining"))


_STATS_SQL = """
SELECT run, CAST(count(*) + any_value(pre) AS BIGINT) AS n_calls,
       CAST(count(*) FILTER (WHERE pf) AS BIGINT) AS n_fired, CAST(count(*) FILTER (WHERE held) AS BIGINT) AS n_hysteresis_holds,
       count(*) FILTER (WHERE pf) / greatest(1, count(*) + any_value(pre)) AS fire_rate,
       coalesce(sum(delta_norm) FILTER (WHERE fired), 0.0) AS energy
FROM lat JOIN (SELECT run, count(*) FILTER (WHERE phase = 'prefill') AS pre FROM gate_steps GROUP BY run) USING (run)
GROUP BY run"""


@query("gate_stats", _gsql("""
SELECT run, n_calls, n_fired, n_hysteresis_holds, round(fire_rate, 6) AS fire_rate, round(energy, 6) AS energy FROM st
UNION ALL
SELECT run, count(*), 0, 0, 0.0, 0.0 FROM gate_steps GROUP BY run HAVING count(*) FILTER (WHERE phase = 'decode') = 0""",
                           local=[("st", _STATS_SQL)]))
def q_gate_stats(spark, sf):
    """H3: calls (an un-steered prefill counts one), fires, holds, rate,
    energy."""
    steps = stored_steps(spark, sf)
    return tidy(G.gate_stats(latched(spark, sf, decided(steps)), steps))


@query("fire_log", _gsql("""
SELECT run, step, round(prob, 6) AS prob, fired, CAST(latch AS BIGINT) AS latch_remaining FROM lat"""))
def q_fire_log(spark, sf):
    """H4: the per-step log (step = calls so far, prefill included)."""
    return tidy(G.fire_log(latched(spark, sf)))


def _uniform_sql(seed: str, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT) / 4294967296.0)"


@query("random_pattern", with_ctes(f"""
SELECT run, CAST(k AS BIGINT) AS decision_idx, {_uniform_sql('101', 'run', 'k')} < {RATE} AS fire
FROM (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS k FROM gate_steps WHERE phase = 'decode')""",
                                   "gate_steps"))
def q_random_pattern(spark, sf):
    """H6: Bernoulli(0.2) decisions per run (seed = run), hashed uniforms."""
    d = decisions(spark, sf)
    return tidy(d.select("run", "decision_idx", G.random_pattern(d, RATE).alias("fire")))


@query("forced_pattern", _gsql(f"""
SELECT run, step, round(prob, 6) AS prob, fired, CAST(latch AS BIGINT) AS latch_remaining FROM lat""",
    force=f"coalesce(CASE WHEN d.decision_idx < {PATTERN_LEN} THEN "
          f"{_uniform_sql('101', 'd.run', 'd.decision_idx')} < {RATE} END, false)"))
def q_forced_pattern(spark, sf):
    """H5: decisions forced by a 20-long random pattern (false beyond it);
    prob is still logged and the latch still applies."""
    d = decisions(spark, sf)
    pat = d.where(F.col("decision_idx") < PATTERN_LEN).select(
        "run", "decision_idx", G.random_pattern(d, RATE).alias("force"))
    forced = G.forced_pattern(d.drop("probe_fire"), pat)
    return tidy(G.fire_log(latched(spark, sf, forced)))


@query("matched_rate", _gsql("""
SELECT run, round(fire_rate, 6) AS fire_rate,
       round(least(greatest(CASE WHEN fire_rate = 0 THEN 0.2 ELSE fire_rate END, 0.05), 0.95), 6) AS matched_rate
FROM st""", local=[("st", _STATS_SQL)]))
def q_matched_rate(spark, sf):
    """H7: the random arm's rate: the detector's rate (0 -> 0.2) clamped to
    [0.05, 0.95]."""
    steps = stored_steps(spark, sf)
    st = G.gate_stats(latched(spark, sf, decided(steps)), steps).where(F.col("n_calls") > 1)
    return tidy(st.select("run", "fire_rate", G.matched_rate(F.col("fire_rate")).alias("matched_rate")))


@query("gated_steer_energy", _gsql("""
SELECT run, CAST(count(*) FILTER (WHERE fired) AS BIGINT) AS n_steered,
       round(coalesce(sum(delta_norm) FILTER (WHERE fired), 0.0), 6) AS energy FROM lat GROUP BY run"""))
def q_gated_steer_energy(spark, sf):
    """H8: steer (normalized, c = 0.5, v = label-0 centroid) only at gated
    steps; energy = sum of |delta|."""
    return tidy(latched(spark, sf).groupBy("run").agg(
        F.sum(F.col("fired").cast("long")).alias("n_steered"),
        F.sum(F.when(F.col("fired"), F.col("delta_norm")).otherwise(0.0)).alias("energy")))


@query("prefill_rule", with_ctes("""
SELECT run, CAST(count(*) FILTER (WHERE phase = 'decode') + count(*) FILTER (WHERE phase = 'prefill') AS BIGINT)
           AS n_calls_unsteered_prefill,
       CAST(count(*) FILTER (WHERE phase = 'decode') AS BIGINT) AS n_calls_always_on,
       CAST(count(*) FILTER (WHERE phase = 'prefill') AS BIGINT) AS prefill_passes_steered_always_on
FROM gate_steps GROUP BY run""", "gate_steps"))
def q_prefill_rule(spark, sf):
    """An un-steered prefill adds one call and no decision; always-on
    steers every prefill position and adds no call."""
    s = X.gate_steps(spark, sf)
    dec = F.sum((F.col("phase") == "decode").cast("long"))
    pre = F.sum((F.col("phase") == "prefill").cast("long"))
    return tidy(s.groupBy("run").agg((dec + pre).alias("n_calls_unsteered_prefill"),
                                     dec.alias("n_calls_always_on"),
                                     pre.alias("prefill_passes_steered_always_on")))


@query("gate_stream", _gsql("""
SELECT run, step, round(prob, 6) AS prob, fired, CAST(latch AS BIGINT) AS latch_remaining,
       round(sum(CASE WHEN fired THEN delta_norm ELSE 0.0 END) OVER (PARTITION BY run ORDER BY step), 6) AS energy
FROM lat"""))
def q_gate_stream(spark, sf):
    """H9: the same gate online -- Structured Streaming over step files
    (availableNow), per-run state in transformWithStateInPandas; must equal the
    batch fire log (H4), with the energy so far."""
    from ..streaming.gate_stream import run_available_now, write_step_files
    base = new_path(spark, "gate_stream")
    write_step_files(X.gate_steps(spark, sf), f"{base}/src")
    out = run_available_now(spark, f"{base}/src", f"{base}/sink", f"{base}/ckpt", TAU, N_HOLD)
    return tidy(out.select("run", "step", "prob", "fired", "latch_remaining", "energy"))
