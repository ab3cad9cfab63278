"""Gating over ordered steps, batch form.

The gate decides per decode step ``fire = prob > threshold``; a fire sets a
latch of N further steps during which the gate is held on.  The latch only
looks back N decisions, so it is computed with a bounded range frame instead
of a sequential loop, and decisions are cut into blocks of B (plus the N
before each block as a read-only halo) so that one very long run is spread
over many tasks with identical results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.keys import uniform01

DEFAULT_BLOCK = 4096


def probe_prob(h, w, b) -> Column:
    """Probability of the linear probe: sigmoid(w . h + b)."""
    return vec.sigmoid(vec.dot(h, w) + b)


def gate_decide(steps: DataFrame, threshold: float = 0.5, prob_col: str = "prob") -> DataFrame:
    """H1: strict ``prob > threshold`` on decode steps."""
    return steps.withColumn("probe_fire", (F.col(prob_col) > F.lit(float(threshold))) &
                            (F.col("phase") == "decode"))


def decision_index(steps: DataFrame, run_col: str = "run", step_col: str = "step",
                   block: int = DEFAULT_BLOCK) -> DataFrame:
    """Decode steps with ``decision_idx``, their 0-based number among the
    decode steps of the run (prefill passes, of which a run may have several,
    are not decisions).  Blocks of steps are counted, the counts summed up
    per run, and rows numbered inside their block."""
    d = steps.where(F.col("phase") == "decode").withColumn("_blk", F.floor(F.col(step_col) / block))
    per = d.groupBy(run_col, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(run_col).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(run_col, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(run_col, "_blk").orderBy(step_col)
    return (d.join(per, [run_col, "_blk"])
            .withColumn("decision_idx", F.col("_off") + F.row_number().over(inside) - 1).drop("_blk", "_off"))


def hysteresis_latch(decisions: DataFrame, n_hold: int = 2, run_col: str = "run", idx_col: str = "decision_idx",
                     fire_col: str = "probe_fire", block: int = DEFAULT_BLOCK) -> DataFrame:
    """H2: adds ``held`` (on only because of the latch), ``fired`` (fire or
    hold) and ``latch_remaining`` (after the step) to decode decisions.  The
    latch counts decisions, so prefill passes in between do not wear it down.

    held at k  <=>  not fire(k) and the latest fire f in [k - N, k - 1] exists;
    latch(k)   =   N if fire(k), else N - (k - f), else 0."""
    assert n_hold < block
    k = F.col(idx_col)
    main = decisions.withColumn("_blk", F.floor(k / block)).withColumn("_halo", F.lit(False))
    halo = (decisions.where(F.pmod(k, F.lit(block)) >= block - n_hold)
            .withColumn("_blk", F.floor(k / block) + 1).withColumn("_halo", F.lit(True)))
    u = main.unionByName(halo)
    w = Window.partitionBy(run_col, "_blk").orderBy(k).rangeBetween(-n_hold, -1)
    last = F.max(F.when(F.col(fire_col), k)).over(w)
    u = u.withColumn("_last", last).where(~F.col("_halo"))
    held = ~F.col(fire_col) & F.col("_last").isNotNull()
    latch = (F.when(F.col(fire_col), F.lit(n_hold))
             .when(F.col("_last").isNotNull(), F.lit(n_hold) - (k - F.col("_last")))
             .otherwise(F.lit(0)))
    return (u.withColumn("held", held).withColumn("fired", F.col(fire_col) | held)
            .withColumn("latch_remaining", latch.cast("int")).drop("_blk", "_halo", "_last"))


def gate_stats(latched: DataFrame, steps: DataFrame, run_col: str = "run", prefill_unsteered: bool = True,
               delta_col: str = "delta_norm") -> DataFrame:
    """H3: n_calls (decode steps, plus one per un-steered prefill pass),
    n_fired (probe fires, holds excluded), holds, fire rate, and energy: the
    sum of |delta| over the steps that are steered, which are those fired or
    held and, when prefill is steered, the prefill passes."""
    dec = latched.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("_dec"), F.sum(F.col("probe_fire").cast("long")).alias("n_fired"),
        F.sum(F.col("held").cast("long")).alias("n_hysteresis_holds"),
        F.sum(F.when(F.col("fired"), F.col(delta_col)).otherwise(0.0)).alias("_e"))
    pre = steps.where(F.col("phase") == "prefill").groupBy(run_col).agg(
        F.count(F.lit(1)).alias("_pre"), F.sum(delta_col).alias("_pe"))
    j = dec.join(pre, run_col, "full_outer").fillna(0, ["_dec", "_pre", "n_fired", "n_hysteresis_holds", "_e", "_pe"])
    calls = F.col("_dec") + (F.col("_pre") if prefill_unsteered else F.lit(0))
    return j.select(run_col, calls.alias("n_calls"), "n_fired", "n_hysteresis_holds",
                    (F.col("n_fired") / F.greatest(F.lit(1), calls)).alias("fire_rate"),
                    (F.col("_e") + (F.lit(0.0) if prefill_unsteered else F.col("_pe"))).alias("energy"))


def fire_log(latched: DataFrame) -> DataFrame:
    """H4: step (= n_calls so far, the prefill call included), prob, fired
    (holds included) and latch after the step."""
    return latched.select("run", "step", "prob", "fired", "latch_remaining")


def random_pattern(decisions: DataFrame, rate, seed_col: str = "run", index_col: str = "decision_idx",
                   seed=101) -> Column:
    """H6: Bernoulli(rate) decision per (seed, index) from a hashed uniform --
    computed on the decision rows themselves, never materialised as a list."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return uniform01(seed, F.col(seed_col), F.col(index_col)) < r


def forced_pattern(decisions: DataFrame, pattern: DataFrame, run_col: str = "run",
                   index_col: str = "decision_idx") -> DataFrame:
    """H5: the i-th decision comes from a boolean pattern (run, index,
    force); false beyond its end; prob is still logged."""
    j = decisions.join(pattern, [run_col, index_col], "left")
    return j.withColumn("probe_fire", F.coalesce(F.col("force"), F.lit(False))).drop("force")


def matched_rate(rate: Column) -> Column:
    """H7: rate or 0.2 when zero, clamped to [0.05, 0.95]."""
    r = F.when(rate.isNull() | (rate == 0), F.lit(0.2)).otherwise(rate)
    return F.least(F.greatest(r, F.lit(0.05)), F.lit(0.95))
