"""Answer scoring and paired analysis of evaluation runs.

A run is a set of rows keyed by (run, idx).  Pairing a run with the base
run is one equi-join on idx; every statistic is a grouped conditional
aggregate.  Per-example id lists are returned as long tables
(run, idx, change) instead of arrays, so no group is ever gathered into one
value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


# -- F1 / F2 / F3 ----------------------------------------------------------------

def score_run(gen: DataFrame, output_col: str = "full_output", answer_col: str = "answer",
              tail_chars: int | None = 400) -> DataFrame:
    """(run, idx, question, ground_truth, predicted, correct, full_output)."""
    pred = T.extract_answer(output_col)
    truth = T.extract_answer(answer_col)
    out = gen.select("*", pred.alias("predicted"), truth.alias("ground_truth"))
    # Step by step: inside one expression each use is computed anew.
    out = out.select("*", T.plain_answer("predicted").alias("_p"), T.plain_answer("ground_truth").alias("_g"))
    out = out.select("*", F.col("_p").try_cast("double").alias("_pn"), F.col("_g").try_cast("double").alias("_gn"))
    out = out.withColumn("correct", T.same_answer("predicted", "ground_truth", *map(F.col, ("_p", "_g", "_pn", "_gn"))))
    out = out.drop("_p", "_g", "_pn", "_gn")
    if tail_chars:
        out = out.withColumn(output_col, F.right(F.col(output_col), F.lit(tail_chars)))
    return out


# -- F4 / F5 / F6 ------------------------------------------------------------------

def run_metrics(scored: DataFrame, run_cols: Sequence[str] = ("run",)) -> DataFrame:
    """accuracy, F1 (tp = correct, fp = parsed - correct, fn = n - correct),
    parse_rate, correct, n per run."""
    g = list(run_cols)
    m = scored.groupBy(*g).agg(F.count(F.lit(1)).alias("n"),
                               F.sum(F.col("correct").cast("long")).alias("correct"),
                               F.sum(F.col("predicted").isNotNull().cast("long")).alias("parsed"))
    tp, fp, fn = F.col("correct"), F.col("parsed") - F.col("correct"), F.col("n") - F.col("correct")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    m = m.withColumn("_p", prec).withColumn("_r", rec)
    f1 = F.when(F.col("_p") + F.col("_r") > 0,
                2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    return m.select(*g, F.when(F.col("n") > 0, F.col("correct") / F.col("n")).otherwise(0.0).alias("accuracy"),
                    f1.alias("f1"),
                    F.when(F.col("n") > 0, F.col("parsed") / F.col("n")).otherwise(0.0).alias("parse_rate"),
                    "correct", "n")


def run_summary(metrics: DataFrame, config: DataFrame) -> DataFrame:
    """Metrics with the run configuration; strength = factor - 1."""
    return metrics.join(config, "run", "left").withColumn("strength", F.col("factor") - 1.0)


def accuracy_by_run(scored: DataFrame) -> DataFrame:
    return scored.groupBy("run").agg((F.avg(F.col("correct").cast("double")) * 100).alias("accuracy_pct"))


# -- pairing with the base run ---------------------------------------------------

def pair_with_base(scored: DataFrame, base_run, key: str = "idx") -> DataFrame:
    """Every non-base row with the base row's correctness of the same idx
    (null when the base run lacks the idx)."""
    base = scored.where(F.col("run") == base_run).select(key, F.col("correct").alias("base_correct"))
    arms = scored.where(F.col("run") != base_run)
    return arms.join(base, key, "left")


def gained_lost(paired: DataFrame) -> DataFrame:
    """Per run: base-wrong -> right (gained) and base-right -> wrong (lost);
    a missing base row counts as wrong."""
    b = F.coalesce(F.col("base_correct"), F.lit(False))
    c = F.col("correct")
    return paired.groupBy("run").agg(F.sum((~b & c).cast("long")).alias("gained"),
                                     F.sum((b & ~c).cast("long")).alias("lost"))


def gained_lost_ids(paired: DataFrame, key: str = "idx") -> DataFrame:
    """The gained/lost examples as a long table (run, idx, change)."""
    b = F.coalesce(F.col("base_correct"), F.lit(False))
    change = F.when(~b & F.col("correct"), "gained").when(b & ~F.col("correct"), "lost")
    return paired.select("run", key, change.alias("change")).where(F.col("change").isNotNull())


def flip_flag(paired: DataFrame) -> Column:
    """A flip: outcome differs from base; a missing base row is a flip."""
    return ~F.col("base_correct").eqNullSafe(F.col("correct"))


def flips_vs_base(paired: DataFrame) -> DataFrame:
    """Flips per run.  A missing base row is a flip either way; among positive
    and negative flips it counts as a wrong base."""
    base = F.coalesce("base_correct", F.lit(False))
    return paired.groupBy("run").agg(
        F.sum(flip_flag(paired).cast("long")).alias("flips"),
        F.sum((F.col("correct") & ~base).cast("long")).alias("positive_flips"),
        F.sum((~F.col("correct") & base).cast("long")).alias("negative_flips"),
        F.count(F.lit(1)).alias("n"))


def flip_table(scored: DataFrame, base_run, config: DataFrame, key: str = "idx") -> DataFrame:
    """One row per example whose outcome differs from the base run's (wrong
    where the base run lacks the example)."""
    base = scored.where(F.col("run") == base_run).select(key, F.col("correct").alias("base_correct"))
    arms = scored.where(F.col("run") != base_run)
    j = arms.join(base, key, "left").withColumn("base_correct", F.coalesce("base_correct", F.lit(False)))
    j = j.where(F.col("base_correct") != F.col("correct"))
    return j.join(config.select("run", "factor"), "run", "left")


def flip_set(paired: DataFrame, runs: Sequence, key: str = "idx") -> DataFrame:
    """Distinct flipped idx over the given runs (a union of flip sets)."""
    return paired.where(F.col("run").isin(list(runs)) & flip_flag(paired)).select(key).distinct()


def flip_sides(paired: DataFrame, runs_a: Sequence, runs_b: Sequence, key: str = "idx") -> DataFrame:
    """One row per idx that a run of either side flips: (key, in_a, in_b).
    One pass: flipped rows are reduced to membership flags by one shuffle."""
    a, b = list(runs_a), list(runs_b)
    flips = paired.where(F.col("run").isin(a + b) & flip_flag(paired))
    return flips.groupBy(key).agg(F.max(F.col("run").isin(a)).alias("in_a"), F.max(F.col("run").isin(b)).alias("in_b"))


def flip_overlap(paired: DataFrame, runs_a: Sequence, runs_b: Sequence, key: str = "idx") -> DataFrame:
    """Sizes, Jaccard (|A & B| / max(1, |A | B|)) and one-sided counts of the
    flip set of ``runs_a`` and the union of the flip sets of ``runs_b``."""
    c = lambda e: F.coalesce(F.sum(e.cast("long")), F.lit(0))
    a, b = F.col("in_a"), F.col("in_b")
    out = flip_sides(paired, runs_a, runs_b, key).agg(
        c(a).alias("n_a"), c(b).alias("n_b"), c(a & b).alias("n_both"), F.count(F.lit(1)).alias("n_union"),
        c(a & ~b).alias("n_a_only"), c(~a & b).alias("n_b_only"))
    return out.withColumn("jaccard", F.col("n_both") / F.greatest(F.lit(1), F.col("n_union")))


def flip_overlap_ids(paired: DataFrame, runs_a: Sequence, runs_b: Sequence, key: str = "idx") -> DataFrame:
    """The id tables behind ``flip_overlap``: (key, side), side being both,
    a_only or b_only.  A's flips are both + a_only."""
    side = (F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a_only").otherwise("b_only"))
    return flip_sides(paired, runs_a, runs_b, key).select(key, side.alias("side"))


# -- F12 / F13 / F14 ------------------------------------------------------------------

def random_band(metrics: DataFrame, config: DataFrame) -> DataFrame:
    """Per factor, over its random arms: mean, population std and number of
    accuracies, and the accuracies by run as a string of millionths."""
    rnd = metrics.join(config, "run").where(F.col("arm") == "random")
    by_run = F.array_sort(F.collect_list(F.struct("run", F.round(F.col("accuracy") * 1e6).cast("long").alias("a"))))
    return rnd.groupBy("factor").agg(
        F.avg("accuracy").alias("random_mean"), F.stddev_pop("accuracy").alias("random_std"),
        F.count("accuracy").alias("n_random"),
        F.array_join(F.transform(by_run, lambda x: x["a"].cast("string")), ",").alias("random_accs"))


def random_null_summary(metrics: DataFrame, config: DataFrame, base_run=1) -> DataFrame:
    """For each pivotal run: base accuracy, its own, the band of the random
    arms at the same factor, and the pivotal - random mean difference in
    points.  Factors without a random arm have a null band."""
    base = metrics.where(F.col("run") == base_run).select("accuracy").scalar()
    out = (metrics.join(config, "run").where(F.col("arm") == "pivotal")
           .select("factor", F.col("accuracy").alias("pivotal_acc"), base.alias("base_acc"))
           .join(random_band(metrics, config), "factor", "left"))
    return out.withColumn("pivotal_vs_random_mean_pp", (F.col("pivotal_acc") - F.col("random_mean")) * 100)


def run_table(parts: Sequence[DataFrame]) -> DataFrame:
    """Tidy union of run tables with differing columns, sorted by arm, alpha."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("arm", F.col("alpha").asc_nulls_first(), "run")


def layer_factor_grid(acc: DataFrame, factors: Sequence[float]) -> DataFrame:
    """accuracy pivoted to one column per factor (layer x factor)."""
    names = {f: "f_" + str(f).replace("-", "m").replace(".", "_") for f in factors}
    p = acc.groupBy("layer").pivot("factor", list(factors)).agg(F.first("accuracy"))
    for f, n in names.items():
        p = p.withColumnRenamed(str(f), n)
    return p


# -- F15 / F16 / F17 / F18 -----------------------------------------------------------

def matched_arms(metrics: DataFrame, config: DataFrame, wanted: DataFrame, tol: float = 1e-9) -> DataFrame:
    """For each wanted (name, value): the first run (lowest run id) of the arm
    whose factor is within ``tol``; null accuracy when none matches.  A
    tolerance join on a small spec table, then a first-per-group pick."""
    runs = metrics.join(config, "run")
    # the wanted spec is a short parameter list; the run table has one row
    # per run -- a small theta join
    j = F.broadcast(wanted).join(runs.select("run", "factor", "accuracy"),
                                 F.abs(F.col("factor") - F.col("value")) < F.lit(tol), "left")
    w = Window.partitionBy("name").orderBy(F.col("run").asc_nulls_last())
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(
        "name", "value", "run", "accuracy", F.col("run").isNull().alias("missing"))


def parse_prefixed_factor(name_col, prefix: str = "steered_") -> Column:
    """Factor encoded in a run name like 'steered_1.2'; null if unparsable."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return F.when(c.startswith(prefix), F.substring_index(c, prefix, -1).try_cast("double"))
