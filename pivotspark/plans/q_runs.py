"""Registered queries for answer scoring and paired run analysis (§2.F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec
from ..operators import runs as R
from ..operators import sampling as S
from ..sources import fixtures as X
from .q_vectors import _n, _train_dirs
from .registry import query, tidy, with_ctes

BASE = 1

_PRED = ("coalesce(replace(nullif(regexp_extract({c}, '####\\s*([+-]?\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)', 1), ''), "
         "',', ''), regexp_extract_all({c}, '[-+]?\\d*\\.?\\d+')[-1])")
_CLEAN = "replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), ',', '')"


def _correct_sql(p: str, g: str) -> str:
    pc, gc = _CLEAN.format(c=p), _CLEAN.format(c=g)
    return (f"CASE WHEN {p} IS NULL OR {g} IS NULL THEN false "
            f"WHEN TRY_CAST({pc} AS DOUBLE) IS NOT NULL AND TRY_CAST({gc} AS DOUBLE) IS NOT NULL "
            f"THEN TRY_CAST({pc} AS DOUBLE) = TRY_CAST({gc} AS DOUBLE) AND NOT isnan(TRY_CAST({pc} AS DOUBLE)) "
            f"ELSE {pc} = {gc} END")


_RUN_LOCAL = [
    ("ext", f"""SELECT run, idx, question, {_PRED.format(c='full_output')} AS predicted,
                       {_PRED.format(c='answer')} AS ground_truth, right(full_output, 400) AS full_output
                FROM generations"""),
    ("scored", f"SELECT *, {_correct_sql('predicted', 'ground_truth')} AS correct FROM ext"),
    ("rm0", """SELECT run, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS correct,
                      sum(CASE WHEN predicted IS NOT NULL THEN 1 ELSE 0 END) AS parsed
               FROM scored GROUP BY run"""),
    ("rm1", """SELECT *, CASE WHEN correct + (parsed - correct) > 0 THEN correct / parsed ELSE 0.0 END AS p,
                      CASE WHEN n > 0 THEN correct / n ELSE 0.0 END AS r
               FROM (SELECT run, CAST(n AS DOUBLE) AS n, CAST(correct AS DOUBLE) AS correct,
                            CAST(parsed AS DOUBLE) AS parsed FROM rm0)"""),
    ("metrics", """SELECT run, CASE WHEN n > 0 THEN correct / n ELSE 0.0 END AS accuracy,
                          CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1,
                          CASE WHEN n > 0 THEN parsed / n ELSE 0.0 END AS parse_rate,
                          CAST(correct AS BIGINT) AS correct, CAST(n AS BIGINT) AS n
                   FROM rm1"""),
    ("paired", """SELECT a.*, b.correct AS base_correct
                  FROM (SELECT * FROM scored WHERE run <> 1) a
                  LEFT JOIN (SELECT idx, correct FROM scored WHERE run = 1) b ON a.idx = b.idx"""),
]


def _run_sql(body: str, *extra_ctes: str, local=()):
    return with_ctes(body, "generations", "run_config", *extra_ctes, local=_RUN_LOCAL + list(local))


def scored(spark, sf):
    return R.score_run(X.generations(spark, sf))


def metrics(spark, sf):
    return R.run_metrics(scored(spark, sf))


def paired(spark, sf):
    return R.pair_with_base(scored(spark, sf), BASE)


@query("extract_answer", _run_sql("SELECT CAST(run AS BIGINT) AS run, idx, predicted FROM scored"))
def q_extract_answer(spark, sf):
    """number after '####', else the last number, else null."""
    g = X.generations(spark, sf)
    return tidy(g.select("run", "idx", T.extract_answer("full_output").alias("predicted")))


@query("is_correct", _run_sql(
    "SELECT CAST(run AS BIGINT) AS run, idx, predicted, ground_truth, correct FROM scored"))
def q_is_correct(spark, sf):
    """numeric equality when both parse, else string equality; null -> false."""
    return tidy(scored(spark, sf).select("run", "idx", "predicted", "ground_truth", "correct"))


@query("score_run", _run_sql("""
SELECT CAST(run AS BIGINT) AS run, idx, question, ground_truth, predicted, correct, full_output FROM scored"""))
def q_score_run(spark, sf):
    """scored results per (run, idx), output clipped to its last 400 chars."""
    return tidy(scored(spark, sf).select("run", "idx", "question", "ground_truth", "predicted", "correct",
                                         "full_output"))


_MET_SEL = """CAST(run AS BIGINT) AS run, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1,
       round(parse_rate, 6) AS parse_rate, correct, n"""


@query("run_metrics", _run_sql(f"SELECT {_MET_SEL} FROM metrics"))
def q_run_metrics(spark, sf):
    """accuracy, run F1, parse rate, correct, n per run."""
    return tidy(metrics(spark, sf))


@query("run_summary", _run_sql(f"""
SELECT {_MET_SEL}, c.arm, round(c.factor, 6) AS factor, round(c.factor - 1.0, 6) AS strength
FROM metrics m LEFT JOIN run_config c USING (run)"""))
def q_run_summary(spark, sf):
    """metrics with the run configuration (strength = factor - 1)."""
    return tidy(R.run_summary(metrics(spark, sf), X.run_config(spark, sf)))


@query("accuracy_by_run", _run_sql("""
SELECT CAST(run AS BIGINT) AS run, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy_pct
FROM scored GROUP BY run"""))
def q_accuracy_by_run(spark, sf):
    """accuracy in percent per run."""
    return tidy(R.accuracy_by_run(scored(spark, sf)))


@query("gained_lost", _run_sql("""
SELECT CAST(run AS BIGINT) AS run,
       CAST(sum(CASE WHEN NOT coalesce(base_correct, false) AND correct THEN 1 ELSE 0 END) AS BIGINT) AS gained,
       CAST(sum(CASE WHEN coalesce(base_correct, false) AND NOT correct THEN 1 ELSE 0 END) AS BIGINT) AS lost
FROM paired GROUP BY run"""))
def q_gained_lost(spark, sf):
    """gained / lost against base (missing base = wrong)."""
    return tidy(R.gained_lost(paired(spark, sf)))


@query("gained_lost_ids", _run_sql("""
SELECT CAST(run AS BIGINT) AS run, idx,
       CASE WHEN NOT coalesce(base_correct, false) AND correct THEN 'gained' ELSE 'lost' END AS change
FROM paired
WHERE (NOT coalesce(base_correct, false) AND correct) OR (coalesce(base_correct, false) AND NOT correct)"""))
def q_gained_lost_ids(spark, sf):
    """F7 id lists, as a long table."""
    return tidy(R.gained_lost_ids(paired(spark, sf)))


@query("flips_vs_base", _run_sql("""
SELECT CAST(run AS BIGINT) AS run,
       CAST(sum(CASE WHEN base_correct IS DISTINCT FROM correct THEN 1 ELSE 0 END) AS BIGINT) AS flips,
       CAST(sum(CASE WHEN correct AND NOT coalesce(base_correct, false) THEN 1 ELSE 0 END) AS BIGINT)
           AS positive_flips,
       CAST(sum(CASE WHEN NOT correct AND coalesce(base_correct, false) THEN 1 ELSE 0 END) AS BIGINT)
           AS negative_flips,
       CAST(count(*) AS BIGINT) AS n
FROM paired GROUP BY run"""))
def q_flips_vs_base(spark, sf):
    """F8: flips against base (missing base = flip, and wrong for the signs)."""
    return tidy(R.flips_vs_base(paired(spark, sf)))


@query("flip_table", _run_sql("""
SELECT CAST(p.run AS BIGINT) AS run, p.idx, round(c.factor, 6) AS factor,
       coalesce(p.base_correct, false) AS base_correct, p.correct, p.ground_truth, p.predicted
FROM paired p LEFT JOIN run_config c USING (run)
WHERE coalesce(p.base_correct, false) <> p.correct"""))
def q_flip_table(spark, sf):
    """one row per flipped example with factor, both outcomes, truth, prediction."""
    t = R.flip_table(scored(spark, sf), BASE, X.run_config(spark, sf))
    return tidy(t.select("run", "idx", "factor", "base_correct", "correct", "ground_truth", "predicted"))


def _overlap_sql(a_runs: str, b_runs: str):
    return _run_sql("""
SELECT CAST((SELECT count(*) FROM fa) AS BIGINT) AS n_a, CAST((SELECT count(*) FROM fb) AS BIGINT) AS n_b,
       CAST((SELECT count(*) FROM (SELECT idx FROM fa INTERSECT SELECT idx FROM fb)) AS BIGINT) AS n_both,
       CAST((SELECT count(*) FROM (SELECT idx FROM fa UNION SELECT idx FROM fb)) AS BIGINT) AS n_union,
       CAST((SELECT count(*) FROM (SELECT idx FROM fa EXCEPT SELECT idx FROM fb)) AS BIGINT) AS n_a_only,
       CAST((SELECT count(*) FROM (SELECT idx FROM fb EXCEPT SELECT idx FROM fa)) AS BIGINT) AS n_b_only,
       round((SELECT count(*) FROM (SELECT idx FROM fa INTERSECT SELECT idx FROM fb))
             / greatest(1, (SELECT count(*) FROM (SELECT idx FROM fa UNION SELECT idx FROM fb))), 6) AS jaccard""",
                    local=[("fa", f"SELECT DISTINCT idx FROM paired WHERE run IN ({a_runs}) "
                                  "AND base_correct IS DISTINCT FROM correct"),
                           ("fb", f"SELECT DISTINCT idx FROM paired WHERE run IN ({b_runs}) "
                                  "AND base_correct IS DISTINCT FROM correct")])


def _overlap_ids_sql(a_runs: str, b_runs: str):
    return _run_sql("""
SELECT coalesce(fa.idx, fb.idx) AS idx,
       CASE WHEN fb.idx IS NULL THEN 'a_only' WHEN fa.idx IS NULL THEN 'b_only' ELSE 'both' END AS side
FROM fa FULL OUTER JOIN fb ON fa.idx = fb.idx""",
                    local=[("fa", f"SELECT DISTINCT idx FROM paired WHERE run IN ({a_runs}) "
                                  "AND base_correct IS DISTINCT FROM correct"),
                           ("fb", f"SELECT DISTINCT idx FROM paired WHERE run IN ({b_runs}) "
                                  "AND base_correct IS DISTINCT FROM correct")])


@query("flip_overlap", _overlap_sql("2", "4, 5"))
def q_flip_overlap(spark, sf):
    """the pivotal arm's flips (run 2) vs the union of the random arms'
    at the same factor."""
    return tidy(R.flip_overlap(paired(spark, sf), [2], [4, 5]))


@query("flip_overlap_ids", _overlap_ids_sql("2", "4, 5"))
def q_flip_overlap_ids(spark, sf):
    """F10's id tables."""
    return tidy(R.flip_overlap_ids(paired(spark, sf), [2], [4, 5]))


@query("flip_overlap_pair_ids", _overlap_ids_sql("2", "3"))
def q_flip_overlap_pair_ids(spark, sf):
    """F11's id tables."""
    return tidy(R.flip_overlap_ids(paired(spark, sf), [2], [3]))


@query("flip_overlap_pair", _overlap_sql("2", "3"))
def q_flip_overlap_pair(spark, sf):
    """flips of two arms (runs 2 and 3) compared."""
    return tidy(R.flip_overlap(paired(spark, sf), [2], [3]))


_BAND = ("band", """SELECT factor, avg(accuracy) AS random_mean, stddev_pop(accuracy) AS random_std, count(*) AS n_random,
                           string_agg(CAST(CAST(round(accuracy * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY run) AS random_accs
                    FROM metrics JOIN random_control_config USING (run) WHERE arm = 'random' GROUP BY factor""")


@query("random_null_summary", _run_sql("""
SELECT round(c.factor, 6) AS factor, round(m.accuracy, 6) AS pivotal_acc,
       round((SELECT accuracy FROM metrics WHERE run = 1), 6) AS base_acc,
       round(r.random_mean, 6) AS random_mean, round(r.random_std, 6) AS random_std,
       CAST(r.n_random AS BIGINT) AS n_random, r.random_accs,
       round((m.accuracy - r.random_mean) * 100, 6) AS pivotal_vs_random_mean_pp
FROM metrics m JOIN random_control_config c USING (run) LEFT JOIN band r ON r.factor = c.factor
WHERE c.arm = 'pivotal'""", "random_control_config", local=[_BAND]))
def q_random_null_summary(spark, sf):
    """pivotal vs the random arms at its factor: accuracies, mean,
    population std, difference in points."""
    return tidy(R.random_null_summary(metrics(spark, sf), X.random_control_config(spark, sf), BASE))


@query("run_table", _run_sql("""
SELECT c.arm, CAST(m.run AS BIGINT) AS run, round(CASE WHEN c.arm = 'base' THEN NULL ELSE c.factor END, 6) AS alpha,
       round(m.accuracy, 6) AS accuracy, round(m.f1, 6) AS f1, round(m.parse_rate, 6) AS parse_rate
FROM metrics m JOIN run_config c USING (run)"""))
def q_run_table(spark, sf):
    """one tidy table of base and steered runs (differing columns)."""
    m = metrics(spark, sf).join(X.run_config(spark, sf), "run")
    base = m.where(F.col("arm") == "base").select("arm", "run", "accuracy", "f1", "parse_rate")
    arms = m.where(F.col("arm") != "base").select("arm", "run", F.col("factor").alias("alpha"), "accuracy",
                                                  "f1", "parse_rate")
    return tidy(R.run_table([base, arms]).select("arm", "run", "alpha", "accuracy", "f1", "parse_rate"))


_GRID_FACTORS = (1.2, 1.4, 1.6, 2.0, 0.0, -1.0)


def _grid_name(f):
    return "f_" + str(f).replace("-", "m").replace(".", "_")


@query("layer_factor_grid", _run_sql("""
SELECT CAST(layer AS BIGINT) AS layer, {cols}
FROM (SELECT CASE WHEN run IN (2, 3, 4) THEN 8 ELSE 14 END AS layer, factor, accuracy
      FROM metrics JOIN run_config USING (run) WHERE arm <> 'base')
GROUP BY layer""".format(cols=", ".join(
    f"round(first(accuracy) FILTER (WHERE factor = {f}), 6) AS {_grid_name(f)}" for f in _GRID_FACTORS))))
def q_layer_factor_grid(spark, sf):
    """accuracy pivoted layer x factor (runs 2-4 are a layer-8 sweep,
    5-7 a layer-14 sweep)."""
    m = metrics(spark, sf).join(X.run_config(spark, sf), "run").where(F.col("arm") != "base")
    m = m.withColumn("layer", F.when(F.col("run").isin(2, 3, 4), 8).otherwise(14))
    return tidy(R.layer_factor_grid(m, list(_GRID_FACTORS)))


_WANTED = [("amplify", 1.2), ("ablate", 0.0), ("flip", -1.0), ("strong", 3.0)]


@query("matched_arms", _run_sql("""
SELECT name, round(value, 6) AS value, CAST(run AS BIGINT) AS run, round(accuracy, 6) AS accuracy,
       run IS NULL AS missing
FROM (SELECT w.name, w.value, m.run, m.accuracy,
             row_number() OVER (PARTITION BY w.name ORDER BY m.run NULLS LAST) AS rn
      FROM wanted w LEFT JOIN (SELECT * FROM metrics JOIN run_config USING (run)) m
           ON abs(m.factor - w.value) < 1e-9)
WHERE rn = 1""", local=[("wanted", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', CAST({v} AS DOUBLE))" for n, v in _WANTED) + ") t(name, value)")]))
def q_matched_arms(spark, sf):
    """first run matching each wanted factor within 1e-9 (null if none)."""
    wanted = spark.createDataFrame(_WANTED, "name string, value double")
    return tidy(R.matched_arms(metrics(spark, sf), X.run_config(spark, sf), wanted))


def _dir_norm_sql():
    return f"(SELECT {_n('direction')} FROM train_dir WHERE layer = 1)"


@query("energy_table", _run_sql(f"""
SELECT CAST(m.run AS BIGINT) AS run, c.arm, round(abs(c.factor) * {_dir_norm_sql()}, 6) AS intervention_norm,
       round(m.accuracy, 6) AS accuracy,
       round((m.accuracy - (SELECT accuracy FROM metrics WHERE run = 1)) * 100, 6) AS lift_pp
FROM metrics m JOIN run_config c USING (run) WHERE c.arm <> 'base'""", "train_dir"))
def q_energy_table(spark, sf):
    """F16: per arm |factor| * |w| (w = layer-1 train direction), accuracy,
    lift over base in points."""
    m = metrics(spark, sf).join(X.run_config(spark, sf), "run")
    wnorm = _train_dirs(spark, sf).where(F.col("layer") == 1).select(vec.norm("direction")).scalar()
    base = m.where(F.col("run") == BASE).select("accuracy").scalar()
    out = m.where(F.col("arm") != "base").select(
        "run", "arm", (F.abs("factor") * wnorm).alias("intervention_norm"), "accuracy",
        ((F.col("accuracy") - base) * 100).alias("lift_pp"))
    return tidy(out)


def _run_names(spark, sf):
    c = X.run_config(spark, sf)
    return c.withColumn("name", F.when(F.col("arm") == "base", F.lit("base"))
                        .when(F.col("arm") == "pivotal", F.concat(F.lit("steered_"), F.col("factor").cast("string")))
                        .otherwise(F.concat(F.lit("steered_x"), F.col("run").cast("string"))))


@query("prior_run_overlay", _run_sql("""
SELECT round(coalesce(p.factor, b.factor), 6) AS factor, round(p.accuracy, 6) AS prior_accuracy,
       round(b.random_mean, 6) AS random_mean, round(b.random_std, 6) AS random_std
FROM (SELECT TRY_CAST(substr(name, 9) AS DOUBLE) AS factor, accuracy
      FROM (SELECT CASE WHEN arm = 'base' THEN 'base'
                        WHEN arm = 'pivotal' THEN 'steered_' || CAST(factor AS VARCHAR)
                        ELSE 'steered_x' || CAST(run AS VARCHAR) END AS name, accuracy
            FROM metrics JOIN run_config USING (run))
      WHERE name LIKE 'steered\\_%' ESCAPE '\\' AND TRY_CAST(substr(name, 9) AS DOUBLE) IS NOT NULL) p
FULL OUTER JOIN band b ON p.factor = b.factor""", "random_control_config", local=[_BAND]))
def q_prior_run_overlay(spark, sf):
    """factor parsed from 'steered_<f>' run names (unparsable dropped),
    outer-joined with the random band (mean, std) per factor."""
    names = _run_names(spark, sf).join(metrics(spark, sf), "run")
    prior = names.select(R.parse_prefixed_factor("name").alias("factor"), "accuracy").where(
        F.col("factor").isNotNull()).withColumnRenamed("accuracy", "prior_accuracy")
    band = R.random_band(metrics(spark, sf), X.random_control_config(spark, sf))
    j = prior.join(band, "factor", "full_outer")
    return tidy(j.select("factor", "prior_accuracy", "random_mean", "random_std"))


@query("decode_mode_compare", _run_sql("""
SELECT round(factor, 6) AS factor, round(greedy_acc, 6) AS greedy_acc, round(sampled_acc, 6) AS sampled_acc
FROM (SELECT c.factor,
             avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE idx % 2 = 0) AS greedy_acc,
             avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE idx % 2 = 1) AS sampled_acc
      FROM scored s JOIN run_config c USING (run) WHERE c.arm = 'pivotal' GROUP BY c.factor)
WHERE (SELECT bool_and(greedy_acc IS NOT NULL AND sampled_acc IS NOT NULL) FROM (
         SELECT avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE idx % 2 = 0) AS greedy_acc,
                avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE idx % 2 = 1) AS sampled_acc
         FROM scored s JOIN run_config c USING (run) WHERE c.arm = 'pivotal' GROUP BY c.factor))"""))
def q_decode_mode_compare(spark, sf):
    """greedy (even idx) vs sampled (odd idx) accuracy per factor,
    reported only when every factor has both modes."""
    s = scored(spark, sf).join(X.run_config(spark, sf), "run").where(F.col("arm") == "pivotal")
    s = s.withColumn("mode", F.when(F.col("idx") % 2 == 0, "greedy").otherwise("sampled"))
    acc = s.groupBy("factor").agg(
        F.avg(F.when(F.col("mode") == "greedy", F.col("correct").cast("double"))).alias("greedy_acc"),
        F.avg(F.when(F.col("mode") == "sampled", F.col("correct").cast("double"))).alias("sampled_acc"))
    complete = acc.agg(F.bool_and(F.col("greedy_acc").isNotNull() & F.col("sampled_acc").isNotNull())).scalar()
    return tidy(acc.where(complete))


@query("lift_table", _run_sql("""
SELECT CAST(run AS BIGINT) AS run, round((accuracy - (SELECT accuracy FROM metrics WHERE run = 1)) * 100, 6)
           AS acc_lift_pp
FROM metrics WHERE run <> 1 ORDER BY acc_lift_pp DESC, run LIMIT 20"""))
def q_lift_table(spark, sf):
    """accuracy lift over base in points, top 20."""
    m = metrics(spark, sf)
    base = m.where(F.col("run") == BASE).select("accuracy").scalar()
    out = m.where(F.col("run") != BASE).select("run", ((F.col("accuracy") - base) * 100).alias("acc_lift_pp"))
    return tidy(out.orderBy(F.col("acc_lift_pp").desc(), "run").limit(20))


@query("best_per_task", _run_sql("""
SELECT arm AS task, CAST(run AS BIGINT) AS run, round(accuracy, 6) AS accuracy
FROM (SELECT arm, run, accuracy, row_number() OVER (PARTITION BY arm ORDER BY accuracy DESC, run) AS rn
      FROM metrics JOIN run_config USING (run)) WHERE rn = 1"""))
def q_best_per_task(spark, sf):
    """the best run per task (arm) by accuracy."""
    m = metrics(spark, sf).join(X.run_config(spark, sf), "run").withColumnRenamed("arm", "task")
    top = S.topk_per_group(m, ["task"], [F.col("accuracy").desc(), F.col("run")], 1, salt_buckets=0)
    return tidy(top.select("task", "run", "accuracy"))


@query("arms_pivot", _run_sql("""
SELECT grp, round(avg(accuracy) FILTER (WHERE arm = 'base'), 6) AS base,
       round(avg(accuracy) FILTER (WHERE arm = 'pivotal'), 6) AS pivotal,
       round(avg(accuracy) FILTER (WHERE arm = 'random'), 6) AS random
FROM (SELECT CASE WHEN run <= 4 THEN 'early' ELSE 'late' END AS grp, arm, accuracy
      FROM metrics JOIN run_config USING (run)) GROUP BY grp"""))
def q_arms_pivot(spark, sf):
    """mean accuracy by group x arm (3 arms as columns)."""
    m = metrics(spark, sf).join(X.run_config(spark, sf), "run")
    m = m.withColumn("grp", F.when(F.col("run") <= 4, "early").otherwise("late"))
    return tidy(m.groupBy("grp").pivot("arm", ["base", "pivotal", "random"]).agg(F.avg("accuracy")))


@query("argmax_select", _run_sql("""
SELECT CAST(run AS BIGINT) AS best_run, round(accuracy, 6) AS best_accuracy
FROM metrics WHERE run <> 1 ORDER BY accuracy DESC, run LIMIT 1"""))
def q_argmax_select(spark, sf):
    """the best steered run by accuracy."""
    m = metrics(spark, sf).where(F.col("run") != BASE)
    return tidy(m.orderBy(F.col("accuracy").desc(), "run").limit(1).select(
        F.col("run").alias("best_run"), F.col("accuracy").alias("best_accuracy")))


@query("norm_vs_lift", _run_sql("""
SELECT c.arm, CAST(m.run AS BIGINT) AS run, round(abs(c.factor) * 0.2, 6) AS injected_norm,
       round((m.accuracy - (SELECT accuracy FROM metrics WHERE run = 1)) * 100, 6) AS lift_pp
FROM metrics m JOIN run_config c USING (run) WHERE c.arm <> 'base'"""))
def q_norm_vs_lift(spark, sf):
    """injected norm (|factor| * 0.2) against accuracy lift, by arm."""
    m = metrics(spark, sf).join(X.run_config(spark, sf), "run")
    base = m.where(F.col("run") == BASE).select("accuracy").scalar()
    return tidy(m.where(F.col("arm") != "base").select(
        "arm", "run", (F.abs("factor") * 0.2).alias("injected_norm"),
        ((F.col("accuracy") - base) * 100).alias("lift_pp")))
