"""Plans and rows of queries that many runs, lines or turns made slow."""

import pytest
from pyspark.sql import functions as F

from pivotspark.operators import extensions as E
from pivotspark.operators import runs as R
from pivotspark.plans import catalog

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_refractory_gate_of_many_short_runs(spark):
    """Runs share a task's stream instead of a call each; gaps, repeated steps,
    null runs and probabilities that are no numbers as ever."""
    rows = [(r if r else None, s, p) for r in range(40) for s, p in ((1, .9), (3, .9), (5, .9), (5, .9), (21, .9), (22, .1), (23, float("nan")), (24, None), (25, .9))]
    out = E.refractory_gate(spark.createDataFrame(rows, "run long, step long, prob double"), k=3, threshold=0.5, block=8)
    assert "InPandas" not in _plan(out)
    for run in (None, 1, 39):
        got = [(r.step, r.accepted) for r in out.where(F.col("run").eqNullSafe(F.lit(run))).orderBy("step", F.desc("accepted")).collect()]
        assert got == [(1, True), (3, False), (5, True), (5, False), (21, True), (22, False), (23, False), (24, False), (25, True)]


def test_a_filter_on_the_outcome_does_not_score_again(spark):
    gen = spark.createDataFrame([(1, 1, "q", "#### 4", "so #### 4"), (2, 1, "q", "#### 4", "total is 5 units"), (2, 2, "q", "#### 1", "")],
                                "run int, idx long, question string, answer string, full_output string")
    table = R.flip_table(R.score_run(gen), 1, spark.createDataFrame([(2, 1.2)], "run int, factor double"))
    assert [(r.idx, r.correct, r.predicted) for r in table.collect()] == [(1, False, "5")]
    # the output and the answer, of the runs and of the base
    assert _plan(table).count("regexp_extract_all(") <= 4


@pytest.mark.parametrize("name", ["explode_labeled_tokens", "truncation_audit"])
def test_probe_rows_are_built_once(spark, name):
    assert "MapInArrow" not in _plan(catalog.QUERIES[name](spark, SF_SMALL))


def test_arms_are_scored_once(spark):
    assert "regexp_extract" not in _plan(catalog.QUERIES["arm_compare"](spark, SF_SMALL))
