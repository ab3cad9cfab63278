"""Paired run analysis against hand-made rows."""

import pytest
from pyspark.sql import functions as F

from pivotspark.operators import runs as R
from pivotspark.operators import textstats as TS


@pytest.fixture(scope="module")
def scored(spark):
    # idx 4 and 5 have no base row
    rows = [(1, 1, True), (1, 2, True), (1, 3, False),
            (2, 1, True), (2, 2, False), (2, 3, True), (2, 4, True), (2, 5, False)]
    return spark.createDataFrame([(r, i, c, "g", "p") for r, i, c in rows],
                                 "run int, idx long, correct boolean, ground_truth string, predicted string")


def test_flips_count_a_missing_base(scored):
    r = R.flips_vs_base(R.pair_with_base(scored, 1)).first()
    # flips 2, 3, 4, 5; positive 3, 4; negative 2 only
    assert (r.flips, r.positive_flips, r.negative_flips, r.n) == (4, 2, 1, 5)


def test_flip_table_takes_a_missing_base_as_wrong(spark, scored):
    config = spark.createDataFrame([(2, 1.2)], "run int, factor double")
    rows = {r.idx: r for r in R.flip_table(scored, 1, config).collect()}
    assert sorted(rows) == [2, 3, 4] and rows[4].base_correct is False and rows[4].factor == 1.2


def test_flip_overlap_ids(spark, scored):
    paired = R.pair_with_base(scored.unionByName(scored.where("run = 2 and idx in (2, 4)").withColumn("run", F.lit(3))), 1)
    sides = {r.idx: r.side for r in R.flip_overlap_ids(paired, [2], [3]).collect()}
    assert sides == {2: "both", 4: "both", 3: "a_only", 5: "a_only"}
    n = R.flip_overlap(paired, [2], [3]).first()
    assert (n.n_a, n.n_b, n.n_both, n.n_union, n.n_a_only, n.n_b_only, n.jaccard) == (4, 2, 2, 4, 2, 0, 0.5)


def test_random_band_by_factor(spark):
    acc = {1: .5, 2: .6, 3: .7, 11: .1, 12: .2, 13: .3, 21: .4, 22: .4, 23: .7, 31: .9}
    metrics = spark.createDataFrame([(r, a) for r, a in acc.items()], "run int, accuracy double")
    arms = {1: ("base", None), 2: ("pivotal", 1.2), 3: ("pivotal", 1.4), 31: ("pivotal", 9.0)}
    config = spark.createDataFrame([(r, *arms.get(r, ("random", 1.2 if r < 20 else 1.4))) for r in acc],
                                   "run int, arm string, factor double")
    rows = {r.factor: r for r in R.random_null_summary(metrics, config, 1).collect()}
    assert rows[1.2].random_mean == pytest.approx(.2) and rows[1.4].random_mean == pytest.approx(.5)
    assert rows[1.2].random_std == pytest.approx((2 / 300) ** .5) and rows[1.2].n_random == 3
    assert rows[1.2].random_accs == "100000,200000,300000" and rows[1.4].random_accs == "400000,400000,700000"
    assert rows[1.4].pivotal_vs_random_mean_pp == pytest.approx(20) and rows[1.2].base_acc == .5
    assert rows[9.0].random_mean is None


def test_top_tokens_are_picked_before_small_ones_are_skipped(spark):
    rows = [("one", 9.0), *[("a", v) for v in (1.0, 2.0, 3.0)], *[("b", v) for v in (1.0, 1.0)], ("c", .5), ("c", .5)]
    df = spark.createDataFrame(rows, "t string, v double")
    top = TS.top_tokens_by_median(df, "t", "v", 3)
    assert [(r.t, r.median) for r in top.orderBy("rank").collect()] == [("one", 9.0), ("a", 2.0), ("b", 1.0)]
