"""Hand-made rows for the semantics that are easy to get wrong
and the reference's own test cases (answer parsing, layer selection,
metrics), plus the published confusion matrices as a golden test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pivotspark.functions import text as T
from pivotspark.functions import vec
from pivotspark.operators import gating as G
from pivotspark.operators import labels as L
from pivotspark.operators import probes as P
from pivotspark.operators import sampling as S
from pivotspark.operators import vectors as V

EXTRACT = [("#### 42", "42"), ("He has #### 1,234 apples.", "1234"), ("The net change is #### -7", "-7"),
           ("So the answer is #### 3.50", "3.50"), ("...so the total is 18 apples.", "18"),
           ("Jane has 5. Final: #### 5", "5"), ("", None), ("1,234 left", "234"), ("5-3", "-3"),
           ("#### +5", "+5")]
EQUAL = [("3.0", "3", True), ("1234", "1,234", True), (None, "5", False), ("5", None, False),
         ("4", "5", False), (" 12 ", "12", True)]


def test_extract_answer(spark):
    df = spark.createDataFrame(EXTRACT, "t string, want string")
    got = df.select("want", T.extract_answer("t").alias("got")).collect()
    assert [(r.want, r.got) for r in got] == [(w, w) for _, w in EXTRACT]


def test_is_correct(spark):
    df = spark.createDataFrame(EQUAL, "p string, g string, want boolean")
    got = df.select("want", T.is_correct("p", "g").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_layer_selection(spark):
    a = spark.createDataFrame([(i,) for i in range(5)], "layer int")
    sel = S.select_layers(spark, a, explicit=[3, 1, 8], num_layers=2).orderBy("sel_ord").collect()
    assert [r.layer for r in sel] == [3, 1]
    b = spark.createDataFrame([(5,), (1,), (9,), (2,)], "layer int")
    sel = S.select_layers(spark, b, explicit=[], num_layers=2).orderBy("sel_ord").collect()
    assert [r.layer for r in sel] == [1, 2]


def test_metrics_four_rows(spark):
    df = spark.createDataFrame([(0, .1), (0, .8), (1, .7), (1, .2)], "label int, prob double") \
        .withColumn("layer", F.lit(0))
    m = P.binary_metrics(df).collect()[0]
    assert m.confusion_matrix == [[1, 1], [1, 1]]
    assert 0 <= m.accuracy <= 1 and 0 <= m.f1_score <= 1


# Published confusion matrices [[TN, FP], [FN, TP]] and their accuracy / F1.
GOLDEN = [([[51, 14], [22, 43]], 72.3077, 0.7049), ([[49, 16], [20, 45]], 72.3077, 0.7143),
          ([[51, 14], [21, 44]], 73.0769, 0.7154), ([[52, 13], [20, 45]], 74.6154, 0.7317),
          ([[45, 20], [19, 46]], 70.0000, 0.7023), ([[52, 13], [24, 41]], 71.5385, 0.6891)]


def test_golden_confusion_matrices(spark):
    rows = [(i, c[0][0], c[0][1], c[1][0], c[1][1]) for i, (c, _, _) in enumerate(GOLDEN)]
    cm = spark.createDataFrame(rows, "layer int, TN long, FP long, FN long, TP long")
    got = {r.layer: r for r in P.metrics_from_counts(cm).collect()}
    for i, (_, acc, f1) in enumerate(GOLDEN):
        assert abs(got[i].accuracy * 100 - acc) < 1e-4
        assert abs(got[i].f1_score - f1) < 1e-4


def test_fp_fn_ratio(spark):
    cm = spark.createDataFrame([(0, 5, 3, 0, 2), (1, 5, 0, 0, 2), (2, 5, 3, 2, 2)],
                               "layer int, TN long, FP long, FN long, TP long")
    got = {r.layer: r for r in P.metrics_from_counts(cm).collect()}
    assert got[0].fp_fn_ratio is None and got[0].fp_fn_inf
    assert got[1].fp_fn_ratio == 0.0 and not got[1].fp_fn_inf
    assert got[2].fp_fn_ratio == 1.5


def test_auroc_ties_and_single_class(spark):
    rows = [(0, 1, .9), (0, 0, .9), (0, 1, .5), (0, 0, .1), (1, 1, .3), (1, 1, .4)]
    df = spark.createDataFrame(rows, "layer int, label int, prob double")
    got = {r.layer: r.auroc_score for r in P.auroc(df).collect()}
    pos, neg = [.9, .5], [.9, .1]
    brute = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])
    assert abs(got[0] - brute) < 1e-12
    assert got[1] is None


def test_bround_negatives(spark):
    assert spark.range(1).select(F.bround(F.lit(2.5)).cast("int")).first()[0] == 2


def test_labels_longest_and_prefix(spark):
    rows = [("q", "a b", "a", " b", 0), ("q", "a b", "a b c", " d", 1), ("q", "a b", "x y", " z", 2),
            ("q", "a b", "a b c", " d", 3)]
    df = spark.createDataFrame(rows, "dataset_item_id string, query string, pivot_context string, "
                                     "pivot_token string, row_ord long")
    p = L.build_probe_rows(df, add_random_tokens=0).collect()[0]
    # longest text 'a b c d' (4 tokens) -> 2; prefix 'a b' -> 0; the duplicate
    # of the longest row (not the chosen one) -> 2; divergent 'x y z' -> none
    assert p.pivots == [0, 2]
    assert p.labels[0] == 1 and p.labels[2] == 1
    # candidates [0, 4) minus pivots = {1, 3}; wanted max(1, round(2 * 2)) = 4 -> both
    assert [i for i, x in enumerate(p.labels) if x == -1] == [1, 3]


def test_separability_closed_form_equals_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(0, int(i % 2), rng.normal(size=5).tolist()) for i in range(30)] + [(0, 0, [0.0] * 5)]
    df = spark.createDataFrame(rows, "layer int, label int, activation array<double>")
    got = V.separability(df).collect()[0]
    x = np.array([r[2] for r in rows]); y = np.array([r[1] for r in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True); n[n == 0] = 1
    u = x / n; sim = u @ u.T
    iu = np.triu_indices(len(y), 1)
    pp = [(sim[i, j]) for i, j in zip(*iu) if y[i] == 1 and y[j] == 1]
    nn = [(sim[i, j]) for i, j in zip(*iu) if y[i] == 0 and y[j] == 0]
    inter = sim[np.ix_(y == 1, y == 0)].ravel()
    assert abs(got.mean_intra_pivotal - np.mean(pp)) < 1e-9
    assert abs(got.mean_intra_nonpivotal - np.mean(nn)) < 1e-9
    assert abs(got.mean_inter - np.mean(inter)) < 1e-9


def test_projection_identity_and_ablation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 1.0, 1.0])], "h array<double>, v array<double>")
    r = df.select(V.steer("h", "v", 1.0, "projection").alias("same"),
                  V.steer("h", "v", 0.0, "projection").alias("abl"), vec.unit("v").alias("vh")).first()
    assert np.allclose(r.same, [1, 2, 3])
    assert abs(np.dot(r.abl, r.vh)) < 1e-6
    with pytest.raises(ValueError):
        V.steer("h", "v", 1.0, "nope")


def _sequential_latch(fires, n_hold):
    latch, out = 0, []
    for f in fires:
        if f:
            latch, held = n_hold, False
        elif latch > 0:
            latch, held = latch - 1, True
        else:
            held = False
        out.append((f or held, held, latch))
    return out


def test_latch_equals_sequential_loop_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    fires = (rng.random(400) < 0.15).tolist()
    # a prefill pass before the first decision and before every fifth one
    rows, step = [], 0
    for i, f in enumerate(fires):
        if i % 5 == 0:
            step += 1
            rows.append((7, step, "prefill", False))
        step += 1
        rows.append((7, step, "decode", bool(f)))
    df = spark.createDataFrame(rows, "run long, step long, phase string, probe_fire boolean")
    idx = G.decision_index(df, block=16)
    assert [r.decision_idx for r in idx.orderBy("step").collect()] == list(range(400))
    got = G.hysteresis_latch(idx, n_hold=2, block=16).orderBy("step").collect()
    want = _sequential_latch(fires, 2)
    assert [(r.fired, r.held, r.latch_remaining) for r in got] == want


def test_hash_split_sizes(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    s = S.split_by_key(df, "k", 42, 0.2)
    assert s.where(F.col("split") == "test").count() == math.ceil(0.2 * 1003)
    assert S.sample_examples(df, 10, key="k").count() == 10
    assert S.sample_examples(df, 5000, key="k").count() == 1003


def test_topk_salting_is_exact(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 10007).alias("v"))
    a = S.topk_per_group(df, ["g"], [F.col("v").desc()], 5, salt_buckets=16).orderBy("g", "rank").collect()
    b = S.topk_per_group(df, ["g"], [F.col("v").desc()], 5, salt_buckets=0).orderBy("g", "rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_exact_quantiles_match_numpy(spark):
    from pivotspark.operators.ranking import exact_quantiles
    rng = np.random.default_rng(5)
    vals = np.round(rng.normal(size=997), 3)  # with ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = df.select(exact_quantiles(df, "x", (0.25, 0.5, 0.75, 0.0, 1.0))).first()[0]
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75, 0.0, 1.0]))


def test_exact_group_quantile_hot_group(spark):
    from pivotspark.operators.ranking import exact_group_quantile
    rng = np.random.default_rng(9)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=3000), 2)] + \
           [("a", 1.0), ("a", 4.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.quantile for r in exact_group_quantile(df, ["g"], "x", 0.5).collect()}
    hot = [v for k, v in rows if k == "hot"]
    assert abs(got["hot"] - float(np.median(hot))) < 1e-12
    assert got["a"] == 2.5 and got["b"] == 2.0


def test_refractory_gate_equals_loop(spark):
    from pivotspark.operators.extensions import refractory_gate
    rng = np.random.default_rng(11)
    probs = rng.random(300).tolist()
    df = spark.createDataFrame([(3, i + 2, p) for i, p in enumerate(probs)], "run long, step long, prob double")
    got = [r.accepted for r in refractory_gate(df, k=3, threshold=0.5, block=8).orderBy("step").collect()]
    lock, want = -1, []
    for i, p in enumerate(probs):
        s = i + 2
        ok = p > 0.5 and s > lock
        if ok:
            lock = s + 3
        want.append(ok)
    assert got == want


def test_global_rank_equals_row_number(spark):
    from pyspark.sql import Window
    from pivotspark.operators.ranking import global_rank, group_rank
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 1013).alias("v"), F.col("id"), (F.col("id") % 3).alias("g"))
    a = global_rank(df, [F.col("v"), F.col("id")], ranges=32).select("id", "rank")
    b = df.select("id", (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("rank"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    c = group_rank(df, ["g"], [F.col("v"), F.col("id")], ranges=8).select("id", "rank")
    d = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1).alias("rank"))
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, d.collect()))


def test_ranks_and_quantiles_of_hot_values_and_groups(spark):
    """One group with over a third of the rows, one value with a third of that
    group's, groups of one row, null groups, descending order, weights."""
    from pivotspark.operators import ranking as K
    rng = np.random.default_rng(4)
    rows = [("hot", 0.5)] * 1500 + [("hot", float(v)) for v in rng.normal(size=2500).round(3)]
    rows += [(f"g{i % 700}", float(v)) for i, v in enumerate(rng.normal(size=3000).round(2))]
    rows += [(None, float(v)) for v in rng.integers(0, 9, 300)] + [("inf", float("inf")), ("inf", 1.0), ("inf", float("inf"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, x double")
    by = {}
    for i, (g, x) in enumerate(rows):
        by.setdefault(g, []).append((-x, i))
    want = {i: k for own in by.values() for k, (_, i) in enumerate(sorted(own))}
    for ranges in (1, 7, 40):
        got = K.group_rank(df, ["g"], [F.col("x").desc(), F.col("id")], ranges=ranges, rank_col="r").collect()
        assert {r.id: r.r for r in got} == want
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    hot = [x for g, x in rows if g == "hot"]
    assert np.allclose(df.where("g = 'hot'").select(K.exact_quantiles(df.where("g = 'hot'"), "x", qs)).first()[0], np.quantile(hot, qs))
    medians = {r.g: r.quantile for r in K.exact_group_quantile(df, ["g"], "x", 0.3).collect()}
    assert medians.keys() == by.keys()
    assert all(medians[g] == pytest.approx(np.quantile([-x for x, _ in by[g]], 0.3)) for g in by if g != "inf")
    assert np.isinf(medians["inf"])
    weighted = df.groupBy("g", "x").agg(F.count("*").alias("c"))
    got = {(r.g, r.x): r.r for r in K.group_rank(weighted, ["g"], [F.col("x")], ranges=9, rank_col="r", weight="c").collect()}
    assert all(got[g, x] == sum(-y < x for y, _ in by[g]) for g, x in set(rows[:4000:13]))


def test_ranks_of_empty_and_single(spark):
    from pivotspark.operators import ranking as K
    df = spark.range(1).select(F.lit(1).alias("g"), F.lit(2.5).alias("x"))
    assert K.global_rank(df, [F.col("x")]).first()["rank"] == 0
    assert K.exact_group_quantile(df, ["g"], "x").first().quantile == 2.5
    assert K.global_rank(df.limit(0), [F.col("x")]).count() == 0
    assert K.exact_group_quantile(df.limit(0), ["g"], "x").count() == 0


def test_a_hot_group_is_ranked_in_many_partitions(spark):
    """The rows of one group with all rows lie evenly over the partitions, and
    nothing but small tables is broadcast."""
    from pivotspark.operators import ranking as K
    df = spark.range(20000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 20011).alias("v"))
    placed, met = K._ranged(df, ["g"], [F.col("v")], 16, None)
    sizes = [r["count"] for r in placed.groupBy("_pid").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 20000 / 16
    assert met.count() == len(sizes)
