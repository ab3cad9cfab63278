"""Label construction: what the labels cover, and what doubling adds."""

from pyspark.sql import functions as F

from pivotspark.functions import text as T
from pivotspark.operators import labels as L
from pivotspark.plans import q_labels as Q
from pivotspark.sources import fixtures as X
from pivotspark.sources.sinks import new_path, read_split

from .conftest import SF_SMALL


def _labels(df):
    return {r[0]: r.labels for r in df.select("original_dataset_item_id", "labels").collect()}


def _negatives(labels):
    return sum(x.count(-1) for x in labels.values())


def test_labels_cover_the_appended_tokens(spark):
    p = Q.probe_rows(spark, SF_SMALL)
    n = p.select(F.size("labels").alias("l"), F.size("token_ids").alias("t"), F.size(T.whitespace_tokens(F.col("text"))).alias("w"),
                 F.size("tokens").alias("k")).collect()
    assert all(r.l == r.t == r.w == r.k + Q.K_RANDOM for r in n)


def test_truncation_in_some_rows_only(spark):
    r = L.truncation_audit(p := Q.probe_rows(spark, SF_SMALL), X.hidden_states(spark, SF_SMALL, p)).first()
    assert 0 < r.rate < 1


def test_doubling_keeps_the_length_and_adds_negatives(spark):
    before, after = _labels(Q.probe_rows(spark, SF_SMALL)), _labels(Q._doubled(spark, SF_SMALL, False))
    assert all(len(after[k]) == len(v) for k, v in before.items()) and _negatives(after) > _negatives(before)
    cut = {k: v[:max(len(v) - 3, 0)] for k, v in before.items()}
    assert _negatives(_labels(Q._doubled(spark, SF_SMALL, True))) > _negatives(cut)


def test_rows_without_negatives_are_untouched(spark):
    df = spark.createDataFrame([("a", "x y z w", [0, 1]), ("b", "x y z w", [-1, 1])],
                               "original_dataset_item_id string, text string, labels array<int>")
    for tail in (False, True):
        rows = {r[0]: r.labels for r in L.double_negatives(df, tail_only=tail).select("original_dataset_item_id", "labels").collect()}
        assert rows["a"] == [0, 1] and len(rows["b"]) == 4 and rows["b"].count(-1) == 2


def test_long_conversations_keep_their_order(spark, tmp_path):
    rows = [(c, t, "user", "w") for c in (1, 2) for t in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r[0], r[1]) for r in X.pivot_rows(spark, str(tmp_path)).select("row_ord", "dataset_item_id").collect()]
    assert len({o for o, _ in got}) == len(got) and [i for _, i in sorted(got)] == sorted(i for _, i in got)


def test_split_fallback(spark):
    path = new_path(spark, "split")
    for s in ("b", "train"):
        spark.createDataFrame([(s,)], "x string").withColumn("split", F.lit(s)).write.mode("append").partitionBy("split").parquet(path)
    assert [read_split(spark, path, s, "x string").first().x for s in ("b", "test")] == ["b", "train"]
    only = new_path(spark, "split")
    spark.createDataFrame([("c",)], "x string").withColumn("split", F.lit("c")).write.partitionBy("split").parquet(only)
    assert read_split(spark, only, "test", "x string").first().x == "c"


def _positions(rows, focused):
    """The rule, row by row."""
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == key]
        best = max((r for r in own if r[1] is not None), key=lambda r: (len(r[1]), -r[3]))
        text, hits = best[1] + best[2], set()
        words = lambda s: [w for w in s.split(" ") if w]
        for _, ctx, tok, order in own:
            if order == best[3]:
                hits |= {len(words(text)) - 2} if len(words(text)) > 1 else set()
            elif ctx is not None and text.startswith(ctx + tok) and len(words(ctx)) >= 1 + focused:
                hits.add(len(words(ctx)) - 1)
        out[key] = sorted(hits)
    return out


def test_positions_by_digests_equal_the_rule(spark):
    """Divergent, repeated and equal-length rows, letters of several bytes, the
    longest text split otherwise, nulls, and a row whose text is the longer
    one though its context is not."""
    import random
    rng, rows = random.Random(2), []
    for key in ("a", "b", "c", "é"):
        words = [rng.choice(["x", "yy", "żó", "漢字"]) for _ in range(60)]
        for i in range(200):
            n = rng.randrange(0, 60)
            mine = words[:n] if rng.random() < 0.7 else words[:n // 2] + ["z"] * (n - n // 2)
            rows.append((key, " ".join(mine), rng.choice([" ", ""]) + (words + ["q"])[n], i))
        rows += [(key, " ".join(words[:40]), " " + " ".join(words[40:]), 900), (key, None, " x", 901),
                 (key, " ".join(words[:58]), " " + words[58] + " tail", 902), (key, " ".join(words), "", 903),
                 (key, " ".join(words[:20]), " " + words[20], 904), (key, " ".join(words[:20]), " " + words[20], 904)]
    rows += [("one", "", " x", 0), ("two", "w", " x", 0), (None, "w", " x", 0)]
    df = spark.createDataFrame([(k, "query", c, t, o) for k, c, t, o in rows],
                               "dataset_item_id string, query string, pivot_context string, pivot_token string, row_ord long")
    for variant in ("default", "focused"):
        got = L.pivot_positions(df.repartition(5), variant=variant).collect()
        assert {r.dataset_item_id: r.pivots for r in got} == _positions(rows, variant == "focused")
    assert L.pivot_positions(df.where("false")).count() == 0
