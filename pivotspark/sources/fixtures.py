"""Input shapes of the pipeline, derived from the driver's tables.

Each function reads the given tables and derives one of the pipeline's
inputs with DataFrame operations, so its size grows with the data.  The same
derivations are written in DuckDB SQL in ``plans.oracle`` (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.keys import hord
from ..operators.sampling import split_by_key
from .tables import load

N_LAYERS = 4          # pseudo-layers cut out of each 64-d embedding
LAYER_WIDTH = 16
SPLIT_SEED = 42
TEST_SIZE = 0.2
# run -> steering factor of the generations fixture (run 1 is the base run)
RUN_FACTORS = {2: 1.2, 3: 1.4, 4: 1.6, 5: 2.0, 6: 0.0, 7: -1.0}
RANDOM_ARM_RUNS = (5, 6, 7)
# run -> (arm, factor) of the random-control experiment: two factors, two
# random directions each
CONTROL_RUNS = {1: ("base", None), 2: ("pivotal", 1.2), 3: ("pivotal", 1.4), 4: ("random", 1.2), 5: ("random", 1.2),
                6: ("random", 1.4), 7: ("random", 1.4)}


def _layers(n: int = N_LAYERS):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("layer")


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, layer, query_id, position, label, bucket, activation).

    layer L holds embedding[16L .. 16L+15]; label 1 iff embeddings.label < 5;
    split from the seeded key split of the ids."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = emb.select(F.col("vec_id").alias("query_id"), "embedding",
                      F.when(F.col("label") < 5, 1).otherwise(0).alias("label"), _layers())
    rows = rows.select(
        "query_id", F.col("layer").cast("int").alias("layer"), F.lit(0).alias("position"), "label",
        F.when(F.col("label") == 1, "pivotal").otherwise("non_pivotal").alias("bucket"),
        F.slice("embedding", F.col("layer") * LAYER_WIDTH + 1, LAYER_WIDTH).alias("activation"))
    return split_by_key(rows, "query_id", SPLIT_SEED, TEST_SIZE)


def activations_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``activations`` with 0.3 - 0.05*L added to dim 0 of positives, so that
    probes have a signal and layers differ in difficulty."""
    a = activations(spark, sf_dir)
    shift = (F.lit(0.3) - F.lit(0.05) * F.col("layer")).cast("float")
    shifted = F.transform("activation", lambda x, i: F.when((i == 0) & (F.col("label") == 1), x + shift)
                          .otherwise(x))
    return a.withColumn("activation", shifted)


PIVOT_SCHEMA = ("dataset_item_id string, query string, pivot_context string, pivot_token string, timestamp string, "
                "prob_delta double, row_ord long")
#: File order of a conversation's first row: room for half a million turns.
ORD_STEP = 1 << 20


def pivot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 raw pivot rows from ``conversations``.

    For turn t >= 1: context = turns 0..t-1 joined by one space, token = ' ' +
    turn t, query = turn 0.  Every third turn (t % 3 == 1) appears twice, to
    exercise de-duplication; ``row_ord`` is the file order."""
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = conv.select(
        F.col("conv_id").cast("string").alias("dataset_item_id"),
        F.first(F.when(F.col("turn") == 0, F.col("text")), ignorenulls=True).over(whole).alias("query"),
        F.array_join(F.collect_list("text").over(before), " ").alias("pivot_context"),
        F.concat(F.lit(" "), F.col("text")).alias("pivot_token"),
        F.col("turn").cast("string").alias("timestamp"),
        (((F.col("conv_id") * 7 + F.col("turn") * 13) % 21 - 10) / F.lit(20.0)).alias("prob_delta"),
        "conv_id", "turn",
    ).where(F.col("turn") >= 1)
    base = rows.withColumn("row_ord", F.col("conv_id") * ORD_STEP + F.col("turn") * 2)
    dups = rows.where(F.col("turn") % 3 == 1).withColumn(
        "row_ord", F.col("conv_id") * ORD_STEP + F.col("turn") * 2 + 1)
    return base.unionByName(dups).drop("conv_id", "turn")


def n_embeddings(spark: SparkSession, sf_dir: str):
    return load(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()


def hidden_states(spark: SparkSession, sf_dir: str, probe_rows: DataFrame) -> DataFrame:
    """Hidden states in long form: (id, layer, position, activation).

    Position p of probe row ``id`` (= conv_id) takes embedding
    vec_id = (token_ids[p] + p) % n, cut to the layer's 16 dims.  Rows with
    id % 7 == 0 get one state fewer than they have tokens (truncation)."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = n_embeddings(spark, sf_dir)
    row_id = F.col("original_dataset_item_id")
    kept = F.size("token_ids") - F.when(row_id.cast("long") % 7 == 0, 1).otherwise(0)
    pos = probe_rows.select(row_id.alias("id"), kept.alias("_kept"), F.posexplode_outer("token_ids").alias("position", "_token"))
    pos = pos.where(F.col("position") < F.col("_kept")).withColumn("vec_id", (F.col("_token") + F.col("position")) % n)
    joined = pos.join(emb, "vec_id")
    return joined.select("id", _layers(), "position", "embedding").select(
        "id", F.col("layer").cast("int").alias("layer"), "position",
        F.slice("embedding", F.col("layer") * LAYER_WIDTH + 1, LAYER_WIDTH).alias("activation"))


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 steering-vector corpus: every event, with the embedding of
    event_id mod n."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    rows = ev.withColumn("vec_id", F.col("event_id") % n_embeddings(spark, sf_dir)).join(emb, "vec_id").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("reasoning_pattern"),
        ((F.col("value") - 30) / 100).alias("prob_delta"),
        F.concat(F.lit("tok"), (F.col("user_id") % 17).cast("string")).alias("pivot_token"),
        F.col("embedding").alias("steering_vector"),
        F.col("label").alias("cluster_id"))
    return rows


def vector_corpus_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_corpus`` with ``cluster_vector``, the centroid of the row's
    cluster (for the operators that read it)."""
    from ..operators.vectors import centroid_arrays
    rows = vector_corpus(spark, sf_dir)
    cents = centroid_arrays(rows, ["cluster_id"], "steering_vector").withColumnRenamed(
        "centroid", "cluster_vector")
    return rows.join(cents, "cluster_id")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 generations: run = l_linenumber (1 = base), idx = l_orderkey.

    An order's lines are few, so they are brought together first: nothing is
    gained by sorting and combining them before, and runs are then paired by
    idx where they are."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_returnflag", "l_tax").repartition("l_orderkey")
    g = li.groupBy(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("run")).agg(
        F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"))
    ans = (F.col("q").cast("long") % 4).cast("string")
    out = (F.when(F.col("tax") == 0, F.lit(""))
           .when(F.col("flag") == "R", F.concat(F.lit("total is "), ans, F.lit(" units")))
           .otherwise(F.concat(F.lit("so #### "), ans)))
    return g.select(
        F.col("run").cast("int").alias("run"), F.col("idx").cast("long").alias("idx"),
        F.concat(F.lit("How many units are in order "), F.col("idx").cast("string"), F.lit("?"))
        .alias("question"),
        F.concat(F.lit("#### "), (F.col("idx") % 4).cast("string")).alias("answer"),
        out.alias("full_output"))


def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run -> (arm, factor) for the generations fixture, derived from the
    runs that exist in lineitem."""
    runs = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("run")).distinct()
    factor = F.lit(None).cast("double")
    for r, f in RUN_FACTORS.items():
        factor = F.when(F.col("run") == r, F.lit(f)).otherwise(factor)
    arm = (F.when(F.col("run") == 1, "base")
           .when(F.col("run").isin(*RANDOM_ARM_RUNS), "random")
           .otherwise("pivotal"))
    return runs.select("run", arm.alias("arm"), factor.alias("factor"))


def random_control_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run -> (arm, factor) of the random-control experiment: every pivotal
    factor has random arms of its own."""
    runs = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("run")).distinct()
    pick = lambda k, kind: F.coalesce(*[F.when(F.col("run") == r, F.lit(v[k]).cast(kind))
                                        for r, v in CONTROL_RUNS.items()])
    return runs.select("run", pick(0, "string").alias("arm"), pick(1, "double").alias("factor"))


def token_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, doc_id, text, task): all documents; those of even ids are the base
    run, the others the steered one."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return docs.select(F.when(F.col("doc_id") % 2 == 0, "base").otherwise("steered").alias("run"), "doc_id", "text",
                       F.col("source").alias("task"))


#: The gate probe's weights are this many times the difference of the class
#: means, its bias that of their midpoint less GATE_SHIFT.
GATE_GAIN, GATE_SHIFT = 100.0, 0.5
#: Every so many steps a run has another prefill pass (the first is step 1).
PREFILL_EVERY = 13
#: Scale of the gate's steering vector (normalised mode).
GATE_COEF = 0.5


def gate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: probe weights w and bias b, and the steering vector v (the
    centroid of label 0), from the embeddings."""
    from ..operators.vectors import explode_dims
    x = explode_dims(load(spark, sf_dir, "embeddings"), "embedding", ["label"])
    m = x.groupBy("dim").agg(F.avg(F.when(F.col("label") < 5, F.col("x"))).alias("p"),
                             F.avg(F.when(F.col("label") >= 5, F.col("x"))).alias("q"),
                             F.avg(F.when(F.col("label") == 0, F.col("x"))).alias("v"))
    gain = F.lit(GATE_GAIN)
    ordered = F.array_sort(F.collect_list(F.struct("dim", (gain * (F.col("p") - F.col("q"))).alias("w"), "v")))
    bias = -F.sum(gain * (F.col("p") - F.col("q")) * (F.col("p") + F.col("q")) / 2) - F.lit(GATE_SHIFT)
    return m.agg(ordered.alias("o"), bias.alias("b")).select(
        F.transform("o", lambda s: s["w"]).alias("w"), "b", F.transform("o", lambda s: s["v"]).alias("v"))


def gate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H input: run = user_id, steps ordered by (ts, event_id), of which the
    first and every 13th are prefill passes.  The step's residual is the
    embedding of event_id mod n; ``prob`` is the probe's probability for it,
    ``delta_norm`` the norm of the change that steering it makes."""
    from ..operators import gating as G
    from ..operators import vectors as V
    from ..operators.ranking import group_rank
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    # step number = rank of (ts, event_id) inside the run; one very long run is
    # not sorted in a single task
    ranked = group_rank(ev, ["user_id"], [F.col("ts"), F.col("event_id")], rank_col="_r")
    step = (F.col("_r") + 1).cast("long")
    steps = ranked.select(
        F.col("user_id").alias("run"), step.alias("step"), "event_id",
        F.when((step == 1) | (step % PREFILL_EVERY == 0), "prefill").otherwise("decode").alias("phase"))
    emb = load(spark, sf_dir, "embeddings").select("vec_id", vec.to_double(F.col("embedding")).alias("h"))
    probe = gate_probe(spark, sf_dir)
    w, b, v = (probe.select(c).scalar() for c in ("w", "b", "v"))
    # scalars of the probe travel as columns: lambdas must not capture them
    emb = emb.withColumn("_w", w).withColumn("_v", v)
    delta = vec.norm(vec.sub(V.steer("h", "_v", GATE_COEF, "additive_normalized"), "h"))
    # Both are of the residual alone: once for each, not for each of its steps.
    scored = emb.select("vec_id", G.probe_prob("h", "_w", b).alias("prob"), delta.alias("delta_norm"))
    return steps.withColumn("vec_id", F.col("event_id") % n_embeddings(spark, sf_dir)).join(scored, "vec_id").select(
        "run", "step", "event_id", "phase", "prob", "delta_norm")


def seeded_order(seed, *keys):
    return hord(seed, *keys)
