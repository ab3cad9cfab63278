"""Second-wave operators described in the reference's notes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..session import ensure_checkpoint_dir
from .probes import negatives_below


def signed_labels(df: DataFrame, delta_col: str = "prob_delta", tau_pos: float = 0.1,
                  tau_neg: float = 0.1) -> DataFrame:
    """+1 above tau+, -1 below -tau-, the dead zone dropped."""
    d = F.col(delta_col)
    lab = F.when(d > tau_pos, F.lit(1)).when(d < -tau_neg, F.lit(-1))
    return df.withColumn("signed_label", lab).where(F.col("signed_label").isNotNull())


def cascade_gate(df: DataFrame, p1: str, p2: str, tau1: float = 0.5, tau_steer: float = 0.25,
                 alpha_max: float = 2.0) -> DataFrame:
    """p = p1 * (1 - p2); fire when p1 > tau1 and p > tau_steer; the
    strength is alpha_max * p."""
    p = F.col(p1) * (F.lit(1.0) - F.col(p2))
    return (df.withColumn("p_cascade", p)
            .withColumn("fire", (F.col(p1) > tau1) & (p > tau_steer))
            .withColumn("strength", F.when(F.col("fire"), F.lit(alpha_max) * p).otherwise(0.0)))


def _lock_after(steps: list[int], lock: int, k: int) -> int:
    """The lock after the sorted firing ``steps`` when steps up to ``lock``
    are locked."""
    for step in steps:
        if step > lock:
            lock = step + k
    return lock


def _in_parts(rows, schema: pa.Schema, size: int = 10_000):
    """Arrow batches of the tuples ``rows``."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _tuples(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def refractory_gate(steps: DataFrame, k: int = 3, threshold: float = 0.5, run_col: str = "run",
                    block: int = 4096) -> DataFrame:
    """I4: a fire is accepted only outside the lock; an accepted fire locks
    the next k steps.

    Each decision depends on the previous *accepted* fire, so runs are cut
    into blocks of ``block`` step numbers.  What a block does depends only on
    how many of its first steps are locked (0 to k): pass one tabulates the
    lock it hands on for each of these, the tables (k + 1 numbers a block)
    are composed along the run, and pass two replays each block from its
    lock.  No task holds a run's steps.  Only fires move; a task goes through
    its blocks in one sorted stream, so many short runs cost no more than few
    long ones."""
    assert k < block
    ensure_checkpoint_dir(steps.sparkSession)
    # Read three times below: written once, to the shared checkpoint folder.
    rows = steps.select(F.col(run_col).cast("long").alias("run"), F.col("step").cast("long").alias("step"),
                        F.col("prob").cast("double").alias("prob")).checkpoint()
    fire = F.coalesce((F.col("prob") > threshold) & ~F.isnan("prob"), F.lit(False))
    fires = rows.where(fire).withColumn("blk", F.floor(F.col("step") / block))
    in_blocks = lambda df: df.repartition("run", "blk").sortWithinPartitions("run", "blk", "step")

    def tabulate(batches):
        def tables():
            for (run, blk), own in groupby(_tuples(batches), key=lambda r: r[:2]):
                first, own = blk * block, [r[2] for r in own]
                # handed on: locked steps of the next block, by locked steps of this one
                yield run, blk, [max(0, _lock_after(own, first + s - 1, k) - (first + block) + 1) for s in range(k + 1)]
        yield from _in_parts(tables(), pa.schema([("run", pa.int64()), ("blk", pa.int64()), ("out", pa.list_(pa.int64()))]))

    def compose(batches):
        def starts():
            for _, own in groupby(_tuples(batches), key=lambda r: r[0]):
                locked, at = 0, None
                for run, blk, out in own:
                    if at is not None and blk != at + 1:  # blocks without a fire between
                        locked = max(0, locked - (blk - at - 1) * block)
                    if locked:
                        yield run, blk, locked
                    locked, at = out[min(locked, k)], blk
        yield from _in_parts(starts(), pa.schema([("run", pa.int64()), ("blk", pa.int64()), ("locked", pa.int64())]))

    def replay(batches):
        at, lock = None, 0
        for batch in batches:
            accepted = []
            for run, blk, step, locked in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (run, blk) != at:
                    at, lock = (run, blk), blk * block + locked - 1
                accepted.append(step > lock)
                if accepted[-1]:
                    lock = step + k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(accepted, pa.bool_())],
                                             names=["run", "step", "prob", "accepted"])

    tables = in_blocks(fires.select("run", "blk", "step")).mapInArrow(tabulate, "run long, blk long, out array<long>")
    starts = tables.repartition("run").sortWithinPartitions("run", "blk").mapInArrow(compose, "run long, blk long, locked long")
    starts = starts.withColumnsRenamed({"run": "_run", "blk": "_blk"})
    known = fires.join(starts, F.col("run").eqNullSafe(F.col("_run")) & (F.col("blk") == F.col("_blk")), "left")
    known = in_blocks(known.select("run", "blk", "step", F.coalesce("locked", F.lit(0).cast("long")).alias("locked"), "prob"))
    out = known.mapInArrow(replay, "run long, step long, prob double, accepted boolean")
    out = out.unionByName(rows.where(~fire).withColumn("accepted", F.lit(False)))
    return out.withColumnRenamed("run", run_col)


def threshold_at_fpr(scored: DataFrame, budget: float = 0.1, group_cols=("layer",), label_col: str = "label",
                     prob_col: str = "prob") -> DataFrame:
    """The smallest score threshold t (predict positive when score >= t)
    whose false-positive rate is within ``budget``."""
    g = list(group_cols)
    b = negatives_below(scored, g, label_col, prob_col)
    tot = b.groupBy(*g).agg(F.sum("n").alias("_n0"))
    b = b.join(tot, g).withColumn("fpr", (F.col("_n0") - F.col("_below")) / F.col("_n0"))
    return b.where(F.col("fpr") <= budget).groupBy(*g).agg(F.min("s").alias("threshold"),
                                                            F.min_by("fpr", "s").alias("fpr"))


def sparse_feature_projection(acts: DataFrame, decoder: DataFrame, row_col: str = "row_id") -> DataFrame:
    """sum_i w_i * decoder_i over a row's non-zero features, in long form
    (row, dim, value): join on feature, posexplode, grouped sum."""
    j = acts.where(F.col("weight") != 0).join(decoder, "feature")
    ex = j.select(row_col, "weight", F.posexplode("vector").alias("dim", "x"))
    return ex.groupBy(row_col, "dim").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("value"))


def feature_lift(long_df: DataFrame, group_cols: Sequence[str] = ("layer",), top_k: int = 5) -> DataFrame:
    """Mean feature activation at pivot vs non-pivot positions and the
    top-k features by lift (ties by feature)."""
    from .sampling import topk_per_group
    g = list(group_cols)
    m = long_df.groupBy(*g, F.col("dim").alias("feature")).agg(
        F.avg(F.when(F.col("label") == 1, F.col("x"))).alias("act_pivot"),
        F.avg(F.when(F.col("label") != 1, F.col("x"))).alias("act_nonpivot"))
    m = m.withColumn("lift", F.col("act_pivot") - F.col("act_nonpivot"))
    return topk_per_group(m, g, [F.col("lift").desc(), F.col("feature")], top_k, salt_buckets=0)


def feature_edit(v, amplify: dict[int, float] | None = None, clamp: dict[int, float] | None = None,
                 patch: Column | None = None, patch_dims: Sequence[int] = ()) -> Column:
    """I8: amplify (multiply), clamp (cap) selected features and patch others
    from a donor vector column (the donor is joined in beforehand)."""
    amplify, clamp = amplify or {}, clamp or {}
    pd_set = list(patch_dims)
    src = vec.to_double(v) if patch is None else F.arrays_zip(vec.to_double(v).alias("a"), patch.alias("b"))

    def f(x, i):
        val = x if patch is None else x["a"]
        out = val
        for d, c in amplify.items():
            out = F.when(i == d, val * F.lit(float(c))).otherwise(out)
        for d, c in clamp.items():
            out = F.when(i == d, F.least(val, F.lit(float(c)))).otherwise(out)
        if patch is not None and pd_set:
            out = F.when(i.isin(pd_set), x["b"]).otherwise(out)
        return out
    return F.transform(src, f)
