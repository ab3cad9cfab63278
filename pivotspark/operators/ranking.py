"""Exact ranks, quantiles and "first k rows in seeded-hash order" without a
global window.

Ranks and quantiles go by a range exchange (``_ranged``): the order is cut into
partitions, and one small row for each partition and group gives the offsets.
The rest is about the first k.

A global ``row_number()`` (no partition) moves every row into one task.  Here
the rank is found in three bounded steps instead:

1. every key gets ``h = hord(seed, key)`` and a bucket = the first hex digits
   of ``h``; bucket order follows hash order and, because the keys are
   distinct, buckets hold about n / 16**digits keys each (no skew possible);
2. per-bucket counts (at most 16**digits rows) give a running total, which
   names the boundary bucket and how many keys of it are still wanted;
3. only the boundary bucket is ranked.

The result is one threshold ``struct(_h, _k)`` as a scalar subquery; a row is
among the first k exactly when ``struct(hord, key) <= threshold``.  Nothing
is collected to the driver and the big table is never joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.keys import hord
from ..session import ensure_checkpoint_dir

DEFAULT_DIGITS = 4  # 65,536 buckets


def rank_key(seed, key) -> Column:
    """The ordering key the threshold is compared with."""
    k = F.col(key) if isinstance(key, str) else key
    return F.struct(hord(seed, k).alias("_h"), k.alias("_k"))


def hash_threshold(df: DataFrame, key: str, seed, k, digits: int = DEFAULT_DIGITS) -> Column:
    """Scalar column: the k-th smallest ``struct(hord(seed,key), key)`` over
    the distinct keys of ``df``; null when k <= 0.

    ``k`` may be an int or a function ``n_distinct_column -> k_column``.
    The whole computation is ONE scalar subquery: bucket counts, their
    running total (a window over at most 16**digits rows), the boundary
    bucket, and the rank inside that bucket only.
    """
    keys = df.select(F.col(key).alias("_k")).distinct()
    h = keys.select("_k", hord(seed, F.col("_k")).alias("_h"))
    h = h.withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    small = Window.partitionBy(F.lit(0))  # the bucket table: <= 16**digits rows
    c = (counts.withColumn("_cum", F.sum("_n").over(small.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_tot", F.sum("_n").over(small)))
    kk = k(F.col("_tot")) if callable(k) else F.lit(int(k))
    c = c.withColumn("_kk", F.least(kk, F.col("_tot")))  # k beyond n selects every key
    bnd = (c.where((F.col("_cum") >= F.col("_kk")) & (F.col("_cum") - F.col("_n") < F.col("_kk")))
           .select("_b", (F.col("_kk") - (F.col("_cum") - F.col("_n"))).alias("_r")))
    ranked = h.join(F.broadcast(bnd), "_b").withColumn(  # at most one bucket survives
        "_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_k")))
    return ranked.where(F.col("_rn") == F.col("_r")).select(F.struct("_h", "_k").alias("thr")).scalar()


def first_k_by_hash(df: DataFrame, key: str, seed, k, digits: int = DEFAULT_DIGITS) -> Column:
    """Boolean column: the row's key is among the first k distinct keys in
    seeded-hash order."""
    thr = hash_threshold(df, key, seed, k, digits)
    return F.coalesce(rank_key(seed, key) <= thr, F.lit(False))


def _weighted(batches, n_groups: int):
    """Adds to sorted batches of one partition (group columns first, weight
    last): the partition's number and the weight of the rows before, counted
    from the start of the row's group."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    last, carried = None, 0  # the group that may go on, and its weight so far
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        weight = np.asarray(batch.column(batch.num_columns - 1), dtype=np.int64)
        new = np.zeros(n, dtype=bool)
        for i in range(n_groups):
            codes = np.asarray(batch.column(i).dictionary_encode(null_encoding="encode").indices)
            new[1:] |= codes[1:] != codes[:-1]
        group = tuple(batch.column(i)[0].as_py() for i in range(n_groups))
        new[0] = group != last
        before = np.cumsum(weight) - weight
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        own = np.where(first >= 0, before - before[first], before + carried)
        carried = int(own[-1] + weight[-1])
        last = tuple(batch.column(i)[n - 1].as_py() for i in range(n_groups))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(own)],
                                         names=[*batch.schema.names, "_pid", "_own"])


def _ranged(df: DataFrame, g: list[str], order_cols, ranges: int | None, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of (group, order), each in one partition, with
    ``_pid`` and ``_own`` (the weight of the group's rows before it there),
    and one row for each group and partition that meet: ``_pid``, the group,
    its weight ``_n`` there, ``_off`` in the partitions before and ``_all``.

    The exchange cuts the order itself, so a group with any share of the rows
    lies over many partitions; rows that the order does not tell apart meet in
    one."""
    order = [*(F.col(c) for c in g), *order_cols]
    n = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0))
    names = df.columns
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], *names, n.alias("_w"))
    dealt = (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    schema = StructType([*dealt.schema.fields, StructField("_pid", IntegerType()), StructField("_own", LongType())])
    n_groups = len(g)
    # Read twice below: written once, to the shared checkpoint folder.
    ensure_checkpoint_dir(df.sparkSession)
    placed = dealt.mapInArrow(lambda batches: _weighted(batches, n_groups), schema).checkpoint()
    keys = [f"_g{i}" for i in range(n_groups)]
    met = placed.groupBy("_pid", *keys).agg(F.sum("_w").alias("_n"))
    whole = Window.partitionBy(*keys) if g else Window.partitionBy(F.lit(0))  # without groups: a row for each partition
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("_all"))
    return placed, met


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = a["_pid"] == b["_pid"]
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _rank(df: DataFrame, g: list[str], order_cols, ranges: int | None, rank_col: str, weight: str | None) -> DataFrame:
    placed, met = _ranged(df, g, order_cols, ranges, weight)
    keys = [f"_g{i}" for i in range(len(g))]
    # Bounded by the number of partitions: only a partition's first group can
    # have begun before it.
    off = met.where("_off > 0").select("_pid", *keys, "_off")
    out = placed.join(F.broadcast(off), _same(placed, off, keys), "left")
    return out.select(*[placed[c] for c in df.columns], (placed["_own"] + F.coalesce(off["_off"], F.lit(0))).alias(rank_col))


def global_rank(df: DataFrame, order_cols, ranges: int | None = None, rank_col: str = "rank",
                weight: str | None = None) -> DataFrame:
    """0-based global rank by ``order_cols`` without a single-task window: rows
    are exchanged by ranges of the order, numbered inside their partition, and
    get the count of the partitions before.  With ``weight`` a row counts that
    many times."""
    return _rank(df, [], order_cols, ranges, rank_col, weight)


def group_rank(df: DataFrame, group_cols, order_cols, ranges: int | None = None, rank_col: str = "rank",
               weight: str | None = None) -> DataFrame:
    """``global_rank`` inside each group; a group with a large share of the
    rows lies over many partitions."""
    return _rank(df, list(group_cols), order_cols, ranges, rank_col, weight)


def _quantiles(df: DataFrame, g: list[str], value_col: str, qs) -> DataFrame:
    """(group..., i, value): exact, linearly interpolated quantile of each
    ``qs[i]``.

    Equal values are counted first, so a value that a third of the rows share
    is one row.  The counts are ranged by (group, value); a quantile's two
    places floor/ceil(q (n - 1)) are found in the table of groups and
    partitions, and only the rows there are picked."""
    v = df.select(*g, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    placed, met = _ranged(v.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")), g, [F.col("_v")], None, "_c")
    keys = [f"_g{i}" for i in range(len(g))]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    places = met.select("*", F.inline(wanted)).withColumn("_p", F.col("q") * (F.col("_all") - 1))
    places = places.select("*", F.explode(F.array(F.floor("_p"), F.ceil("_p"))).alias("_at"))
    places = places.where((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_n")))
    places = places.select("_pid", *keys, "i", "_p", (F.col("_at") - F.col("_off")).alias("_at")).distinct()
    inside = (placed["_own"] <= places["_at"]) & (places["_at"] < placed["_own"] + placed["_w"])
    hits = placed.join(places, _same(placed, places, keys) & inside)
    per = hits.groupBy(*[placed[c] for c in g], "i", "_p").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # Equal neighbours as they are: infinite ones have no difference.
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_p") - F.floor("_p")) * (F.col("_hi") - F.col("_lo")))
    return per.select(*g, "i", value.alias("value"))


def exact_quantiles(df: DataFrame, value_col: str, qs) -> Column:
    """Scalar array column: exact linearly interpolated quantiles (the
    definition of ``percentile`` / numpy's default) of ``value_col``."""
    return _quantiles(df, [], value_col, qs).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("q")).scalar()


def exact_group_quantile(df: DataFrame, group_cols, value_col: str, q: float = 0.5,
                         out_col: str = "quantile") -> DataFrame:
    """(group..., quantile): exact, linearly interpolated per-group quantile
    (``median`` for q = 0.5) without buffering a whole group in one task."""
    return _quantiles(df, list(group_cols), value_col, (q,)).select(*group_cols, F.col("value").alias(out_col))
