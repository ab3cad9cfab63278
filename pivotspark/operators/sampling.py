"""Projections, filters, sampling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import hord
from .ranking import exact_quantiles, first_k_by_hash

DEFAULT_SALT = 16


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in ([cs] if isinstance(cs, (str, Column)) else cs)]


# -- generic per-group top-k, salted so that a hot group is spread out ---------

def topk_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k,
                   rank_col: str = "rank", salt_buckets: int = DEFAULT_SALT,
                   salt_key: Column | None = None) -> DataFrame:
    """Rows ranked 1..k within each group by ``order_cols`` (which must end in
    a unique tie-break), plus their rank.

    Two stages: first the top k inside (group, salt) — so one group holding a
    third of the data is cut into ``salt_buckets`` tasks — then the top k of
    the at most salt_buckets*k survivors per group.  Exact, because the
    global top k is inside the union of the per-salt top k.
    ``k`` may be an int or a column (per-group k)."""
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    k_col = k if isinstance(k, Column) else F.lit(int(k))
    if salt_buckets and salt_buckets > 1:
        # deterministic salt (a re-run task puts every row in the same bucket)
        key = [F.col(f"`{c}`") for c in df.columns] if salt_key is None else [salt_key]
        salt = F.pmod(F.xxhash64(*key), F.lit(salt_buckets))
        staged = df.withColumn("_salt", salt)
        w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
        staged = staged.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k_col)
        staged = staged.drop("_salt", "_r1")
    else:
        staged = df
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return staged.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k_col)


# -- B1 ------------------------------------------------------------------------

def split_by_key(df: DataFrame, key: str, seed=42, test_size: float = 0.2,
                 split_col: str = "split") -> DataFrame:
    """Group-safe train/test split: the first ceil(test_size * n_distinct)
    keys in seeded-hash order are ``test``; every row of a key follows it.
    No per-id membership list is built or broadcast."""
    is_test = first_k_by_hash(df, key, seed, lambda n: F.ceil(F.lit(float(test_size)) * n))
    return df.withColumn(split_col, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


# -- B2 ------------------------------------------------------------------------

def select_layers(spark, available: DataFrame, explicit: Sequence[int] | None = None,
                  num_layers: int | None = None, layer_col: str = "layer") -> DataFrame:
    """(layer, sel_ord): explicit order wins (unknown layers dropped); an
    empty explicit list falls through to the first ``num_layers`` of the
    sorted available layers; neither -> all, sorted."""
    avail = available.select(F.col(layer_col).cast("int").alias("layer")).distinct()
    if explicit:
        wanted = spark.createDataFrame([(int(v), i) for i, v in enumerate(explicit)],
                                       "layer int, sel_ord int")
        out = wanted.join(avail, "layer", "left_semi")
    else:
        # the distinct layer set is tiny (tens of rows), so one ordered
        # window over it is bounded
        ranked = avail.withColumn("sel_ord", (F.row_number().over(Window.orderBy("layer")) - 1).cast("int"))
        out = ranked if num_layers is None else ranked.where(F.col("sel_ord") < max(0, int(num_layers)))
    return out.select("layer", "sel_ord")


def common_layers(a: DataFrame, b: DataFrame, layer_col: str = "layer") -> DataFrame:
    """Layers present in both inputs (train ∩ test)."""
    return a.select(layer_col).distinct().intersect(b.select(layer_col).distinct())


# -- B3 ------------------------------------------------------------------------

def cap_per_class(df: DataFrame, group_cols: Sequence[str], key: str, k: int, seed=42) -> DataFrame:
    """At most ``k`` rows per group (e.g. layer x label) without replacement,
    chosen by seeded hash of ``key``."""
    h = hord(seed, key)
    return topk_per_group(df.withColumn("_h", h), group_cols, [F.col("_h"), F.col(key)], k,
                          rank_col="_rk").drop("_h", "_rk")


# -- B4 ------------------------------------------------------------------------

def sample_examples(df: DataFrame, k: int, seed=42, key: str = "idx") -> DataFrame:
    """min(k, n) rows without replacement by seeded hash of ``key``; exact and
    distributed (no global sort, nothing collected)."""
    return df.where(first_k_by_hash(df, key, seed, int(k)))


# -- B5 ------------------------------------------------------------------------

def first_k_groups(df: DataFrame, key: str, order_col: str, k: int) -> DataFrame:
    """Rows of the first k distinct keys by first appearance."""
    firsts = df.groupBy(key).agg(F.min(order_col).alias("_first"))
    chosen = firsts.orderBy("_first", key).limit(int(k)).select(key)   # k is the feature
    return df.join(F.broadcast(chosen), key, "left_semi")


# -- B7 / B8 / B9 --------------------------------------------------------------

def sign_groups(df: DataFrame, value_col: str) -> DataFrame:
    """'pos' for > 0, 'neg' for < 0; zero rows belong to neither."""
    v = F.col(value_col)
    return (df.withColumn("sign_group", F.when(v > 0, "pos").when(v < 0, "neg"))
            .where(F.col("sign_group").isNotNull()))


def quartile_groups(df: DataFrame, value_col: str) -> DataFrame:
    """'high' for value >= q75, 'low' for value <= q25 (linear interpolation).
    The two quantiles come from a ranked selection, not a global buffer."""
    q = exact_quantiles(df, value_col, (0.25, 0.75))  # distributed, exact
    v = F.col(value_col)
    high = df.where(v >= q.getItem(1)).withColumn("quartile_group", F.lit("high"))
    low = df.where(v <= q.getItem(0)).withColumn("quartile_group", F.lit("low"))
    return high.unionByName(low)


def min_group_size(df: DataFrame, group_col: str, min_rows: int = 40) -> DataFrame:
    """Rows of groups with at least ``min_rows`` rows (aggregate + join, so
    the count is combined map-side)."""
    big = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return df.join(big.select(group_col), group_col, "left_semi")


# -- B10 -----------------------------------------------------------------------

def pc1_outlier_filter(df: DataFrame, layer: int | Column = 14, bound: float | Column = -30.0,
                       pc_col: str = "pc1", layer_col: str = "layer") -> DataFrame:
    """Drop rows of one layer whose first component is below ``bound``; with
    columns for both, of every layer by its own bound."""
    return df.where((F.col(layer_col) != layer) | (F.col(pc_col) >= bound))


# -- B11 / B12 / B13 -----------------------------------------------------------

def clip_text(c, first: int | None = None, last: int | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if first is not None:
        return F.left(c, F.lit(first))
    return F.right(c, F.lit(last))


def build_prompt(df: DataFrame, question_col: str = "question") -> DataFrame:
    return df.withColumn("prompt", T.build_prompt(question_col))


def add_abs_delta(df: DataFrame, delta_col: str = "prob_delta", vector_col: str = "steering_vector") -> DataFrame:
    return (df.withColumn("abs_prob_delta", F.abs(F.col(delta_col)))
            .withColumn(vector_col, F.transform(vector_col, lambda x: x.cast("float"))))
