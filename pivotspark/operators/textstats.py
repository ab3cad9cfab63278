"""Word statistics of run outputs and corpus summaries.

Word counting is the classic distributed word count: explode tokens, then
``groupBy(run, word).count()`` with map-side combining.  Rates, log ratios
and top-n lists are grouped aggregates and per-group ranked windows over the
(much smaller) vocabulary table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import topk_per_group

# Stopwords dropped before counting (must match the reference).
STOPWORDS_TEXT = ("the a an of in to for and or is are was were be been being this that these those on "
                  "at by with as it its i me my we our you your he she they them their what which who whom "
                  "how why when where than then so if but not no yes do does did done have has had ll ve re "
                  "d s t m")
STOPWORDS = tuple(STOPWORDS_TEXT.split())
# ASCII punctuation (Python's string.punctuation), each replaced by a space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCT_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"


def words(text_col: str = "text"):
    """lower -> punctuation to space -> split on whitespace -> drop empty,
    digit-only and stopword tokens (array column).  White space and digits
    are those of Unicode."""
    cleaned = F.regexp_replace(F.lower(F.col(text_col)), PUNCT_CLASS, " ")
    toks = F.split(cleaned, r"(?U)[\s\x1c-\x1f]+")
    return F.filter(toks, lambda t: (t != "") & ~t.rlike(r"^\p{Nd}+$") & ~t.isin(*STOPWORDS))


def token_counts(texts: DataFrame, group_cols: Sequence[str] = ("run",), text_col: str = "text") -> DataFrame:
    g = list(group_cols)
    return (texts.select(*g, F.explode(words(text_col)).alias("word"))
            .groupBy(*g, "word").agg(F.count(F.lit(1)).alias("n")))


def word_log_ratios(counts: DataFrame, task_cols: Sequence[str] = (), base: str = "base",
                    steered: str = "steered", min_rate: float = 5.0) -> DataFrame:
    """Per word: per-million rates fb, fs (of each side's total), kept when
    fb + fs >= min_rate, and log_ratio = ln((fs + 1) / (fb + 1))."""
    t = list(task_cols)
    totals = counts.groupBy(*t, "run").agg(F.sum("n").alias("_tot"))
    c = counts.join(totals, t + ["run"])
    c = c.withColumn("_rate", F.col("n") / F.greatest(F.col("_tot"), F.lit(1)) * 1e6)
    wide = c.groupBy(*t, "word").agg(
        F.coalesce(F.sum(F.when(F.col("run") == base, F.col("_rate"))), F.lit(0.0)).alias("freq_base"),
        F.coalesce(F.sum(F.when(F.col("run") == steered, F.col("_rate"))), F.lit(0.0)).alias("freq_steered"))
    wide = wide.where(F.col("freq_base") + F.col("freq_steered") >= min_rate)
    return wide.withColumn("log_ratio", F.log((F.col("freq_steered") + 1) / (F.col("freq_base") + 1)))


def promoted_suppressed(ratios: DataFrame, task_cols: Sequence[str] = (), top_n: int = 20) -> DataFrame:
    """Top-n promoted (highest log ratio) and suppressed (lowest) words per
    task, ties by word."""
    t = list(task_cols) or ["_all"]
    r = ratios if task_cols else ratios.withColumn("_all", F.lit(1))
    up = topk_per_group(r, t, [F.col("log_ratio").desc(), F.col("word")], top_n).withColumn(
        "direction", F.lit("promoted"))
    down = topk_per_group(r, t, [F.col("log_ratio").asc(), F.col("word")], top_n).withColumn(
        "direction", F.lit("suppressed"))
    out = up.unionByName(down)
    return out.drop("_all") if not task_cols else out


def delta_histogram(df: DataFrame, value_col: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed): one scalar
    subquery for the range, then a grouped count."""
    rng = df.agg(F.min(value_col).alias("lo"), F.max(value_col).alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value_col) - lo) / width), F.lit(bins - 1))).cast("int")
    h = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select("bin", (lo + F.col("bin") * width).alias("left"),
                    (lo + (F.col("bin") + 1) * width).alias("right"), "count")


def top_tokens_by_median(df: DataFrame, token_col: str, value_col: str, k: int) -> DataFrame:
    """The k tokens of the largest exact median of ``value_col`` (ties by
    token): token, median, rank."""
    from .ranking import exact_group_quantile
    m = exact_group_quantile(df, [token_col], value_col, 0.5, "median").withColumn("_all", F.lit(1))
    return topk_per_group(m, ["_all"], [F.col("median").desc(), F.col(token_col)], k).drop("_all")


def task_vectors(corpus: DataFrame, vec_col: str = "steering_vector") -> DataFrame:
    """(task, group, arm, dim, value, norm) of the eight grouping tasks.
    Each row is exploded once into the groups it belongs to."""
    from .ranking import exact_quantiles
    from .vectors import centroid_long, explode_dims
    pick = lambda task, group, when=None: F.struct(
        F.lit(task).alias("task"), (group if when is None else F.when(when, group)).alias("group"))
    sizes = corpus.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    big = topk_per_group(sizes, ["_all"], [F.col("n").desc(), F.col("cluster_id")], 5, "rk").select("cluster_id", "rk")
    n = corpus.groupBy("pivot_token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    tokens = top_tokens_by_median(corpus.where(F.col("prob_delta") > 0), "pivot_token", "prob_delta", 3).join(n, "pivot_token")
    q = exact_quantiles(corpus, "abs_delta", (0.25, 0.75))
    # five clusters and three tokens at most
    rows = (corpus.withColumn("_q", q).join(F.broadcast(big), "cluster_id", "left")
            .join(F.broadcast(tokens.select("pivot_token", F.lit(True).alias("_targeted"))), "pivot_token", "left"))
    named = F.concat(F.lit("c"), F.col("cluster_id").cast("string"))
    groups = F.array(
        pick("all", F.lit("all")), pick("sign", F.lit("pos"), F.col("prob_delta") > 0), pick("sign", F.lit("neg"), F.col("prob_delta") < 0),
        pick("magnitude", F.lit("high"), F.col("abs_delta") >= F.col("_q")[1]),
        pick("magnitude", F.lit("low"), F.col("abs_delta") <= F.col("_q")[0]), pick("pattern", F.col("reasoning_pattern")),
        pick("cluster_vs_raw", named, F.col("rk") == 1), pick("token_targeted", F.col("pivot_token"), F.col("_targeted")))
    g = rows.select("row_id", vec_col, "abs_delta", F.explode(F.filter(groups, lambda x: x["group"].isNotNull())).alias("g")).select(
        "row_id", vec_col, "abs_delta", "g.task", "g.group")
    keys = ["task", "group"]
    mean = centroid_long(g, keys, vec_col)
    ref = mean.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("ref"))
    arms = mean.select(*keys, F.lit("mean").alias("arm"), "dim", "value")

    top = topk_per_group(g.where(F.col("task") != "all"), keys, [F.col("abs_delta").desc(), F.col("row_id")], 2, "rk")
    top = top.withColumn("arm", F.explode(F.when(F.col("task") == "cluster_vs_raw", F.array(F.lit("top2")))
                                          .when(F.col("rk") == 1, F.array(F.lit("top1"), F.lit("top2")))
                                          .otherwise(F.array(F.lit("top2")))))
    sums = explode_dims(top, vec_col, [*keys, "arm"]).groupBy(*keys, "arm", "dim").agg(F.sum("x").alias("value"))
    own = sums.groupBy(*keys, "arm").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("own"))
    scaled = sums.join(own, [*keys, "arm"]).join(ref, keys).withColumn(
        "value", F.when(F.col("own") > 1e-8, F.col("value") * F.col("ref") / F.col("own")).otherwise(F.col("value")))

    cluster = centroid_long(corpus.join(F.broadcast(big), "cluster_id"), ["cluster_id", "rk"], vec_col)
    cluster = cluster.withColumn("task", F.explode(F.when(F.col("rk") == 1, F.array(F.lit("cluster"), F.lit("cluster_vs_raw")))
                                                   .otherwise(F.array(F.lit("cluster")))))
    x = corpus.select("prob_delta", F.posexplode(vec_col).alias("dim", "x"))
    weighted = x.groupBy("dim").agg(
        F.sum(F.col("prob_delta") * F.col("x")).alias("s"), F.sum(F.abs("prob_delta") * F.col("x")).alias("a"),
        F.greatest(F.lit(1e-8), F.sum(F.abs("prob_delta"))).alias("w"))
    weighted = weighted.select("dim", F.explode(F.array(
        F.struct(F.lit("weighted_mean_signed").alias("arm"), (F.col("s") / F.col("w")).alias("value")),
        F.struct(F.lit("weighted_mean_abs").alias("arm"), (F.col("a") / F.col("w")).alias("value")))).alias("z"))
    cols = [*keys, "arm", "dim", "value"]
    out = (arms.unionByName(scaled.select(cols))
           .unionByName(cluster.select("task", named.alias("group"), F.lit("cluster_vector").alias("arm"), "dim", "value"))
           .unionByName(weighted.select(F.lit("weighted").alias("task"), F.lit("all").alias("group"), "z.arm", "dim", "z.value")))
    norm = out.groupBy(*keys, "arm").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    return out.join(norm, [*keys, "arm"])
