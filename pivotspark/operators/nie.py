"""Per-token causal effect (NIE) statistics.

The model forward passes are outside Spark; their outputs arrive as tables
of logits (or log-probabilities) per (row_id, position).  NIE is a join of
the base and steered tables on (row_id, position) and a difference of
log-softmax values; summaries are grouped aggregates.  The bootstrap is a
Poisson bootstrap with per-partition partial sums (one vectorised pass per
partition, B small rows shuffled per partition), so it never replicates the
data B times.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.keys import hord
from .ranking import exact_group_quantile


def nie_positions(probe: DataFrame, label_value: int = 1, max_positions_per_row: int | None = None,
                  id_col: str = "original_dataset_item_id", ids_col: str = "tokens",
                  max_rows: int | None = None) -> DataFrame:
    """(row_id, position, pivot_token): positions p < min(len(labels),
    len(ids)) - 1 whose label is ``label_value``; rows with <= 1 id are
    skipped; optionally the first k positions per row, and only the first
    ``max_rows`` rows by id."""
    if max_rows is not None:
        probe = probe.orderBy(id_col).limit(max_rows)
    usable = F.least(F.size("labels"), F.size(ids_col))
    e = probe.where(F.size(ids_col) > 1).select(
        F.col(id_col).alias("row_id"), ids_col, usable.alias("_u"),
        F.posexplode_outer("labels").alias("position", "label"))
    e = e.where((F.col("label") == label_value) & (F.col("position") < F.col("_u") - 1))
    if max_positions_per_row is not None:
        w = Window.partitionBy("row_id").orderBy("position")
        e = e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_positions_per_row)
    return e.select("row_id", "position", F.element_at(ids_col, F.col("position") + 2).alias("pivot_token"))


def token_nie(base: DataFrame, steered: DataFrame, keys: Sequence[str] = ("row_id", "position"),
              logits_col: str = "logits", token_col: str = "pivot_token_id") -> DataFrame:
    """log p_steered - log p_base of the pivot token at each (row, position);
    both tables hold logits arrays."""
    k = list(keys)
    b = base.select(*k, token_col, vec.log_softmax_at(logits_col, token_col).alias("log_p_base"))
    s = steered.select(*k, vec.log_softmax_at(logits_col, token_col).alias("log_p_steered"))
    return b.join(s, k).withColumn("nie", F.col("log_p_steered") - F.col("log_p_base"))


def nie_summary(samples: DataFrame, group_cols: Sequence[str] = (), n_rows=None) -> DataFrame:
    """n_rows (rows processed, given as a number or scalar column; those
    without a sample count too), rows with samples, n_positions, mean, std
    (ddof 1; 0.0 for one sample), exact median and the mean
    log-probabilities; null where there is no sample."""
    g = list(group_cols)
    if not g:
        samples = samples.withColumn("_all", F.lit(1))
    keys = g or ["_all"]
    rows = F.countDistinct("row_id")
    out = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_positions"), rows.alias("n_rows_with_samples"), F.avg("nie").alias("nie_mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("nie")).when(F.count(F.lit(1)) == 1, F.lit(0.0)).alias("nie_std"),
        F.avg("log_p_base").alias("log_p_base_mean"), F.avg("log_p_steered").alias("log_p_steered_mean"))
    out = out.join(exact_group_quantile(samples, keys, "nie", 0.5, "nie_median"), keys, "left")
    n = n_rows if isinstance(n_rows, Column) else F.col("n_rows_with_samples") if n_rows is None else F.lit(int(n_rows))
    return out.select(*g, n.alias("n_rows"), "n_rows_with_samples", "n_positions", "nie_mean", "nie_std", "nie_median",
                      "log_p_base_mean", "log_p_steered_mean")


# -- G4: Poisson bootstrap -------------------------------------------------------

#: Weights come from arithmetic modulo this prime: products fit 64 bits, so any
#: engine with md5 gets the same ones.
PRIME = (1 << 31) - 1
#: A value below the prime has the weight of how many of these it reaches:
#: P(Poisson(1) <= k) for k = 0..11.
POISSON_STEPS = [int(p * PRIME) for p in np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])]


def replicate_terms(n_boot: int, seed: int) -> np.ndarray:
    """Coefficients [4, n_boot] of each replicate's cubic, from the four words
    of md5 of ``seed|rep|replicate``."""
    digests = [hashlib.md5(f"{seed}|rep|{b}".encode()).hexdigest() for b in range(n_boot)]
    return np.array([[int(d[8 * i:8 * i + 8], 16) % PRIME for d in digests] for i in range(4)], dtype=np.uint64)


def poisson_weights(keys: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Poisson(1) weights [keys, replicates]: the cubic of a key, of which any
    four rows are independent, counted in ``POISSON_STEPS``."""
    p, k = np.uint64(PRIME), keys.astype(np.uint64)[:, None]
    u = np.broadcast_to(terms[3], (len(keys), terms.shape[1]))
    for term in terms[2::-1]:
        u = (u * k + term) % p
    return np.searchsorted(np.array(POISSON_STEPS, dtype=np.uint64), u, side="right").astype(np.float64)


def bootstrap_ci(samples: DataFrame, value_col: str = "nie", key_col: str = "_key",
                 group_cols: Sequence[str] = (), n_boot: int = 2000, alpha: float = 0.05,
                 seed: int = 42) -> DataFrame:
    """(group..., ci_lo, ci_hi, n): alpha/2 and 1 - alpha/2 quantiles of
    ``n_boot`` bootstrap means; null when a group has no sample.

    Every row gets a Poisson(1) weight per replicate from md5 of (seed, key)
    and of (seed, replicate) -- the same on any partitioning, retry or engine;
    rows whose keys agree in 31 bits share theirs -- and each partition emits
    only (group, replicate, sum w*x, sum w)."""
    g = list(group_cols)
    drop_all = not g
    if drop_all:
        samples, g = samples.withColumn("_all", F.lit(1)), ["_all"]
    keyed = samples.select(*g, F.col(value_col).cast("double").alias("_x"),
                           (F.conv(F.substring(hord(seed, key_col), 1, 8), 16, 10).cast("long") % PRIME).alias("_h"))
    terms = replicate_terms(n_boot, seed)
    chunk = 1024  # rows per vectorised step: chunk x n_boot weights in memory

    def partial(it):
        acc: dict = {}
        for pdf in it:
            if pdf.empty:
                continue
            h_all = pdf["_h"].to_numpy()
            x_all = pdf["_x"].to_numpy()
            codes, uniq = pd.factorize(pd.MultiIndex.from_frame(pdf[g]))
            for start in range(0, len(pdf), chunk):
                w = poisson_weights(h_all[start:start + chunk], terms)
                x = x_all[start:start + chunk]
                cc = codes[start:start + chunk]
                onehot = np.zeros((len(uniq), len(cc)))
                onehot[cc, np.arange(len(cc))] = 1.0
                sw, swx = onehot @ w, onehot @ (w * x[:, None])   # per group x replicate
                for gi, key in enumerate(uniq):
                    if not onehot[gi].any():
                        continue
                    a, b = acc.get(key, (0.0, 0.0))
                    acc[key] = (a + sw[gi], b + swx[gi])
        for key, (sw, swx) in acc.items():
            out = pd.DataFrame({"_b": np.arange(n_boot, dtype=np.int64), "_sw": sw, "_swx": swx})
            for j, c in enumerate(g):
                out[c] = key[j]
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name in g]
                       + ["_b long", "_sw double", "_swx double"])
    parts = keyed.mapInPandas(partial, schema)
    sums = parts.groupBy(*g, "_b").agg(F.sum("_sw").alias("_sw"), F.sum("_swx").alias("_swx"))
    means = sums.where(F.col("_sw") > 0).withColumn("_m", F.col("_swx") / F.col("_sw"))
    lo, hi = alpha / 2, 1 - alpha / 2
    ci = means.groupBy(*g).agg(F.percentile("_m", F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    n = samples.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(ci, g, "left").select(*g, "n", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))
    return out.drop("_all") if drop_all else out
