"""Validation, metadata and provenance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec

PIVOT_REQUIRED = ("dataset_item_id", "query", "pivot_context", "pivot_token")
PROBE_REQUIRED = ("text", "labels", "original_dataset_item_id")


def dedup_rows(rows: DataFrame, ignore: Sequence[str] = ("timestamp",)) -> DataFrame:
    """A3: drop ``timestamp`` if present, then exact duplicates."""
    keep = [c for c in rows.columns if c not in ignore]
    return rows.select(*keep).dropDuplicates()


def validate_rows(df: DataFrame, required: Sequence[str], labels_col: str | None = None) -> DataFrame:
    """A4: one pass/fail row: non-empty, required columns present and (for
    probe rows) no empty label array."""
    missing = [c for c in required if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if labels_col and labels_col in df.columns:
        aggs.append(F.min(F.size(labels_col)).alias("min_labels"))
    else:
        aggs.append(F.lit(None).cast("int").alias("min_labels"))
    out = df.agg(*aggs).withColumn("missing_columns", F.lit(",".join(missing)))
    ok = (F.col("n_rows") > 0) & (F.col("missing_columns") == "") & \
        F.coalesce(F.col("min_labels") > 0, F.lit(labels_col is None))
    return out.withColumn("ok", ok)


def discover_layers(store: DataFrame, override: Sequence[int] | None = None) -> DataFrame:
    """Layers with stored data (a partition-column scan), sorted; an
    override list is intersected with them, keeping its order."""
    avail = store.select(F.col("layer").cast("int").alias("layer")).distinct()
    if override:
        spark = store.sparkSession
        want = spark.createDataFrame([(int(v), i) for i, v in enumerate(override)], "layer int, ord int")
        return want.join(avail, "layer", "left_semi")
    return avail.withColumn("ord", F.col("layer"))


def vector_digest(v) -> Column:
    """First 16 hex digits of sha256 over the vector rounded to 1e-6 (as
    integers, so every engine formats them the same way)."""
    ints = F.transform(v if isinstance(v, Column) else F.col(v),
                       lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))
    return F.substring(F.sha2(F.array_join(ints, ","), 256), 1, 16)


def vector_metadata(vectors: DataFrame, val: DataFrame, split: str = "train") -> DataFrame:
    """(layer, hidden_dim, vector_norm, n_pos, n_neg, split, sha256_16,
    cosine_to_val_vector) for direction vectors with class counts."""
    j = vectors.join(val.select("layer", F.col("direction").alias("_val")), "layer", "left")
    return j.select("layer", F.size("direction").alias("hidden_dim"), vec.norm("direction").alias("vector_norm"),
                    "n_pos", "n_neg", F.lit(split).alias("split"), vector_digest("direction").alias("sha256_16"),
                    vec.cosine("direction", "_val").alias("cosine_to_val_vector"))


def vector_source_fallback(train: DataFrame, val: DataFrame) -> DataFrame:
    """Per layer the train vector, else the validation vector, tagged
    with its source; layers with neither do not appear."""
    j = (train.select("layer", F.col("direction").alias("_t"))
         .join(val.select("layer", F.col("direction").alias("_v")), "layer", "full_outer"))
    return j.select("layer", F.coalesce("_t", "_v").alias("direction"),
                    F.when(F.col("_t").isNotNull(), "train").otherwise("val").alias("vector_source"))


def hook_target_layer_idx(layer) -> Column:
    """layer - 1, and -1 for layer 0 (the hook sits on the previous block)."""
    c = F.col(layer) if isinstance(layer, str) else layer
    return F.when(c == 0, F.lit(-1)).otherwise(c - 1)


def run_state(metrics: DataFrame, provenance: DataFrame) -> DataFrame:
    """Label + metrics + provenance (+ free-form extras) per run."""
    j = metrics.join(provenance, "run", "left")
    return j.select("run", "label", F.struct("accuracy", "f1", "parse_rate", "correct", "n").alias("metrics"),
                    "layer", hook_target_layer_idx("layer").alias("hook_target_layer_idx"), "mode",
                    "vector_source", F.create_map(F.lit("arm"), F.col("arm")).alias("extras"))


def validate_run_state(states: DataFrame) -> DataFrame:
    """One row per violated rule: parse_rate in [0, 1]; steered runs
    carry layer/mode/vector_source; hook index = layer - 1."""
    pr = F.col("metrics.parse_rate")
    rules = [
        ("parse_rate_out_of_range", pr.isNull() | (pr < 0) | (pr > 1)),
        ("missing_provenance", (F.col("label") != "base") &
         (F.col("layer").isNull() | F.col("mode").isNull() | F.col("vector_source").isNull())),
        ("hook_index_mismatch", F.col("layer").isNotNull() &
         ~F.col("hook_target_layer_idx").eqNullSafe(hook_target_layer_idx("layer"))),
    ]
    out = None
    for name, cond in rules:
        part = states.where(cond).select("run", F.lit(name).alias("violation"))
        out = part if out is None else out.unionByName(part)
    return out


def read_json_reports(df: DataFrame, json_col: str, key_type: str = "int") -> DataFrame:
    """JSON objects with string keys -> (key, value) rows, cast."""
    m = F.from_json(F.col(json_col), "map<string,double>")
    return df.select("*", F.explode_outer(m).alias("_k", "value")).withColumn(
        "key", F.col("_k").try_cast(key_type)).drop("_k")


def normalize_activations(nested: DataFrame, store_col: str = "store", keep: Sequence[str] = ()) -> DataFrame:
    """A5: nested ``map<layer, map<bucket, array<vector>>>`` records -> the
    long float32 table (layer int, bucket, position, activation array<float>).
    A missing bucket simply yields no rows."""
    k = list(keep)
    lay = nested.select(*k, F.explode(store_col).alias("_layer", "_buckets"))
    bk = lay.select(*k, "_layer", F.explode("_buckets").alias("bucket", "_vecs"))
    return bk.select(*k, F.col("_layer").cast("int").alias("layer"), "bucket",
                     F.posexplode("_vecs").alias("position", "_v")).select(
        *k, "layer", "bucket", "position", F.transform("_v", lambda x: x.cast("float")).alias("activation"))
