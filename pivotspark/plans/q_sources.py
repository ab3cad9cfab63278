"""Registered queries for scans, sinks, validation (§2.A) and sampling (§2.B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import sampling as S
from ..operators import validation as VA
from ..operators import vectors as V
from ..sources import fixtures as X
from ..sources import sinks as SK
from ..sources.tables import load
from .q_labels import _probe_local, probe_rows
from .q_probes import _probe_sql
from .q_runs import _RUN_LOCAL, metrics as run_metrics_df, scored
from .q_vectors import _n, _d, _test, _train, _train_dirs
from .registry import query, tidy, with_ctes


# -- A ---------------------------------------------------------------------------

@query("head_subset", with_ctes("""
SELECT dataset_item_id, pivot_token, CAST(row_ord AS BIGINT) AS row_ord FROM pivot_rows ORDER BY row_ord LIMIT 100""",
                                "pivot_rows"))
def q_head_subset(spark, sf):
    """A2: the first min(100, n) rows in file order (the limit is the feature)."""
    r = X.pivot_rows(spark, sf)
    return tidy(r.orderBy("row_ord").limit(100).select("dataset_item_id", "pivot_token", "row_ord"))


@query("dedup_rows", with_ctes("""
SELECT DISTINCT dataset_item_id, query, pivot_context, pivot_token, round(prob_delta, 6) AS prob_delta
FROM pivot_rows""", "pivot_rows"))
def q_dedup_rows(spark, sf):
    """A3: drop the timestamp (and the file ordinal), then exact duplicates."""
    return tidy(VA.dedup_rows(X.pivot_rows(spark, sf), ignore=("timestamp", "row_ord")))


@query("validate_rows", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(len(labels)) AS BIGINT) AS min_labels, '' AS missing_columns,
       count(*) > 0 AND min(len(labels)) > 0 AS ok FROM probe""", "pivot_rows", local=_probe_local()))
def q_validate_rows(spark, sf):
    """A4: probe rows are non-empty, have the required columns and labels."""
    return tidy(VA.validate_rows(probe_rows(spark, sf), VA.PROBE_REQUIRED, "labels"))


@query("activation_cache", with_ctes("""
SELECT split, CAST(count(*) AS BIGINT) AS n,
       round(sum(list_sum(list_transform(activation, lambda x: CAST(x AS DOUBLE)))), 6) AS act_sum
FROM activations WHERE layer = 1 GROUP BY split""", "activations"))
def q_activation_cache(spark, sf):
    """Activation store written partitioned by (split, layer) to the
    shared folder and read back for one layer (partition pruning)."""
    path = SK.save_activation_store(X.activations(spark, sf), SK.new_path(spark, "activation_store"))
    a = SK.load_activation_store(spark, path).where(F.col("layer") == 1)
    return tidy(a.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(vec.vsum("activation")).alias("act_sum")))


@query("write_split", with_ctes("""
SELECT CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split,
       CAST(sum(nrows) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_ids
FROM (SELECT dataset_item_id, nrows,
             row_number() OVER (ORDER BY md5(concat_ws('|', '42', dataset_item_id)), dataset_item_id) AS rn,
             count(*) OVER () AS cnt
      FROM (SELECT dataset_item_id, count(*) AS nrows
            FROM (SELECT DISTINCT dataset_item_id, query, pivot_context, pivot_token, prob_delta FROM pivot_rows)
            GROUP BY dataset_item_id))
GROUP BY 1""", "pivot_rows"))
def q_write_split(spark, sf):
    """Dedup -> key split by id -> train/test written side by side."""
    rows = VA.dedup_rows(X.pivot_rows(spark, sf), ignore=("timestamp", "row_ord"))
    split = S.split_by_key(rows, "dataset_item_id", 42, 0.2)
    paths = SK.write_split(split, SK.new_path(spark, "pivot_split"))
    back = spark.read.parquet(paths["train"].rsplit("/", 1)[0])
    return tidy(back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.countDistinct("dataset_item_id").alias("n_ids")))


@query("write_probe_rows", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len(labels)) AS BIGINT) AS n_labels,
       CAST(sum(len(list_filter(labels, lambda x: x = 1))) AS BIGINT) AS n_pos FROM probe""",
                                     "pivot_rows", local=_probe_local()))
def q_write_probe_rows(spark, sf):
    """Probe rows persisted as Parquet and read back."""
    path = SK.write_table(probe_rows(spark, sf), SK.new_path(spark, "probe_rows"))
    p = spark.read.parquet(path)
    return tidy(p.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("labels")).alias("n_labels"),
                      F.sum(F.size(F.filter("labels", lambda x: x == 1))).alias("n_pos")))


@query("write_layer_artifacts", with_ctes("""
SELECT b.backend, CAST(layer AS BIGINT) AS layer, CAST(count(*) AS BIGINT) AS n_val, CAST(max(len(activation)) AS BIGINT) AS dim
FROM activations CROSS JOIN (VALUES ('centroid'), ('logreg')) b(backend) WHERE split = 'test' GROUP BY 1, 2""", "activations"))
def q_write_layer_artifacts(spark, sf):
    """Per backend and layer the validation (X, y), the probe's weights
    and bias -- of the centroid probe and of the trained one -- written by
    (backend, layer) and read back."""
    from ..operators import training as TR
    from .q_probes import fixed_probes
    base = SK.new_path(spark, "layer_artifacts")
    val = _test(spark, sf).select("layer", "query_id", "activation", F.col("label").cast("double").alias("y"))
    trained = TR.train_logreg_layers(X.activations(spark, sf).where(F.col("split") == "train")).select(
        "layer", F.col("coef_raw").alias("weights"), F.col("bias_raw").alias("bias"))
    probes = (fixed_probes(spark, sf).select("layer", "weights", "bias").withColumn("backend", F.lit("centroid"))
              .unionByName(trained.withColumn("backend", F.lit("logreg"))))
    backends = F.explode(F.array(F.lit("centroid"), F.lit("logreg"))).alias("backend")
    SK.write_table(val.select("*", backends), f"{base}/val", partition_by=["backend", "layer"])
    SK.write_table(probes, f"{base}/probes", partition_by=["backend", "layer"])
    v = spark.read.parquet(f"{base}/val").groupBy("backend", "layer").agg(F.count(F.lit(1)).alias("n_val"))
    p = spark.read.parquet(f"{base}/probes").select("backend", "layer", F.size("weights").alias("dim"))
    return tidy(v.join(p, ["backend", "layer"]))


@query("write_reports", _probe_sql("""
SELECT (SELECT count(*) FROM met) AS n_metric_rows, (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS n_run_rows,
       'best_layer=' || (SELECT CAST(layer AS VARCHAR) FROM met ORDER BY accuracy DESC, layer LIMIT 1) AS best_line"""))
def q_write_reports(spark, sf):
    """A10: metrics JSON, run CSV and the best-layer text written and read back."""
    from ..operators import probes as P
    from .q_probes import scored_test
    base = SK.new_path(spark, "reports")
    m = P.binary_metrics(scored_test(spark, sf)).drop("confusion_matrix")
    SK.write_table(m, f"{base}/metrics", "json")
    SK.write_table(run_metrics_df(spark, sf), f"{base}/runs", "csv")
    best = P.best_layer(m).select(F.concat(F.lit("best_layer="), F.col("best_layer").cast("string")).alias("value"))
    SK.write_text(best, f"{base}/best_layer")
    a = spark.read.json(f"{base}/metrics").agg(F.count(F.lit(1)).alias("n_metric_rows"))
    b = spark.read.option("header", True).csv(f"{base}/runs").agg(F.count(F.lit(1)).alias("n_run_rows"))
    c = spark.read.text(f"{base}/best_layer").agg(F.first("value").alias("best_line"))
    return tidy(a.select("n_metric_rows", b.scalar().alias("n_run_rows"), c.scalar().alias("best_line")))


@query("materialize_once", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_first, CAST(count(*) AS BIGINT) AS n_reused FROM run_config""", "run_config"))
def q_materialize_once(spark, sf):
    """The second call reuses the stored result instead of recomputing."""
    path = SK.new_path(spark, "materialized")
    first = SK.materialize_once(spark, lambda: run_metrics_df(spark, sf), path)
    again = SK.materialize_once(spark, lambda: spark.range(0).toDF("run"), path)  # would be empty if recomputed
    return tidy(first.agg(F.count(F.lit(1)).alias("n_first")).select(
        "n_first", again.agg(F.count(F.lit(1))).scalar().alias("n_reused")))


@query("discover_layers", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(ord AS BIGINT) AS ord
FROM (VALUES (3, 0), (1, 1), (8, 2)) w(layer, ord) WHERE layer IN (SELECT DISTINCT layer FROM activations)""",
                                    "activations"))
def q_discover_layers(spark, sf):
    """Stored layers intersected with the override [3, 1, 8] (order kept)."""
    return tidy(VA.discover_layers(X.activations(spark, sf), [3, 1, 8]))


_VAL_DIR = """SELECT layer, list(value ORDER BY dim) AS direction FROM (
    SELECT layer, dim, avg(x) FILTER (WHERE label >= 0.5) - avg(x) FILTER (WHERE label < 0.5) AS value
    FROM acts_long WHERE split = 'test' GROUP BY layer, dim) GROUP BY layer"""


@query("vector_metadata", with_ctes(f"""
SELECT CAST(t.layer AS BIGINT) AS layer, CAST(len(t.direction) AS BIGINT) AS hidden_dim,
       round({_n('t.direction')}, 6) AS vector_norm, CAST(c.n_pos AS BIGINT) AS n_pos,
       CAST(c.n_neg AS BIGINT) AS n_neg, 'train' AS split,
       substr(sha256(array_to_string(list_transform(t.direction, lambda x: CAST(CAST(round(x * 1e6) AS BIGINT)
           AS VARCHAR)), ',')), 1, 16) AS sha256_16,
       round({_d('t.direction', 'v.direction')} / ({_n('t.direction')} * {_n('v.direction')} + 1e-12), 6)
           AS cosine_to_val_vector
FROM train_dir t JOIN vdir v ON v.layer = t.layer
JOIN (SELECT layer, sum(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS n_pos,
             sum(CASE WHEN label >= 0.5 THEN 0 ELSE 1 END) AS n_neg
      FROM activations WHERE split = 'train' GROUP BY layer) c ON c.layer = t.layer""",
                                    "train_dir", "activations", "acts_long", local=[("vdir", _VAL_DIR)]))
def q_vector_metadata(spark, sf):
    """Dim, norm, class counts, digest and cosine to the val vector."""
    t = V.centroid_diff(_train(spark, sf), ["layer"], "label", "activation")
    v = V.centroid_diff(_test(spark, sf), ["layer"], "label", "activation")
    return tidy(VA.vector_metadata(t, v))


@query("vector_source_fallback", with_ctes(f"""
SELECT CAST(coalesce(t.layer, v.layer) AS BIGINT) AS layer,
       CASE WHEN t.layer IS NOT NULL THEN 'train' ELSE 'val' END AS vector_source,
       round(CASE WHEN t.layer IS NOT NULL THEN {_n('t.direction')} ELSE {_n('v.direction')} END, 6) AS norm
FROM (SELECT * FROM train_dir WHERE layer <> 0) t FULL OUTER JOIN vdir v ON t.layer = v.layer""",
                                           "train_dir", "acts_long", local=[("vdir", _VAL_DIR)]))
def q_vector_source_fallback(spark, sf):
    """Train vector preferred (here missing for layer 0), else val."""
    t = _train_dirs(spark, sf).where(F.col("layer") != 0)
    v = V.assemble(V.centroid_diff_long(_test(spark, sf), ["layer"], "label", "activation"), ["layer"],
                   out_col="direction")
    out = VA.vector_source_fallback(t, v)
    return tidy(out.select("layer", "vector_source", vec.norm("direction").alias("norm")))


def _provenance(spark, sf):
    c = X.run_config(spark, sf)
    return c.select("run", "arm", F.when(F.col("arm") == "base", "base").otherwise(
        F.concat(F.col("arm"), F.lit("_f"), F.col("factor").cast("string"))).alias("label"),
        F.when(F.col("arm") == "base", None).otherwise(F.lit(14)).alias("layer"),
        F.when(F.col("arm") == "base", None).otherwise(F.lit("additive_normalized")).alias("mode"),
        F.when(F.col("arm") == "pivotal", "train").when(F.col("arm") == "random", None).alias("vector_source"))


_STATE_SQL = """SELECT m.run, c.arm,
       CASE WHEN c.arm = 'base' THEN 'base' ELSE c.arm || '_f' || CAST(c.factor AS VARCHAR) END AS label,
       m.accuracy, m.f1, m.parse_rate, m.correct, m.n,
       CASE WHEN c.arm = 'base' THEN NULL ELSE 14 END AS layer,
       CASE WHEN c.arm = 'base' THEN NULL ELSE 'additive_normalized' END AS mode,
       CASE WHEN c.arm = 'pivotal' THEN 'train' END AS vector_source
FROM metrics m LEFT JOIN run_config c USING (run)"""


@query("save_run_state", with_ctes("""
SELECT CAST(run AS BIGINT) AS run, label, round(accuracy, 6) AS accuracy, round(parse_rate, 6) AS parse_rate,
       CAST(layer AS BIGINT) AS layer,
       CAST(CASE WHEN layer = 0 THEN -1 ELSE layer - 1 END AS BIGINT) AS hook_target_layer_idx, mode, vector_source
FROM states""", "generations", "run_config", local=_RUN_LOCAL + [("states", _STATE_SQL)]))
def q_save_run_state(spark, sf):
    """Run state = label + metrics + provenance; hook index = layer - 1."""
    st = VA.run_state(run_metrics_df(spark, sf), _provenance(spark, sf))
    return tidy(st.select("run", "label", F.col("metrics.accuracy").alias("accuracy"),
                          F.col("metrics.parse_rate").alias("parse_rate"), "layer", "hook_target_layer_idx", "mode",
                          "vector_source"))


@query("validate_run_state", with_ctes("""
SELECT CAST(run AS BIGINT) AS run, 'missing_provenance' AS violation FROM states
WHERE label <> 'base' AND (layer IS NULL OR mode IS NULL OR vector_source IS NULL)
UNION ALL SELECT CAST(run AS BIGINT), 'parse_rate_out_of_range' FROM states
WHERE parse_rate IS NULL OR parse_rate < 0 OR parse_rate > 1""", "generations", "run_config",
                                       local=_RUN_LOCAL + [("states", _STATE_SQL)]))
def q_validate_run_state(spark, sf):
    """Violated state rules (random arms lack a vector source)."""
    st = VA.run_state(run_metrics_df(spark, sf), _provenance(spark, sf))
    return tidy(VA.validate_run_state(st))


@query("read_json_reports", """
SELECT event_id, CAST(unnest(map_keys(m)) AS VARCHAR) AS k, unnest(map_values(m)) AS value
FROM (SELECT event_id, json_transform(props, '"MAP(VARCHAR, DOUBLE)"') AS m FROM events)""")
def q_read_json_reports(spark, sf):
    """JSON objects with string keys read as (key, value) rows."""
    ev = load(spark, sf, "events").select("event_id", "props")
    out = VA.read_json_reports(ev, "props", "string")
    return tidy(out.select("event_id", F.col("key").alias("k"), "value"))


@query("generations_text", with_ctes("""
SELECT CAST(run AS BIGINT) AS run, idx,
       printf('[%d] gt=%s pred=%s correct=%s', idx, coalesce(ground_truth, 'None'), coalesce(predicted, 'None'),
              CASE WHEN correct THEN 'True' ELSE 'False' END) || chr(10) || full_output AS value
FROM scored""", "generations", "run_config", local=_RUN_LOCAL))
def q_generations_text(spark, sf):
    """Flat text export per example."""
    return tidy(SK.generations_text(scored(spark, sf)))


# -- B ---------------------------------------------------------------------------

@query("split_by_key", with_ctes("SELECT query_id, split FROM key_split", "key_split"))
def q_split_by_key(spark, sf):
    """B1: group-safe split: ceil(0.2 n) ids in seeded-hash order are test."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"))
    return tidy(S.split_by_key(e, "query_id", 42, 0.2))


@query("select_layers", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(sel_ord AS BIGINT) AS sel_ord
FROM (VALUES (3, 0), (1, 1), (8, 2)) w(layer, sel_ord)
WHERE layer IN (SELECT layer FROM activations WHERE split = 'train'
                INTERSECT SELECT layer FROM activations WHERE split = 'test')""", "activations"))
def q_select_layers(spark, sf):
    """B2: explicit [3, 1, 8] over the layers present in train and test."""
    a = X.activations(spark, sf)
    avail = S.common_layers(a.where(F.col("split") == "train"), a.where(F.col("split") == "test"))
    return tidy(S.select_layers(spark, avail, explicit=[3, 1, 8]))


@query("cap_per_class", with_ctes("""
SELECT CAST(layer AS BIGINT) AS layer, CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(query_id) AS BIGINT) AS id_sum
FROM (SELECT *, row_number() OVER (PARTITION BY layer, label
                                   ORDER BY md5(concat_ws('|', '42', CAST(query_id AS VARCHAR))), query_id) AS rk
      FROM activations WHERE split = 'train') WHERE rk <= 64
GROUP BY layer, label""", "activations"))
def q_cap_per_class(spark, sf):
    """At most 64 rows per (layer, class), seeded, without replacement."""
    c = S.cap_per_class(_train(spark, sf), ["layer", "label"], "query_id", 64)
    return tidy(c.groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("id_sum")))


@query("sample_examples", with_ctes("""
SELECT idx FROM generations WHERE run = 1
ORDER BY md5(concat_ws('|', '42', CAST(idx AS VARCHAR))), idx LIMIT 100""", "generations"))
def q_sample_examples(spark, sf):
    """100 examples of the base run without replacement (seed 42)."""
    g = X.generations(spark, sf).where(F.col("run") == 1)
    return tidy(S.sample_examples(g, 100, 42, "idx").select("idx"))


@query("first_k_groups", with_ctes("""
SELECT dataset_item_id, CAST(row_ord AS BIGINT) AS row_ord FROM pivot_rows
WHERE dataset_item_id IN (SELECT dataset_item_id FROM pivot_rows GROUP BY 1 ORDER BY min(row_ord), 1 LIMIT 10)""",
                                   "pivot_rows"))
def q_first_k_groups(spark, sf):
    """Rows of the first 10 ids by first appearance."""
    r = X.pivot_rows(spark, sf)
    return tidy(S.first_k_groups(r, "dataset_item_id", "row_ord", 10).select("dataset_item_id", "row_ord"))


@query("sign_groups", with_ctes("""
SELECT row_id, CASE WHEN prob_delta > 0 THEN 'pos' ELSE 'neg' END AS sign_group FROM vector_corpus
WHERE prob_delta <> 0""", "vector_corpus"))
def q_sign_groups(spark, sf):
    """Positive and negative delta rows (zero in neither)."""
    return tidy(S.sign_groups(X.vector_corpus(spark, sf), "prob_delta").select("row_id", "sign_group"))


@query("quartile_groups", with_ctes("""
SELECT row_id, 'high' AS quartile_group FROM vector_corpus
WHERE abs(prob_delta) >= (SELECT quantile_cont(abs(prob_delta), 0.75) FROM vector_corpus)
UNION ALL
SELECT row_id, 'low' FROM vector_corpus
WHERE abs(prob_delta) <= (SELECT quantile_cont(abs(prob_delta), 0.25) FROM vector_corpus)""", "vector_corpus"))
def q_quartile_groups(spark, sf):
    """|delta| >= q75 (high) and <= q25 (low), linear interpolation."""
    c = X.vector_corpus(spark, sf).withColumn("abs_delta", F.abs("prob_delta"))
    return tidy(S.quartile_groups(c, "abs_delta").select("row_id", "quartile_group"))


@query("min_group_size", with_ctes("""
SELECT pivot_token, CAST(count(*) AS BIGINT) AS n FROM vector_corpus GROUP BY 1 HAVING count(*) >= 30""",
                                   "vector_corpus"))
def q_min_group_size(spark, sf):
    """Groups (pivot tokens) with at least 30 rows (40 in the notebook;
    a parameter, smaller here because the fixture groups are small)."""
    c = S.min_group_size(X.vector_corpus(spark, sf), "pivot_token", 30)
    return tidy(c.groupBy("pivot_token").agg(F.count(F.lit(1)).alias("n")))


@query("clip_output_text", with_ctes("""
SELECT CAST(run AS BIGINT) AS run, idx, left(question, 500) AS head_500, right(question, 10) AS tail_10
FROM generations""", "generations"))
def q_clip_output_text(spark, sf):
    """First / last characters of a text column."""
    g = X.generations(spark, sf)
    return tidy(g.select("run", "idx", S.clip_text("question", first=500).alias("head_500"),
                         S.clip_text("question", last=10).alias("tail_10")))


@query("build_prompt", with_ctes("""
SELECT CAST(run AS BIGINT) AS run, idx,
       'Question: ' || question || chr(10) || chr(10) || 'Let''s think step by step.' || chr(10) || chr(10) AS prompt
FROM generations WHERE run = 1""", "generations"))
def q_build_prompt(spark, sf):
    """Question -> the fixed prompt template."""
    g = X.generations(spark, sf).where(F.col("run") == 1)
    return tidy(S.build_prompt(g).select("run", "idx", "prompt"))


@query("add_abs_delta", with_ctes("""
SELECT row_id, round(abs(prob_delta), 6) AS abs_prob_delta,
       round(list_sum(list_transform(steering_vector, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 6) AS vec_sum
FROM vector_corpus""", "vector_corpus"))
def q_add_abs_delta(spark, sf):
    """|prob_delta| and vectors coerced to float32."""
    c = S.add_abs_delta(X.vector_corpus(spark, sf))
    return tidy(c.select("row_id", "abs_prob_delta", vec.vsum("steering_vector").alias("vec_sum")))


@query("normalize_activations", with_ctes("""
SELECT query_id, CAST(layer AS BIGINT) AS layer, bucket, CAST(0 AS BIGINT) AS position,
       round(list_sum(list_transform(activation, lambda x: CAST(x AS DOUBLE))), 6) AS act_sum
FROM activations""", "activations"))
def q_normalize_activations(spark, sf):
    """A5: per-record nested layer -> bucket -> vectors flattened to the long
    float32 table (the nested form is built per id from the embeddings)."""
    a = X.activations(spark, sf)
    per_layer = a.groupBy("query_id", "layer", "bucket").agg(
        F.collect_list(vec.to_double("activation")).alias("vecs"))          # one vector per (id, layer)
    nested = per_layer.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("layer").cast("string"),
                                                   F.create_map("bucket", "vecs")))).alias("store"))
    out = VA.normalize_activations(nested, "store", ["query_id"])
    return tidy(out.select("query_id", "layer", "bucket", "position", vec.vsum("activation").alias("act_sum")))
