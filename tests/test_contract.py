"""Driver contract: entry() runs; every oracle key is a query; a sample of
queries matches its DuckDB oracle at sf0.001."""

import pytest

from .conftest import SF_SMALL


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "accuracy" in df.columns


def test_oracle_keys_are_queries():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


SAMPLE = ["centroid_diff", "separability", "steer_multi", "auroc", "binary_metrics", "run_metrics",
          "flips_vs_base", "promoted_suppressed", "build_probe_rows", "double_negatives",
          "hysteresis_latch", "nie_candidate_grid", "gate_stats", "label_counts"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    from . import oracle_check as oc
    from __spark_entry__ import oracle_sql, queries
    con = oc.duck(SF_SMALL)
    r = oc.compare(spark, con, name, queries()[name], oracle_sql()[name], SF_SMALL)
    assert r["ok"], r
