"""Queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from . import (bpe, collocations, html_extract, language_id, lz_fingerprint, ngram_join, packing, periodic_runs, pii, quality_rules, simhash, token_counts,
               url_filter)
from .common import table

QUERIES = {}
ORACLE = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


@query("op2_url_filter", url_filter.oracle_sql())
def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.spam_list(pages))


@query("op4_quality_rules", quality_rules.oracle_sql())
def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


@query("op5_bpe")
def op5_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs, measure=False))


@query("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op7_lz_fingerprint")
def op7_lz_fingerprint(spark, sf_dir):
    return lz_fingerprint.with_edits(table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.detect(docs))


@query("op12_collocations", collocations.oracle_sql())
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_ngram_join", ngram_join.oracle_sql())
def op13_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
