import corpus_pipeline as C
from pivotspark.llm import queries as Q
from pivotspark.llm.common import stored

from .helpers import ODD_TEXTS, documents, prose

SMALL = "/root/testdata/sf0.001"


def corpus(spark):
    copy = prose(100, 300)
    near = copy.split()
    near[7] = "changed"
    texts = [*ODD_TEXTS, *(prose(i, 120) for i in range(40)), copy, copy, " ".join(near), prose(7, 90) + " me@mail.example.com"]
    return documents(spark, texts, ["en"] * len(texts), extra=True), len(ODD_TEXTS)


def test_stages_by_their_operators(spark):
    docs, n = corpus(spark)
    kept = []
    for name, stage in C.STAGES[:-1]:
        out = stored(stage(spark, docs, ""), "test")
        assert out.columns == docs.columns, name
        kept.append({r.doc_id: r for r in out.collect()})
        docs = out
    clean = {*range(n, n + 44)}
    assert set(kept[0]) & clean == clean and set(kept[1]) & clean == clean
    assert clean - set(kept[2]) == {n + 41, n + 42}  # an exact and a near copy of n + 40
    assert set(kept[3]) == set(kept[2]) and kept[3][n + 43].text.endswith("<EMAIL>")
    assert kept[3][n + 43].n_chars == len(kept[3][n + 43].text)
    packed = C.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == set(kept[3])


def test_empty_table(spark):
    docs = documents(spark, ["a"], extra=True).limit(0)
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, ""), "test")
        assert docs.count() == 0


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test")
    assert sorted(C.run(spark, SMALL).drop("ids").collect()) == sorted(docs.drop("ids").collect())


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES if k.startswith("op")) == list(range(1, 14))
    assert set(Q.ORACLE) <= set(Q.QUERIES)


def test_entry_has_the_pipeline_beside_the_operators():
    import __spark_entry__ as E
    assert {"pipeline", *Q.QUERIES} <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
