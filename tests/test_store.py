"""The versioned store after crashes, lost files and other writers."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from pivotspark.sources import sinks, store


@pytest.fixture()
def path(tmp_path):
    return f"{tmp_path}/store"


def rows(df):
    return sorted(map(tuple, df.collect()))


def broken(spark):
    """Some partitions are written, then a task fails for good."""
    @F.udf("long")
    def f(x):
        if x == 90:
            raise ValueError("lost")
        return x
    return spark.range(0, 100, 1, 8).select(f("id").alias("x"))


def test_write_that_dies_half_way_is_as_if_not_there(spark, path):
    with pytest.raises(Exception, match="lost"):
        sinks.materialize_once(spark, lambda: broken(spark), path)
    assert os.path.isdir(path) and store.versions(spark, path) == []
    good = spark.range(100).select(F.col("id").alias("x"))
    assert rows(sinks.materialize_once(spark, lambda: good, path)) == [(i,) for i in range(100)]
    # The finished result is reused, and outlives a later failure.
    assert sinks.materialize_once(spark, lambda: spark.range(0).toDF("x"), path).count() == 100
    with pytest.raises(Exception, match="lost"):
        sinks.materialize_once(spark, lambda: broken(spark), path, force=True)
    assert sinks.materialize_once(spark, lambda: spark.range(0).toDF("x"), path).count() == 100


def test_driver_that_dies_before_the_manifest(spark, path, monkeypatch):
    monkeypatch.setattr(store._Files, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.write_version(spark.range(5), path)
    monkeypatch.undo()
    assert store.read_current(spark, path) is None
    assert rows(sinks.materialize_once(spark, lambda: spark.range(3), path)) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("cut", [0, 1, 40, -1])
def test_manifest_cut_off(spark, path, cut):
    store.write_version(spark.range(4), path)
    newer = store.write_version(spark.range(9), path)
    name = f"{path}/manifest/{newer['version']}.json"
    text = open(name).read()
    crc = f"{path}/manifest/.{newer['version']}.json.crc"
    os.path.exists(crc) and os.remove(crc)
    open(name, "w").write(text[:cut])
    assert store.read_current(spark, path).count() == 4
    assert store.write_version(spark.range(2), path)["version"] > newer["version"]
    assert store.read_current(spark, path).count() == 2


def test_lost_file_falls_back_to_the_version_before(spark, path):
    store.write_version(spark.range(4), path)
    newer = store.write_version(spark.range(9), path)
    os.remove(f"{path}/{newer['data']}/{sorted(newer['files'])[0]}")
    assert store.read_current(spark, path).count() == 4
    assert sinks.materialize_once(spark, lambda: spark.range(9), path).count() == 4


def test_result_of_another_key_is_not_reused(spark, path):
    a = sinks.materialize_once(spark, lambda: spark.range(4), path, key="seed=1")
    b = sinks.materialize_once(spark, lambda: spark.range(6), path, key="seed=2")
    assert (a.count(), b.count()) == (4, 6)
    assert sinks.materialize_once(spark, lambda: spark.range(0), path, key="seed=1").count() == 4


def test_writers_at_once_both_land(spark, path):
    def write(n):
        store.write_version(spark.range(n), path, key=str(n))
    threads = [threading.Thread(target=write, args=(n,)) for n in (3, 5, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(m["version"] for m in store.versions(spark, path)) == [1, 2, 3]
    assert [store.read_current(spark, path, str(n)).count() for n in (3, 5, 7)] == [3, 5, 7]


def test_expiry_keeps_the_newest_and_writes_under_way(spark, path):
    made = [store.write_version(spark.range(n), path) for n in (1, 2, 3)]
    spark.range(9).write.parquet(f"{path}/data/4-underway")
    gone = store.expire(spark, path, keep=2)
    assert gone == [made[0]["data"]] and [m["version"] for m in store.versions(spark, path)] == [3, 2]
    assert store.read_current(spark, path).count() == 3
    assert sorted(store.expire(spark, path, keep=1, grace_s=-1)) == sorted([made[1]["data"], "data/4-underway"])
    assert store.read_current(spark, path).count() == 3
    with pytest.raises(ValueError):
        store.expire(spark, path, keep=0)


def test_activation_store_prunes_and_reads_no_half_version(spark, path):
    acts = spark.createDataFrame([("train", 0, 1.0), ("test", 0, 2.0), ("train", 1, 3.0)], "split string, layer int, x double")
    with pytest.raises(FileNotFoundError):
        sinks.load_activation_store(spark, path)
    sinks.save_activation_store(acts, path)
    back = sinks.load_activation_store(spark, path)
    assert rows(back.select("split", "layer", "x")) == rows(acts)
    plan = back.where("split = 'train' and layer = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and back.schema["layer"].dataType.simpleString() == "int"


def test_empty_result(spark, path):
    empty = spark.range(0).toDF("x")
    assert sinks.materialize_once(spark, lambda: empty, path).count() == 0
    assert sinks.materialize_once(spark, lambda: spark.range(5).toDF("x"), path).count() == 0
