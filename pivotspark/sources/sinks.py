"""Sinks and materialisation.

Everything is written under the cluster's shared folder
(``spark.checkpoint.dir``), never a machine-local temp folder, so that a
written table survives the loss of any executor and cuts the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .store import read_current, read_version, write_version


def new_path(spark: SparkSession, prefix: str) -> str:
    return shared_path(spark, f"{prefix}/{uuid.uuid4().hex}")


def save_activation_store(acts: DataFrame, path: str, key: str = "") -> str:
    """A version of Parquet partitioned by (split, layer) -> partition
    pruning on read.  Readers have the version before until it is whole."""
    write_version(acts, path, key, ["split", "layer"])
    return path


def load_activation_store(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The newest whole version; an error if there is none."""
    found = read_current(spark, path, key)
    if found is None:
        raise FileNotFoundError(f"no finished version in {path}")
    return found


def write_split(df: DataFrame, path: str) -> dict[str, str]:
    """Train and test side by side (partitioned by ``split``)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return {"train": f"{path}/split=train", "test": f"{path}/split=test"}


def read_split(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    """A1: the rows of a split of a table stored by ``split``, read with the
    given schema.  A split that is not there falls back to ``train``, then to
    the first in alphabetical order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = sorted(s.getPath().getName()[len("split="):] for s in fs.listStatus(root)
                   if s.getPath().getName().startswith("split="))
    if not there:
        raise FileNotFoundError(f"no split in {path}")
    chosen = next(s for s in (split, "train", there[0]) if s in there)
    return spark.read.schema(schema).parquet(f"{path}/split={chosen}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """Persist a table (Parquet, JSON or CSV)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        getattr(w, fmt)(path)
    return path


def materialize_once(spark: SparkSession, df_fn, path: str, force: bool = False, key: str = "") -> DataFrame:
    """Reuse the stored result of this ``key`` unless ``force``; otherwise
    compute, write and read back (the read cuts the lineage).  Only a finished
    write counts: after a crash the result is computed anew."""
    found = None if force else read_current(spark, path, key)
    return found if found is not None else read_version(spark, path, write_version(df_fn(), path, key))


def generations_text(scored: DataFrame) -> DataFrame:
    """One text block per example: '[idx] gt=.. pred=.. correct=..' and
    the output on the next line (Python's None/True/False spelling)."""
    pred = F.coalesce(F.col("predicted"), F.lit("None"))
    gt = F.coalesce(F.col("ground_truth"), F.lit("None"))
    ok = F.when(F.col("correct"), "True").otherwise("False")
    return scored.select("run", "idx", F.format_string("[%d] gt=%s pred=%s correct=%s\n%s", F.col("idx"), gt, pred,
                                                       ok, F.col("full_output")).alias("value"))


def write_text(df: DataFrame, path: str) -> str:
    df.select("value").write.mode("overwrite").text(path)
    return path
