"""Versioned Parquet store that a crash cannot leave half-written.

A store is a folder with one sub-folder of Parquet files for each version and
one manifest for each finished one:

    <path>/data/<n>-<uuid>/...     written first
    <path>/manifest/<n>.json       written when all data is there

A manifest names its version's folder, schema, rows' key and every file with
its length, and ends with a checksum of itself.  Whatever stops a write leaves
data without a manifest, or a manifest that does not match its checksum: both
are as if they were not there.  A manifest is created, never replaced, so of
two writers of one number one fails over to the next; readers see the old
version until the new manifest is complete.  A version that has lost a file, or
in which a file has another length, is passed over for the one before.

``expire`` drops old versions, manifest first, and data that no manifest names
once it is older than a grace time (it may be a write under way).
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Age in seconds from which data without a manifest counts as given up.
GRACE_S = 24 * 3600


class _Files:
    """The file system of a path, whichever Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path
        root = self.of("")
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self.of(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def lengths(self, folder: str) -> dict[str, int]:
        """Data files below a folder, by their path inside it."""
        at = self.of(folder)
        if not self.fs.exists(at):
            return {}
        base = len(self.fs.makeQualified(at).toString()) + 1
        found, it = {}, self.fs.listFiles(at, True)
        while it.hasNext():
            status = it.next()
            name = status.getPath().toString()[base:]
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                found[name] = status.getLen()
        return found

    def read(self, name: str) -> str:
        stream = self.fs.open(self.of(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            stream = self.fs.create(self.of(name), False)
        except Exception as e:  # noqa: BLE001  Hadoop's own, by way of the gateway
            if self.fs.exists(self.of(name)):
                return False
            raise e
        stream.write(text.encode())
        stream.close()
        return True

    def age_s(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.of(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.of(name), True)


def _sealed(body: dict) -> str:
    text = json.dumps(body, sort_keys=True)
    return text + "\n" + hashlib.sha256(text.encode()).hexdigest()


def _opened(text: str) -> dict | None:
    body, _, seal = text.partition("\n")
    return json.loads(body) if seal == hashlib.sha256(body.encode()).hexdigest() else None


def _numbers(files: _Files) -> list[int]:
    names = (n.removesuffix(".json") for n in files.names("manifest"))
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def versions(spark: SparkSession, path: str, key: str | None = None) -> list[dict]:
    """Manifests of the whole versions, the newest first; with ``key``, of
    those written with it."""
    files = _Files(spark, path)
    out = []
    for n in _numbers(files):
        m = _opened(files.read(f"manifest/{n}.json"))
        if m is not None and key in (None, m["key"]) and files.lengths(m["data"]) == m["files"]:
            out.append(m)
    return out


def write_version(df: DataFrame, path: str, key: str = "", partition_by=()) -> dict:
    """Writes ``df`` as the newest version and returns its manifest.  ``key``
    says what the rows were made from."""
    spark = df.sparkSession
    files = _Files(spark, path)
    n = next(iter(_numbers(files)), 0) + 1
    data = f"data/{n}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{data}")
    body = {"data": data, "key": key, "schema": df.schema.jsonValue(), "files": files.lengths(data), "written_at": time.time()}
    while not files.create(f"manifest/{n}.json", _sealed(body | {"version": n})):
        n += 1  # another writer was first, or a manifest was cut off
    return body | {"version": n}


def read_version(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(f"{path}/{manifest['data']}")


def read_current(spark: SparkSession, path: str, key: str | None = None) -> DataFrame | None:
    """The newest whole version, or None."""
    found = versions(spark, path, key)
    return read_version(spark, path, found[0]) if found else None


def expire(spark: SparkSession, path: str, keep: int = 2, grace_s: float = GRACE_S) -> list[str]:
    """Drops all but the ``keep`` newest whole versions, and data that no
    manifest names for longer than ``grace_s``.  Returns the folders dropped."""
    if keep < 1:
        raise ValueError("one version stays at least")
    files = _Files(spark, path)
    kept = versions(spark, path)[:keep]
    least = kept[-1]["version"] if kept else 0
    for n in _numbers(files):
        if n < least:
            files.delete(f"manifest/{n}.json")
    named = {m["data"] for m in versions(spark, path)}
    gone = []
    for name in files.names("data"):
        at = f"data/{name}"
        if at not in named and (int(name.split("-")[0]) < least or files.age_s(at) > grace_s):
            files.delete(at)
            gone.append(at)
    return gone
