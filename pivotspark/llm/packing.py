"""Packing: concatenate all documents and cut fixed windows.

Pass one tokenizes each partition once and writes ids with their offset inside
the partition.  The totals of the partitions (one row each) are then summed up
to global offsets, and pass two cuts every document at the window boundaries;
a piece is the boundary record of its window.  Only totals meet in one place.
The ids are those of the tokenizers library, from the encoder of ``bpe``, which
does each distinct word once.

Order is that of the written partitions.  Only the last sequence is partial;
its padded length is the next power of two at or above its tokens, at most the
window.  Defined results: a null or empty text is the end id alone; repeated
rows are packed each for itself; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import RankArrayBpe
from .chunks import ChunkEncoder, text_slices
from .common import stored, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
PIECES_PER_BATCH = 20_000


def token_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 end_id: int = END_ID) -> DataFrame:
    """Pass one: id, ids (binary little-endian uint32), n tokens, the number
    of the partition and the offset of the document in it."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        encoder, part, at = ChunkEncoder(RankArrayBpe(path).encode_distinct), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                ids, ends = encoder(texts)
                blobs = [np.append(ids[ends[i]:ends[i + 1]], end_id).astype("<u4").tobytes() for i in range(len(texts))]
                lengths = np.diff(ends) + 1
                starts = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(blobs, pa.binary()), pa.array(lengths), pa.array(starts),
                     pa.array(np.full(len(texts), part, dtype=np.int64))],
                    names=["id", "ids", "n", "local_start", "part"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, n bigint, local_start bigint, part bigint")


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """Global offset of each partition: the sum of the totals before it.  One
    row a partition of pass one, which is all that the window sorts."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start and length in the document's ids,
    ids_crc32, doc_tokens, sequence_id, offset, and the padded length of the
    sequence and the piece's ids (little-endian uint32)."""
    tokens = stored(token_totals(docs, id_col, text_col, path, end_id), "packing")
    offsets = partition_offsets(tokens)
    # Bounded: one row of two numbers for each partition of pass one.
    based = tokens.join(F.broadcast(offsets), "part")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    rows = based.select("id", "ids", (F.col("base") + F.col("local_start")).alias("at"), total.alias("total"))

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, blob, at, total in zip(*(c.to_pylist() for c in batch.columns)):
                n, start = len(blob) // 4, 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    piece = blob[4 * start:4 * (start + length)]
                    used = min(window, total - sequence * window)
                    out.append((doc, start, length, zlib.crc32(piece), n, sequence, offset,
                                min(window, 1 << (used - 1).bit_length()), piece))
                    start += length
                    if len(out) >= PIECES_PER_BATCH:
                        yield _batch(out, kind)
                        out = []
            if out:
                yield _batch(out, kind)

    kind = tokens.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                                "sequence_id bigint, offset bigint, padded_length bigint, ids binary"
                           ).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], id_kind: str) -> pa.RecordBatch:
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"]
    kinds = [pa.string() if id_kind == "string" else pa.int64(), *[pa.int64()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
