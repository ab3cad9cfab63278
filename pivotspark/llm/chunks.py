"""Token ids of whole texts by way of their distinct space-free chunks.

For a tokenizer that drops white space no token spans a space, so a text's ids
are the ids of its chunks one after the other.  Each distinct chunk of a slice
of rows is encoded once; the ids of all occurrences are gathered with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row slices of about ``limit`` text bytes (at least one row) with their
    texts, nulls as empty strings."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    sizes = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """Consecutive parts of a long text of about ``size`` bytes, cut at ASCII
    white space (a part without any is longer)."""
    at = 0
    while len(text) - at > size:
        hit = _SPACE.search(text, at + size)
        if hit is None:
            break
        yield text[at:hit.end()]
        at = hit.end()
    yield text[at:]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class ChunkEncoder:
    """Encodes slices of texts.  ``encode_distinct`` gives the ids of all
    strings of an Arrow array, one after the other, and their counts."""

    def __init__(self, encode_distinct: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode_distinct = encode_distinct

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Returns the ids of all texts and the offset of each text in them.  A
        very long text is encoded piece by piece."""
        if len(texts) == 1 and texts[0].as_buffer().size > 2 * SLICE_BYTES:
            whole = texts[0].as_buffer().to_pybytes()
            ids = np.concatenate([self._encode(pa.array([p.decode()], texts.type))[0] for p in pieces(whole)])
            return ids, np.array([0, len(ids)])
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        chunk_at = np.asarray(lists.offsets, dtype=np.int64)
        chunk_at -= chunk_at[0]
        coded = lists.flatten().dictionary_encode()
        flat, lengths = self.encode_distinct(coded.dictionary)
        which = np.asarray(coded.indices)
        starts = np.cumsum(lengths) - lengths
        ids = flat[ranges(starts[which], lengths[which])]
        ends = np.concatenate([[0], np.cumsum(lengths[which])])
        return ids, ends[chunk_at]
