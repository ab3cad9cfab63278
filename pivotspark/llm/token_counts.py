"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, by a byte-level BPE, so the tokens at
a section's edge are those of the document and not of the section alone.  The
lengths of the tokens give their offsets; sections are joined to them by their
intervals, two binary searches a section.

A token that crosses a section's boundary is allocated by an explicit rule:
``first`` gives it to the section of its first byte, ``last`` to that of its
last byte, ``share`` to each section in proportion to the bytes it has there.
With disjoint sections that cover a text, each rule adds up to the document's
count.

Defined results: a null text counts as empty; an empty text has one empty section
and no tokens; given sections may overlap or be empty and are cut to the text
(a null list has none); repeated rows give equal rows; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import text_slices
from .common import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "share")


def _encoder(path: str):
    """(text -> ids, byte length of each id) of a rank file.  Strings of
    special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return encoding.encode_ordinary, lengths


#: Where sections end by default.  White space behind a sentence is its own,
#: so a token that begins with that space crosses into the next sentence.
BREAKS = {"lines": re.compile(r"\n"), "sentences": re.compile(r"[.!?]\s+|\n\s*")}


def text_spans(text: str, sections: str) -> list[tuple[int, int]]:
    """Character spans of the lines or sentences, which cover the text."""
    ends = [m.end() for m in BREAKS[sections].finditer(text)]
    return list(zip([0, *ends], [*ends, len(text)]))


def attribute(ends: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens [starts, ends) of a text allocated to the byte intervals [low,
    high).  Tokens are in order and cover the text without gaps."""
    if rule == "first":
        return np.searchsorted(starts, high) - np.searchsorted(starts, low)
    if rule == "last":
        return np.searchsorted(ends, high, side="right") - np.searchsorted(ends, low, side="right")
    if not len(starts):
        return np.zeros(len(low))

    def before(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ends, x, side="right"), len(ends) - 1)
        return at + (x - starts[at]) / (ends[at] - starts[at])

    return before(high) - before(low)


def crossing(ends: np.ndarray, starts: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether a token covers both sides of the byte offset ``edge``."""
    at = np.searchsorted(ends, edge, side="right")
    inside = at < len(starts)
    return inside & (starts[np.minimum(at, len(starts) - 1)] < edge) if len(starts) else inside


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: str = "sentences",
                 spans_col: str | None = None, rule: str = "first", path: str | None = None) -> DataFrame:
    """One row per section: id, section number, its span in characters,
    n_tokens (double for ``share``), crosses_end (a token goes on behind it)
    and doc_tokens.  Sections are the text's sentences or lines, or the
    array of structs (start, end) in ``spans_col``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary_path(VOCABULARY)
    spans = docs[spans_col].cast("array<struct<start:bigint,end:bigint>>") if spans_col else F.lit(None)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), spans.alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = pa.float64() if rule == "share" else pa.int64()
    names = ["id", "section", "start", "end", "n_tokens", "crosses_end", "doc_tokens"]

    def run(batches):
        encode, lengths = _encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                given = part.column(2).to_pylist() if spans_col else None
                sizes, columns = [], [[] for _ in range(6)]
                for i, text in enumerate(texts.to_pylist()):
                    raw = text.encode()
                    ends = np.cumsum(lengths[encode(text)] if text else np.empty(0, np.int64))
                    starts = np.append(0, ends[:-1]) if len(ends) else ends
                    own = text_spans(text, sections) if given is None else [
                        (s["start"] or 0, s["end"] or 0) for s in given[i] or [] if s is not None]
                    edges = np.clip(np.array(own, dtype=np.int64).reshape(-1, 2), 0, len(text))
                    edges[:, 1] = np.maximum(edges[:, 0], edges[:, 1])
                    at = edges
                    if len(raw) != len(text):  # characters to bytes
                        first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                        at = np.append(first, len(raw))[edges]
                    sizes.append(len(edges))
                    for column, values in zip(columns, (
                            np.arange(len(edges)), edges[:, 0], edges[:, 1], attribute(ends, starts, at[:, 0], at[:, 1], rule),
                            crossing(ends, starts, at[:, 1]), np.full(len(edges), len(ends)))):
                        column.append(values)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                flat = [np.concatenate(c) for c in columns]
                kinds = [pa.int64(), pa.int64(), pa.int64(), counted, pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(flat, kinds))], names=names)

    number = "double" if rule == "share" else "bigint"
    return rows.mapInArrow(run, f"id {kind}, section bigint, start bigint, end bigint, n_tokens {number}, "
                                "crosses_end boolean, doc_tokens bigint").withColumnRenamed("id", id_col)
