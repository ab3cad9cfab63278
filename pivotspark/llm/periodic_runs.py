"""Periodic runs of words in a document, by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) that no neighbouring word extends, of at least ``MIN_LENGTH`` words
and ``EXPONENT`` times its period.  On the diagonal of lag q, where word i
stands against word i + q, a run is a stretch of matches, at least
``max(MIN_LENGTH, EXPONENT * q) - q`` long: it holds equal k-grams q apart for
every k up to that overlap.  The k-grams are indexed for k = 5, 10, 20, ...:
5 is the smallest overlap that any lag guarantees, and a k serves the lags in
(k / 2, k] (5 all up to 5), whose overlap is never below k.  Within a run no
k-gram with k >= q recurs before q words, as its root is primitive.  So only
neighbouring occurrences of a k-gram are paired, never all of them, and a pair
whose lag the k serves is a seed.  A seed is extended word by word in both
directions, and a table of the furthest word covered on each lag passes over
the seeds inside.

The index is exact: k-grams get names from the names of two shorter ones that
overlap, and a k-gram that is the only one of its name in a document goes no
further.  The work for n words is O(n log n); memory is in proportion to the
longest text, or to a slice of ``SLICE_BYTES``.

Defined results: a null text counts as empty; an empty or blank text has no
run and an empty collapsed text; null and repeated ids are rows of their own;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import SLICE_BYTES, text_slices
from .common import SPACES, let

MIN_LENGTH = 6
EXPONENT = 4
SEED = 5
#: Words that an extension compares at first; each further step takes more.
STEP = 64


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the keys that occur more than once, ordered by key and then
    by place, and the number (from 0) of each one's key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.append(same, False) | np.append(False, same) if len(keys) else np.zeros(0, bool)
    first = np.append(True, ~same)[again] if len(keys) else again
    return order[again], np.cumsum(first) - 1


class _Grams:
    """Names of the k-grams that a document has more than once, for one k at a
    time; ``places`` are their first words in the order of names."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        self.end = ends[doc]
        self.names = np.full(len(words), -1, dtype=np.int64)
        self.k = 1
        self._set(np.arange(len(words)), doc * (int(words.max(initial=0)) + 1) + words)

    def _set(self, at: np.ndarray, keys: np.ndarray) -> None:
        chosen, names = _named(keys)
        self.names.fill(-1)
        self.places, self.ranks = at[chosen], names
        self.names[self.places] = names

    def grow(self, k: int) -> None:
        """From k-grams to longer ones, at most twice as long."""
        shift = k - self.k
        at = np.sort(self.places)
        at = at[at + k <= self.end[at]]
        right = self.names[at + shift]
        at, right = at[right >= 0], right[right >= 0]
        keys = self.names[at] * (int(self.ranks[-1]) + 1 if len(self.ranks) else 1) + right
        self.k = k
        self._set(at, keys)

    def seeds(self, above: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and lags of neighbouring occurrences, lags in (above, k]."""
        lag = self.places[1:] - self.places[:-1]
        pair = (self.ranks[1:] == self.ranks[:-1]) & (lag > above) & (lag <= self.k)
        return self.places[:-1][pair], lag[pair]


def _matches(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common start of two arrays of one length."""
    at, step = 0, STEP
    while at < len(left):
        differ = left[at:at + step] != right[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return len(left)


def _extend(words: np.ndarray, places: np.ndarray, lags: np.ndarray, doc: np.ndarray, starts: np.ndarray,
            ends: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) from seeds of one k."""
    order = np.lexsort((places, lags))
    places, lags = places[order], lags[order]
    found, covered, i = [], {}, 0
    cuts = np.append(np.flatnonzero(lags[1:] != lags[:-1]) + 1, len(lags)) if len(lags) else []
    for cut in cuts:
        q = int(lags[i])
        while i < cut:
            at = int(places[i])
            low, high = int(starts[doc[at]]), int(ends[doc[at]])
            begin = at - _matches(words[low:at][::-1], words[low + q:at + q][::-1])
            stop = at + _matches(words[at:high - q], words[at + q:high])
            covered[q] = stop
            if stop + q - begin >= max(min_length, exponent * q):
                found.append((begin, stop + q, q))
            i += int(np.searchsorted(places[i:cut], covered[q]))
    return found


def find_runs(words: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT,
              seed: int = SEED) -> np.ndarray:
    """Runs of the documents whose words (as numbers) begin at ``starts`` in
    ``words``: rows of document, start, length, period, ordered so.  The seed
    is at most ``max(min_length, exponent * q) - q`` for every period q, and a
    served k is at least q and at most (exponent - 1) * q: exponent is 3 or
    more."""
    ends = np.append(starts[1:], len(words))
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    grams, found, k, above = _Grams(words, doc, ends), [], 1, 0
    while k < seed and len(grams.places):
        k = min(2 * k, seed)
        grams.grow(k)
    while len(grams.places):
        found += _extend(words, *grams.seeds(above), doc, starts, ends, min_length, exponent)
        above, k = k, 2 * k
        grams.grow(k)
    runs = np.array(found, dtype=np.int64).reshape(-1, 3)
    which = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    runs = np.column_stack([which, runs[:, 0] - starts[which], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _slice_runs(texts: pa.Array, min_length: int, exponent: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and the text without what its runs repeat."""
    split = [t.split() for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.cumsum(sizes) - sizes
    flat = pa.array([w for words in split for w in words], pa.binary())
    codes = np.asarray(flat.dictionary_encode().indices, dtype=np.int64)
    runs = find_runs(codes, starts, min_length, exponent)
    # A run's words but for its first period go.
    step = np.zeros(len(codes) + 1, dtype=np.int64)
    begin = starts[runs[:, 0]] + runs[:, 1] if len(runs) else np.zeros(0, np.int64)
    np.add.at(step, begin + runs[:, 3], 1)
    np.add.at(step, begin + runs[:, 2], -1)
    kept = np.cumsum(step[:-1]) == 0
    changed = set(runs[:, 0].tolist())
    collapsed = [b" ".join(words if i not in changed else
                           [w for w, k in zip(words, kept[starts[i]:starts[i] + len(words)].tolist()) if k])
                 for i, words in enumerate(split)]
    offsets = np.searchsorted(runs[:, 0], np.arange(len(split) + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)],
                                      names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(collapsed, pa.binary()).cast(pa.string())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
           exponent: int = EXPONENT) -> DataFrame:
    """One row per document: id, ``runs`` (array of start, length, period in
    words, by start and period) and ``collapsed``, the words joined by one
    space without those that a run holds after its first period."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "__text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *_slice_runs(texts, min_length, exponent)],
                                                 names=["id", "runs", "collapsed"])

    schema = (f"id {rows.schema['id'].dataType.simpleString()}, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the documents, told by the checksum of the id,
    with a tail that repeats; a null id is not one of them."""
    h = F.crc32(docs[id_col].cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        old = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, old(i).cast("int"))), " ")).otherwise("")

    text = F.when(h % 10 == 0, let(words_of(docs[text_col]), tail)).otherwise(docs[text_col])
    return docs.select(docs[id_col].alias(id_col), text.alias("text"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``detect`` as counts, the greatest run and hashes."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
