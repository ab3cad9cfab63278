"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases (the longest known phrase and one more
character, which becomes known).  The set of phrases is hashed, and a minimum
hash signature of ``HASHES`` values is the fingerprint; the share of equal
values of two fingerprints estimates how many phrases the texts have in common,
which is what a compressor would gain from seeing them together.

``PHRASES`` bounds a dictionary: a full one is replaced by an empty one, as in
LZW, so memory does not grow with a text.  A text whose end is edited shares
the parse of what was kept.

``with_edits`` needs each document's neighbour in descending id order.  Ids are
cut into ranges at quantiles, documents sorted inside their range, and the
first document of each range also goes to the range before as a guest; every
text moves once.  Ids are bigints.

Defined results: a null text counts as empty; an empty text has no phrase, its
fingerprint is all ones and like other empty texts'; equal texts have equal
fingerprints; equal ids are ordered by text; null ids come last; a single
document is its own neighbour; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 128
PHRASES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = 2048
#: Phrases that are hashed at a time.
PHRASE_BLOCK = 1 << 17
#: Characters that are parsed at a time.
TEXT_BLOCK = 1 << 20
ROWS = 256
#: Ranges of ids for each shuffle partition, and ids that a cut between two is
#: found from.
RANGES = 8
IDS_PER_CUT = 50


def _odd(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


_A, _B = _odd(1), _odd(2)
NO_PHRASE = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)


class Parser:
    """LZ78 parse that can go on from where it stands with another tail."""

    def __init__(self, limit: int = PHRASES):
        self.limit = limit
        self.root: dict = {}
        self.node = self.root
        self.size = 0

    def parse(self, text: str, start: int, end: int) -> tuple[list[int], list[tuple[dict, str]]]:
        """Phrase ends in text[start:end], and the entries made (as parent,
        character) before the dictionary was replaced."""
        root, node, size, limit = self.root, self.node, self.size, self.limit
        ends, made, kept = [], [], True
        at = start
        for c in text[start:end]:
            at += 1
            down = node.get(c)
            if down is None:
                node[c] = {}
                ends.append(at)
                if kept:
                    made.append((node, c))
                size += 1
                if size >= limit:
                    root, size, kept = {}, 0, False
                node = root
            else:
                node = down
        self.root, self.node, self.size = root, node, size
        return ends, made

    def signature(self, text: str, start: int, end: int, first: int) -> tuple[np.ndarray, int, list[tuple[dict, str]]]:
        """Signature of the phrases that end in text[start:end], the first of
        which begins at ``first``; where the next one begins; and the entries
        made in the dictionary that was there at the start.  A long text is
        parsed block by block."""
        out, undo, root = NO_PHRASE, [], self.root
        for at in range(start, end, TEXT_BLOCK):
            same = self.root is root
            ends, made = self.parse(text, at, min(end, at + TEXT_BLOCK))
            if same:
                undo += made
            if ends:
                out, first = np.minimum(out, phrase_signature(text, first, ends)), ends[-1]
        return out, first, undo

    def state(self):
        return self.root, self.node, self.size

    def back_to(self, state, made: list[tuple[dict, str]]) -> None:
        """Undo the entries made since ``state``."""
        for parent, c in reversed(made):
            del parent[c]
        self.root, self.node, self.size = state


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over the 64-bit ``hashes``."""
    out = NO_PHRASE
    for at in range(0, len(hashes), _STEP):
        h = hashes[at:at + _STEP]
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, ((low[:, None] * _A) ^ (high[:, None] * _B)).min(axis=0))
    return out


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the odd base and of its inverse, kept for later."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            powers = np.full(1 << (n - 1).bit_length(), base, dtype=np.uint64)
            powers[0] = 1
            _powers[i] = np.multiply.accumulate(powers)
    return _powers[0][:n], _powers[1][:n]


def _block_hashes(text: str, first: int, ends: list[int]) -> np.ndarray:
    codes = np.frombuffer(text[first:ends[-1]].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    up, down = _power_table(len(codes))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
    stops = np.array(ends, dtype=np.int64) - first
    starts = np.concatenate([np.zeros(1, np.int64), stops[:-1]])
    x = (prefix[stops] - prefix[starts]) * down[starts]
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= _MIX
    return x ^ x >> np.uint64(32)


def phrase_signature(text: str, first: int, ends: list[int]) -> np.ndarray:
    """Signature of the consecutive phrases that begin at ``first`` and end at
    ``ends``.  A phrase's hash is the polynomial of its code points, from
    prefix sums of code[k] * base**k and the inverse powers of the base."""
    out = NO_PHRASE
    for at in range(0, len(ends), PHRASE_BLOCK):
        own = ends[at:at + PHRASE_BLOCK]
        out = np.minimum(out, signature(_block_hashes(text, first, own)))
        first = own[-1]
    return out


def text_signature(text: str) -> np.ndarray:
    return Parser().signature(text, 0, len(text), 0)[0]


def edited_pair(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Signature of ``text``, the text with its last half replaced by as much
    of ``following`` (or all of it), and that text's signature."""
    kept = len(text) - len(text) // 2
    tail = following[:len(text) // 2]
    parser = Parser()
    common, first, _ = parser.signature(text, 0, kept, 0)
    state = parser.state()
    own, _, made = parser.signature(text, kept, len(text), first)
    parser.back_to(state, made)
    edited = text[:kept] + tail
    other, _, _ = parser.signature(edited, kept, len(edited), first)
    return np.minimum(common, own), edited, np.minimum(common, other)


def printed(signature: np.ndarray) -> str:
    """The low 16 bits of each value, as hex digits."""
    return signature.astype("<u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: an estimate of the phrase sets' overlap."""
    return float((a.astype(np.uint16) == b.astype(np.uint16)).mean())


def ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents dealt to ranges of descending bigint ids and sorted there,
    each range followed by its guest, the first document of the next one (of
    the first range after the last): columns range, guest, id, text."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ids = docs.select(docs[id_col].cast("long").alias("id"))
    # Several ranges meet in a partition, so that partitions come out even.
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounded: one cut and one head for each range.  Cuts only balance the
    # ranges, so some ids for each are enough to find them.
    share = min(1.0, IDS_PER_CUT * n / max(1, ids.count()))
    some = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    cuts = some.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 4 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    def range_of(column: pa.Array) -> np.ndarray:
        """Ranges count up as ids go down; null ids are in the last one."""
        known = np.asarray(column.fill_null(0), dtype=np.int64)
        return np.where(np.asarray(column.is_null()), len(cuts), len(cuts) - np.searchsorted(cuts, known, side="right"))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0))), batch.column(0)], names=["range", "id"])

    heads = {r["range"]: r["id"] for r in ids.mapInArrow(place, "range bigint, id bigint").groupBy("range").agg(
        F.max("id").alias("id")).collect()}
    order = sorted(heads)
    # The head of a range is a guest of the range before it.
    host = {heads[r]: order[k - 1] for k, r in enumerate(order)}

    def deal(batches):
        for batch in batches:
            at = range_of(batch.column(0))
            guests = [(i, host[x]) for i, x in enumerate(batch.column(0).to_pylist()) if x in host]
            take = pa.array([*range(len(at)), *(i for i, _ in guests)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, [h for _, h in guests]).astype(np.int64)),
                 pa.array([False] * len(at) + [True] * len(guests), pa.bool_()),
                 batch.column(0).take(take), batch.column(1).take(take)], names=["range", "guest", "id", "text"])

    dealt = rows.mapInArrow(deal, "range bigint, guest boolean, id bigint, text string")
    # Dealt in turn: a hash of so few numbers would leave partitions uneven.
    parts = n // RANGES
    return dealt.repartitionById(parts, F.pmod("range", F.lit(parts)).cast("int")).sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        out: list[tuple] = []
        last = None     # (id, text) that waits for the text behind it
        ready = None    # (id, n_chars, edited text's hash, own and edited signature) that waits for the next signature

        def close(record, following):
            key, n, digest, own, edited = record
            out.append((key, n, digest, printed(own), printed(edited), likeness(own, edited), likeness(own, following)))

        for batch in batches:
            for _, guest, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None:
                    if not guest:
                        last = key, text
                    continue  # a further guest of equal id
                own, edited, other = edited_pair(last[1], text)
                if ready is not None:
                    close(ready, own)
                ready = last[0], len(last[1]), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own, other
                last = (key, text)
                if guest:
                    close(ready, text_signature(text))
                    last = ready = None
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ranged(docs, id_col, text_col).mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double").withColumnRenamed("id", id_col)
