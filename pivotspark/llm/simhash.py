"""SimHash near-duplicate groups by a binary trie self-join.

Fingerprints within ``max_bits`` of each other are linked.  The 64 bits are
split into blocks so that linked fingerprints agree on at least ``same`` of
them; for every choice of ``same`` blocks, fingerprints meet in the bucket of
those bits (the node pairs of a trie with these bits on top in which nothing
differs yet).  Inside a bucket node pairs of the trie are walked together from
the top bit, their differing bits added up, and a pair is dropped once they
exceed ``max_bits``.  A bucket beyond ``CHUNK`` fingerprints is dealt into
chunks by hash and every pair of chunks becomes a task of its own; copies of
one fingerprint have been merged before.  A bucket reports a spanning forest
of its links, which has their components but never more edges than nodes.

Defined results: a null text counts as empty; texts without a word have
fingerprint zero and link like others; equal texts always share a group; null
ids take part, and a group of only null ids has a null component; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import pieces, text_slices
from .common import stored
from .components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
CHUNK = 2048
# Expected fingerprints in a bucket of evenly spread bits.
BUCKET = 512
LEAF_PAIRS = 64
#: Bytes beyond which a text is taken piece by piece.
LONG_TEXT = 8 << 20
WORK = 1 << 24
ROWS = 1 << 17
#: Bit k of every byte of a 64-bit word.
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits a position of the uint64 ``hashes``, a row for each segment
    that begins at ``starts`` (none empty).  Bytes hold 8 positions of up to
    255 hashes at once."""
    ends = np.append(starts[1:], len(hashes))
    pieces = -(-(ends - starts) // 255)
    first = np.cumsum(pieces) - pieces
    within = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    piece_starts = np.repeat(starts, pieces) + 255 * within
    lanes = np.stack([np.add.reduceat(hashes >> np.uint64(k) & _LANES, piece_starts) for k in range(8)], axis=1)
    # [piece, k, byte] -> bit 8 * byte + k
    counts = lanes.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64).astype(np.int64)
    return np.add.reduceat(counts, first, axis=0)


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([xxh(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1:].tolist())], dtype=np.uint64)


def _long_counts(text: bytes, shingle: int) -> tuple[np.ndarray, int]:
    """Bit counts and number of the shingles of a text taken piece by piece;
    the last words of a piece go on into the next."""
    counts, n, rest = np.zeros(64, dtype=np.int64), 0, []
    for piece in pieces(text):
        words = rest + piece.split()
        if len(words) >= shingle:
            hashes = _shingle_hashes(words, shingle)
            counts += bit_counts(hashes, np.array([0]))[0]
            n += len(hashes)
            words = words[len(words) - shingle + 1:] if shingle > 1 else []
        rest = words
    if not n and rest:
        counts, n = bit_counts(_shingle_hashes(rest, shingle), np.array([0]))[0], 1
    return counts, n


def text_fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each UTF-8 text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes, starts, rows, n = [], [], [], 0
    pack = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    for i, text in enumerate(texts):
        text = text.lower()
        if len(text) > LONG_TEXT:
            counts, size = _long_counts(text, shingle)
            out[i] = pack(2 * counts[None] > size)[0] if size else 0
            continue
        words = text.split()
        if words:
            hashes.append(_shingle_hashes(words, shingle))
            starts.append(n)
            rows.append(i)
            n += len(hashes[-1])
    if rows:
        starts, flat = np.array(starts), np.concatenate(hashes)
        sizes = np.diff(np.append(starts, n))
        out[rows] = pack(2 * bit_counts(flat, starts) > sizes[:, None])
    return out


def fingerprints(docs: DataFrame, columns: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``columns`` of ``docs`` and ``fp`` (the 64 bits as a bigint)."""
    rows = docs.select(*[docs[c] for c in columns], docs[text_col].alias("__text"))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                fp = text_fingerprints(texts.cast(pa.binary()).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))],
                                                 names=[*part.schema.names[:-1], "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, fp bigint")


def block_choices(n: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """Choices of (lowest bit, width) blocks: the fewest whose buckets hold
    about ``BUCKET`` of ``n`` evenly spread fingerprints (at most four blocks
    of choice; more only multiply the copies)."""
    for same in range(1, 5):
        blocks = max_bits + same
        edges = [64 * i // blocks for i in range(blocks + 1)]
        spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
        choices = [list(c) for c in combinations(spans, same)]
        if n >> min(sum(w for _, w in c) for c in choices) <= BUCKET:
            break
    return choices


def _bucket(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    key = F.lit(0).cast("long")
    for low, width in blocks:
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        key = F.shiftleft(key, width).bitwiseOR(part)
    return key


def _components(n: int, u: np.ndarray, v: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest index of each component once the pairs (u, v) join ``root``."""
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def trie_links(values: np.ndarray, pairs: np.ndarray, max_bits: int) -> np.ndarray:
    """Walks tries of the sorted uint64 ``values``.  ``pairs``: rows of lo1,
    hi1, lo2, hi2, the ranges of two tries (or twice the same one).  Returns a
    root index for each value; linked values of a pair share it."""
    root = np.arange(len(values))
    errors = np.zeros(len(pairs), dtype=np.int64)
    for bit in range(63, -2, -1):
        lo1, hi1, lo2, hi2 = pairs.T
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = (n1 * n2 <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            lo, n, other, m = lo1[small], n1[small], lo2[small], n2[small]
            for at in range(0, len(lo), ROWS):
                a, na, b, nb = (x[at:at + ROWS] for x in (lo, n, other, m))
                each = na * nb
                k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                width = np.repeat(nb, each)
                i, j = np.repeat(a, each) + k // width, np.repeat(b, each) + k % width
                near = (np.bitwise_count(values[i] ^ values[j]) <= max_bits) & (i != j)
                root = _components(len(values), i[near], j[near], root)
        pairs, errors = pairs[~small], errors[~small]
        if not len(pairs):
            break
        lo1, hi1, lo2, hi2 = pairs.T
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit) & np.uint64(1)).astype(np.int64))])
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        itself = (lo1 == lo2) & (hi1 == hi2)
        both = np.stack([lo1, mid1, lo2, mid2]), np.stack([mid1, hi1, mid2, hi2])
        cross = np.stack([lo1, mid1, mid2, hi2]), np.stack([mid1, hi1, lo2, mid2])
        pairs = np.concatenate([*both, cross[0], cross[1][:, ~itself]], axis=1).T
        errors = np.concatenate([errors, errors, errors + 1, errors[~itself] + 1])
        keep = (errors <= max_bits) & (pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])
        pairs, errors = pairs[keep], errors[keep]
    return root


def _forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Spanning edges of whole groups.  A group with one side is walked with
    itself, one with two sides across them."""
    order = np.lexsort((fp, side, group))
    group, side, fp = group[order], side[order], fp[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
    last = np.append(first[1:], len(fp))
    head, kind = group[first], side[first]
    alone = np.flatnonzero(kind == 0)
    left = np.flatnonzero((head[1:] == head[:-1]) & (kind[:-1] == -2) & (kind[1:] == -1))
    pairs = np.concatenate([
        np.stack([first[alone], last[alone], first[alone], last[alone]], axis=1),
        np.stack([first[left], last[left], first[left + 1], last[left + 1]], axis=1)])
    root = trie_links(fp, pairs, max_bits)
    child = np.flatnonzero(root != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays(
        [pa.array(fp[child].view(np.int64)), pa.array(fp[root[child]].view(np.int64))], names=["u", "v"])


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) over distinct ``classes(fp)`` whose components are those of
    all links of ``max_bits`` or fewer differing bits."""
    choices = block_choices(classes.count(), max_bits)
    fp = F.col("fp")
    keyed = classes.select(fp, F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), _bucket(fp, c).alias("bucket")) for i, c in enumerate(choices)])).alias("k")
    ).select("fp", "k.choice", "k.bucket")
    large = stored(keyed.groupBy("choice", "bucket").count().where(F.col("count") > CHUNK), "large-buckets")
    # A large bucket's row goes to every pair of chunks that has its own.
    chunks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / CHUNK)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    dealt = (keyed.join(large, ["choice", "bucket"], "left").withColumn("chunks", chunks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))))
    # Sides -2 and -1 are the two chunks of a pair, which are walked across;
    # a chunk by itself has side 0.
    dealt = dealt.select(
        F.xxhash64("choice", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(-2).alias("side"),
        "fp")
    dealt = dealt.repartition("group").sortWithinPartitions("group")

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1))
            rows = np.concatenate(held)
            ends = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1  # the last group may go on
            sizes = np.diff(np.append(0, ends))
            work, start = 0, 0
            for end, size in zip(ends.tolist(), sizes.tolist()):
                work += size * size
                if work >= WORK or end - start >= ROWS:
                    part = rows[start:end]
                    yield _forest(part[:, 0], part[:, 1], part[:, 2].view(np.uint64), max_bits)
                    work, start = 0, end
            held = [rows[start:]]
        if held and len(held[0]):
            rows = held[0]
            yield _forest(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.uint64), max_bits)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints(fp)`` of all rows -> (fp, root) of the fingerprints that are
    linked to a smaller one; all others are their own root."""
    return connected_components(links(stored(prints.select("fp").distinct(), "classes"), max_bits))


def with_root(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` (a stored table) with the ``root`` of each row's group.  The
    join reads two plain tables, so a hot fingerprint's rows can be split."""
    roots = stored(groups(prints, max_bits), "roots").select(F.col("u").alias("fp"), "root")
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id
    (the smallest id of its group)."""
    prints = stored(fingerprints(docs, [id_col], text_col, shingle), "simhash")
    rooted = stored(with_root(prints, max_bits), "simhash-roots")
    smallest = stored(rooted.groupBy("root").agg(F.min(id_col).alias("component_id")), "simhash-groups")
    return rooted.join(smallest, "root").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the smallest id (nulls last, then
    any one of equal ids).  Rows get a number of their own, written with them,
    so that repeated ids are told apart."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    prints = stored(fingerprints(numbered, [row, id_col], text_col, shingle), "simhash")
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row)))
    kept = stored(with_root(prints, max_bits).groupBy("root").agg(first.alias("k")).select(f"k.{row}"), "simhash-kept")
    # The rows are shuffled at every size: a list that is broadcast while it is
    # small says nothing about the disk that a large one needs.
    return numbered.join(kept.hint("merge"), row, "left_semi").select(docs.columns)
