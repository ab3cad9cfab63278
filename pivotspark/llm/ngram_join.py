"""Jaccard self-join of word shingles by parity sketches.

A document's set holds the 64-bit hashes of its distinct shingles.  XOR-hashing
a set into bits gives its parity sketch: two sketches differ at most in the
positions of the symmetric difference, so their Hamming distance is a lower
bound of its size, which for linked sets A and B is at most
``(|A| + |B|) * (100 - percent) / (100 + percent)``.

Sets meet by the size band of the smaller one.  A band has a bound ``d`` of the
difference and cuts the tokens into ``d + 1 + spare + weak`` blocks by hash;
each block is a sketch of its own, kept as the XOR of its tokens' hashes (a
sketch of 2^64 bits, folded to the XOR of its positions).  Blocks in which two
linked sets differ are ``d`` at most, so they agree on ``1 + spare + weak`` or
more.  A set leaves out its ``weak`` blocks of fewest tokens; as that order is
the same for all sets, ``1 + spare`` agreeing blocks remain, and up to
``spare`` blocks shared by very many sets can be left out in turn.

Sets that agree on a block meet in its bucket.  First each is paired with the
bucket's smallest key only, pairs whose compact sketches differ too much are
dropped, and the rest is verified on the sets, which merges groups of copies
without their pairs.  Then buckets that still hold several components are
walked: all pairs of different components are held against the sketch bound
inside the task, a large bucket as pairs of chunks, and those that pass are
verified.  Only links are decided by the exact sets, so none is lost and none
is made up.  The walk is made twice: first every set brings its nearest one in the
bucket only, whose links merge what is left of large groups, then all pairs of
sets that have a second near one there.  Pairs tried before (those with the
bucket's smallest key, and a set's nearest ones in all its buckets) are not
brought again, so a large group of near copies makes no pairs with every set
that just misses it, bucket after bucket.
Buckets of more than ``HOT`` sets do not count for sets that have
``spare`` of them or fewer in the band, as above.

Equal sets are one node, known by a 64-bit hash.  Buckets that a 64th of the
texts shows to be very large are dealt out by key from the start; this decides
only where rows meet.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing, not even with each other; with fewer words than a shingle the
whole sequence is the only one; null ids take part, a group of only null ids
has a null component; repeated rows are rows of their own; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ranges, text_slices
from .common import stored
from .components import connected_components
from .url_filter import BITS_PER_ENTRY, BROADCAST_BLOCKS, bloom_bits, bloom_blocks

SHINGLE = 5
PERCENT = 80
#: Growth of the size bands.
BAND = 1.25
#: Sets in a bucket beyond which it counts as hot, and in one walked chunk.
HOT = 1024
CHUNK = 1024
#: Share of the texts that very large buckets are looked for in, the sets of
#: such a bucket there, and how many buckets are dealt out at most.
LOOK = 64
LOOK_SETS = 256
LOOK_MOST = 4096
#: Pairs of a set that are decided in one place.
TOGETHER = 256
#: Bytes of the sketch differences held at a time.
WORK = 1 << 24
ROWS = 1 << 16
#: Keys that a task remembers in order to send a set's blocks once.
SEEN = 1 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
                 dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ x >> np.uint64(30)) * _MIX
    x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


def bands(top: int = 1 << 40) -> np.ndarray:
    """Smallest set size of each band."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, dtype=np.int64)


LOW = bands()


def most_apart(total, percent: int):
    """Greatest symmetric difference of two linked sets of ``total`` tokens."""
    return total * (100 - percent) // (100 + percent)


def plan(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each band: blocks, weak blocks and spare blocks."""
    small = LOW[1:] - 1
    need = most_apart(small + small * 100 // percent, percent) + 1
    spare, weak = need // 10 + 1, need // 5 + 2
    return need + spare + weak, weak, spare


def token_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text, one after the
    other, and each text's number of them."""
    from xxhash import xxh64_intdigest as xxh

    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    words = np.array([xxh(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)[np.asarray(coded.indices)]
    starts = np.cumsum(sizes) - sizes
    # A place holds the shingle that begins there; a short text's only one
    # holds what there is of it, and its length.
    width = np.minimum(sizes, shingle)
    count = np.maximum(sizes - shingle + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(split)), count)
    at = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(count) - count), count)
    hashes = width[doc].astype(np.uint64)
    for j in range(shingle):
        have = j < width[doc]
        # Each place has a multiplier of its own; odd ones for any shingle.
        factor = _MULT[j % len(_MULT)] + np.uint64(2 * (j // len(_MULT)))
        hashes[have] += mixed(words[at[have] + j] * factor + np.uint64(j))
    hashes = mixed(hashes)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[:len(doc)]
    return hashes[fresh], np.bincount(doc[fresh], minlength=len(split))


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set; 0 for an empty one."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if len(starts):
        out[some] = mixed(np.add.reduceat(mixed(hashes ^ _MULT[2]), starts) + counts[some].astype(np.uint64))
    return out


def sketch_bits(counts: np.ndarray) -> np.ndarray:
    """Length of a set's compact sketch: a power of two, twice the set."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, 2 * counts))).astype(np.int64))


def sketches(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    bits = sketch_bits(counts)
    offsets = np.cumsum(bits >> 6) - (bits >> 6)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = hashes & (bits[doc] - 1).astype(np.uint64)
    words = np.zeros(int((bits >> 6).sum()), dtype=np.uint64)
    np.bitwise_xor.at(words, offsets[doc] + (place >> np.uint64(6)).astype(np.int64),
                      np.uint64(1) << (place & np.uint64(63)))
    raw = words.tobytes()
    return [raw[8 * a:8 * a + (b >> 3)] for a, b in zip(offsets.tolist(), bits.tolist())]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch at a smaller power of two of bytes."""
    words = np.frombuffer(sketch, dtype=np.uint64)
    while len(words) * 8 > size:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


def blocks(hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each set, as (set, bucket); the low byte of a bucket is its
    band, 40 bits of hash are above it (a chance meeting is only a candidate).
    A set is in the bands of its possible smaller partners."""
    total, weak, _ = plan(percent)
    own = np.searchsorted(LOW, counts, side="right") - 1
    least = np.searchsorted(LOW, -(-counts * percent // 100), side="right") - 1
    out_set, out_bucket = [], []
    starts = np.cumsum(counts) - counts
    for down in range(int((own - least).max(initial=0)) + 1):
        sets = np.flatnonzero((counts > 0) & (own - down >= least))
        band = own[sets] - down
        n = total[band]
        offset = np.cumsum(n) - n
        size = counts[sets]
        row = np.repeat(np.arange(len(sets)), size)
        h = hashes[np.arange(len(row)) + np.repeat(starts[sets] - (np.cumsum(size) - size), size)]
        cell = offset[row] + ((h >> np.uint64(32)) * n[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cells = int(n.sum())
        value = np.zeros(cells, dtype=np.uint64)
        np.bitwise_xor.at(value, cell, h)
        tokens = np.minimum(np.bincount(cell, minlength=cells), 255).astype(np.uint64)
        of = np.repeat(np.arange(len(sets)), n)
        # Fewest tokens first, then by value and by block: the same for all.
        order = np.lexsort((tokens << np.uint64(56) | value >> np.uint64(8), of))
        rank = np.arange(cells) - offset[of]
        kept = order[rank >= weak[band][of]]
        level = band[of[kept]].astype(np.uint64)
        bucket = mixed(value[kept] + mixed((kept - offset[of[kept]]).astype(np.uint64) * _MULT[0] + level))
        out_set.append(sets[of[kept]])
        out_bucket.append(bucket >> np.uint64(24) << np.uint64(8) | level)
    return np.concatenate(out_set), np.concatenate(out_bucket)


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, n, key, sketch of each document, and ``th``, a hash of its text."""
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("__text"))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                hashes, counts = token_sets(texts.cast(pa.binary()).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array(set_keys(hashes, counts).view(np.int64)),
                     pa.array(sketches(hashes, counts), pa.binary())], names=["id", "th", "n", "key", "sketch"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th bigint, n bigint, key bigint, sketch binary")


def meetings(docs: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(key, bucket) of the sets; a task sends a set once.  In this order what
    a set's rows share lies together, which shuffles smaller."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_slices(batch, "__text"):
                hashes, counts = token_sets(texts.cast(pa.binary()).to_pylist(), shingle)
                keys = set_keys(hashes, counts)
                new = np.array([n > 0 and k not in seen and not seen.add(k) for k, n in zip(keys.tolist(), counts.tolist())], dtype=bool)
                if len(seen) > SEEN:
                    seen.clear()
                hashes, counts, keys = hashes[np.repeat(new, counts)], counts[new], keys[new]
                if len(counts):
                    which, bucket = blocks(hashes, counts, percent)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[which].view(np.int64)), pa.array(bucket.view(np.int64))], names=["key", "bucket"])

    return docs.select(docs[text_col].alias("__text")).mapInArrow(run, "key bigint, bucket bigint")


def large_buckets(docs: DataFrame, text_col: str, shingle: int, percent: int) -> dict[int, int]:
    """Buckets that hold very many sets, and into how many parts they are
    dealt.  Bounded by ``LOOK_MOST``; found in a share of the texts."""
    some = docs.where(F.pmod(F.xxhash64(docs[text_col]), F.lit(LOOK)) == 0)
    counts = meetings(some, text_col, shingle, percent).distinct().groupBy("bucket").count()
    rows = counts.where(F.col("count") >= LOOK_SETS).orderBy(F.col("count").desc(), "bucket").limit(LOOK_MOST).collect()
    return {r["bucket"]: -(-r["count"] * LOOK // (LOOK_SETS * LOOK // 4)) for r in rows}


def shared_buckets(met: DataFrame, large: dict[int, int]) -> DataFrame:
    """(bucket, key, low, size) of buckets that several sets are in; low is the
    smallest key.  A part of a large bucket counts as one, of size -1."""
    known = np.array(sorted(large), dtype=np.int64)
    parts = np.array([large[b] for b in known.tolist()], dtype=np.int64)

    def deal(batches):
        for batch in batches:
            key, bucket = (np.asarray(c, dtype=np.int64) for c in batch.columns)
            part = np.zeros(len(bucket), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
                hit = known[at] == bucket
                part[hit] = 1 + (key[hit].view(np.uint64) % parts[at[hit]].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["key", "bucket", "part"])

    if large:
        met = met.mapInArrow(deal, "key bigint, bucket bigint, part int")
    else:
        met = met.withColumn("part", F.lit(0))
    met = met.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key")

    def groups(rows: np.ndarray):
        """Rows of whole buckets."""
        first = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2]))
        rows = rows[first | np.append(True, rows[1:, 1] != rows[:-1, 1])]
        first = np.flatnonzero(np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])))
        sizes = np.diff(np.append(first, len(rows)))
        lows, each = np.repeat(rows[first, 1], sizes), np.repeat(sizes, sizes)
        each = np.where(rows[:, 2] > 0, -1, each)
        keep = each != 1
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[keep])) for x in (rows[:, 0], rows[:, 1], lows, each)],
                                          names=["bucket", "key", "low", "size"])

    def run(batches):
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in (1, 0, 2)], axis=1))
            count += len(held[-1])
            if count < ROWS:
                continue
            rows = np.concatenate(held)
            # The last bucket may go on.
            last = rows[-1, [0, 2]]
            cut = len(rows) - int((rows[::-1][:, [0, 2]] != last).any(axis=1).argmax()) if (rows[0, [0, 2]] != last).any() else 0
            if cut:
                yield groups(rows[:cut])
            held, count = [rows[cut:]], 0
        if held:
            rows = np.concatenate(held)
            if len(rows):
                yield groups(rows)

    return met.mapInArrow(run, "bucket bigint, key bigint, low bigint, size bigint")


def _near(n_u: Column, n_v: Column, percent: int) -> Column:
    return F.least(n_u, n_v) * 100 >= F.greatest(n_u, n_v) * percent


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose sizes and compact sketches may belong to linked sets."""
    side = lambda name: classes.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"),
                                       F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(_near(F.col("n_u"), F.col("n_v"), percent))

    def run(batches):
        for batch in batches:
            u, v, n, m, s, t = (batch.column(batch.schema.get_field_index(c)) for c in ("u", "v", "n_u", "n_v", "s_u", "s_v"))
            most = most_apart(np.asarray(n) + np.asarray(m), percent)
            apart = []
            for a, b in zip(s.to_pylist(), t.to_pylist()):
                size = min(len(a), len(b))
                apart.append(int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()))
            keep = pa.array(np.array(apart, dtype=np.int64) <= most, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    return both.mapInArrow(run, "u bigint, v bigint")


def wanted_texts(docs: DataFrame, text_col: str, texts: DataFrame) -> DataFrame:
    """(th, __text) of the documents whose text is one of ``texts(th)``, and of
    a few others: a Bloom filter goes to the documents, so that the other texts
    need not be shuffled to be joined."""
    n_blocks = min(BROADCAST_BLOCKS, max(1, -(-texts.count() * BITS_PER_ENTRY // 64)))
    blocks = F.broadcast(bloom_blocks(texts, "th", n_blocks))
    rows = docs.select(F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("__text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("th"), F.lit(n_blocks))).join(blocks, "block")
    return rows.where(F.col("word").bitwiseAND(bloom_bits(F.col("th"))) == bloom_bits(F.col("th"))).select("th", "__text")


def links(docs: DataFrame, text_col: str, pairs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a stored table) of linked sets, by the sets themselves.  A
    set goes from its text straight to where its pairs are decided: with the
    smaller key of each, up to ``TOGETHER`` pairs in one place.  Texts without
    a pair stay where they are."""
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "v").withColumn("group", F.xxhash64("v", F.pmod(F.xxhash64("u"), F.col("parts"))))
    dealt = stored(dealt.select("u", "v", "group"), "join-dealt")
    ends = dealt.select(F.col("u").alias("key"), "group", F.col("v").alias("with")).unionByName(
        dealt.select(F.col("v").alias("key"), "group", F.col("v").alias("with")).distinct())
    needed = ends.groupBy("key").agg(F.collect_list(F.struct("group", "with")).alias("ends"))
    texts = stored(classes.join(needed, "key").select("th", "key", "ends"), "join-texts")
    rows = wanted_texts(docs, text_col, texts).join(texts, "th")

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            for slice_, part in text_slices(batch, "__text"):
                hashes, counts = token_sets(part.cast(pa.binary()).to_pylist(), shingle)
                wanted = slice_.column(slice_.schema.get_field_index("key")).to_pylist()
                keys = set_keys(hashes, counts).view(np.int64).tolist()
                new = np.array([k == w and k not in seen and not seen.add(k) for k, w in zip(keys, wanted)], dtype=bool)
                if len(seen) > SEEN:
                    seen.clear()
                own = slice_.column(slice_.schema.get_field_index("ends")).filter(pa.array(new))
                hashes, counts, keys = hashes[np.repeat(new, counts)], counts[new], np.array(keys, dtype=np.int64)[new]
                starts = np.cumsum(counts) - counts
                which = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths(), dtype=np.int64))
                group, other = (np.asarray(x, dtype=np.int64) for x in own.flatten().flatten())
                for i in range(0, len(which), 256):
                    at = which[i:i + 256]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[at])).astype(np.int32)),
                                                     pa.array(hashes[ranges(starts[at], counts[at])].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (group[i:i + 256], other[i:i + 256], keys[at])] + [lists],
                        names=["group", "with", "key", "tokens"])

    # The set that the others are held against comes first; a group is one's,
    # but for equal hashes.
    met = rows.mapInArrow(sets, "group bigint, with bigint, key bigint, tokens array<bigint>")
    met = met.repartition("group").sortWithinPartitions("group", "with", F.col("key") != F.col("with"))

    def verify(batches):
        centre, whose = None, None
        for batch in batches:
            other, key = (np.asarray(batch.column(i), dtype=np.int64) for i in (1, 2))
            u, v = [], []
            for i in range(len(key)):
                own = np.asarray(batch.column(3)[i].values)
                if key[i] == other[i]:
                    centre, whose = own, key[i]
                elif whose == other[i]:
                    same = len(np.intersect1d(own, centre, assume_unique=True))
                    if 100 * same >= percent * (len(own) + len(centre) - same):
                        u.append(key[i])
                        v.append(other[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return met.mapInArrow(verify, "u bigint, v bigint")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("u").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def open_buckets(shared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(bucket, key, low, root) of the buckets of three or more sets that are in
    several components, without what the spare blocks allow to leave out."""
    rooted = stored(_rooted(shared.where("size <> 2").select("bucket", "key", "low", "size"), roots), "join-rooted")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"),
                                           F.min("size").alias("least"), F.max("size").alias("most")).where("a <> b")
    several = several.select("bucket", ((F.col("least") < 0) | (F.col("most") > HOT)).alias("hot"))
    # Read twice below: brought together once.
    rows = stored(rooted.join(several, "bucket").select("bucket", "key", "low", "root", "hot"), "join-open")
    spare = F.element_at(F.lit([int(s) for s in plan(percent)[2]]), (F.col("bucket").bitwiseAND(F.lit(255)) + 1).cast("int"))
    band = F.col("bucket").bitwiseAND(F.lit(255))
    free = rows.where("hot").groupBy("key", band.alias("band")).agg(F.count("*").alias("z"), F.first(spare).alias("spare")).where("z <= spare")
    free = free.select("key", "band", F.lit(True).alias("free"))
    return rows.withColumn("band", band).join(free, ["key", "band"], "left").where("not hot or free is null").select("bucket", "key", "low", "root")


def walk(rows: np.ndarray, sketch: list[bytes], tried: list[np.ndarray], percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """One bucket's sets, or two chunks of it, held against each other (side 0
    against itself, -2 against -1): pairs of different roots within the sketch
    bound that were not tried, with the bucket's smallest key or as ``tried``
    lists for each set.  ``every``: all of them; else, for each set that has
    any, the one with the nearest sketch.  Columns of ``rows``: key, root, n,
    side, low; returns row numbers and, for each, whether its first set has
    several."""
    size = min(map(len, sketch))
    words = np.stack([folded(s, size) for s in sketch])
    key, root, n, side, low = rows.T
    if side[0] == 0:
        left = right = np.arange(len(rows))
    else:
        left, right = np.flatnonzero(side == -2), np.flatnonzero(side == -1)
    none = np.iinfo(np.int64).max
    out, block = [np.zeros((0, 2), np.int64)], max(1, WORK // (8 * max(1, len(right)) * words.shape[1]))
    best, partner, count = np.full(len(rows), none), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(left), block):
        a = left[at:at + block]
        apart = np.bitwise_count(words[a][:, None] ^ words[right][None]).sum(axis=2, dtype=np.int64)
        near = (apart <= most_apart(n[a][:, None] + n[right][None], percent)) & (root[a][:, None] != root[right][None])
        near &= np.minimum(n[a][:, None], n[right][None]) * 100 >= np.maximum(n[a][:, None], n[right][None]) * percent
        near &= (low[a][:, None] != key[right][None]) & (key[a][:, None] != low[right][None])
        if every:
            i, j = np.nonzero(near)
            out.append(np.stack([a[i], right[j]], axis=1))
        elif near.any():
            apart[~near] = none
            for own, other, least, axis in ((a, right, apart.argmin(axis=1), 1), (right, a, apart.argmin(axis=0), 0)):
                found = np.take_along_axis(apart, np.expand_dims(least, axis), axis).ravel()
                better = found < best[own]
                best[own[better]], partner[own[better]] = found[better], other[least[better]]
                if axis or side[0]:
                    count[own] += near.sum(axis=axis)
    if not every:
        has = np.flatnonzero(best < none)
        return np.stack([has, partner[has]], axis=1), count[has] > 1
    found = np.concatenate(out)
    if len(found):
        order = np.argsort(key)
        own = np.repeat(np.arange(len(rows)), list(map(len, tried)))
        known = np.concatenate(tried)
        at = order[np.minimum(np.searchsorted(key, known, sorter=order), len(rows) - 1)]
        own, at = own[key[at] == known], at[key[at] == known]
        i, j = found.T
        found = found[~np.isin(i * len(rows) + j, np.concatenate([own * len(rows) + at, at * len(rows) + own]))]
    return found, np.ones(len(found), dtype=bool)


def walked(rows: DataFrame, classes: DataFrame, percent: int, every: bool) -> DataFrame:
    """(bucket, u, v, low, several) of the open buckets' sets that may be
    linked; ``several`` when u has more than one such set there.  ``rows`` may
    have ``tried``, keys that a set was held against before."""
    if "tried" not in rows.columns:
        rows = rows.withColumn("tried", F.array().cast("array<bigint>"))
    sizes = stored(rows.groupBy("bucket").count().where(F.col("count") > CHUNK), "join-large")
    chunks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / CHUNK)
    dealt = (rows.join(sizes, "bucket", "left").withColumn("chunks", chunks)
             .withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))))
    dealt = dealt.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "key", "root", "bucket", "low", "tried",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(-2).cast("long").alias("side"))
    dealt = dealt.join(classes.select("key", "n", "sketch"), "key").select(
        "group", "key", "root", "n", "side", "low", "bucket", "sketch", "tried")
    dealt = dealt.repartition("group").sortWithinPartitions("group")

    def pairs_of(held):
        group, bucket, sketch, tried = held[0], held[6], held[7], held[8]
        rows = np.stack(held[1:6], axis=1)
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        found, more = [np.zeros((0, 2), np.int64)], [np.zeros(0, dtype=bool)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                pairs, several = walk(rows[a:b], sketch[a:b], tried[a:b], percent, every)
                found.append(a + pairs)
                more.append(several)
        u, v = np.concatenate(found).T
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x)) for x in (bucket[u], rows[u, 0], rows[v, 0], rows[u, 4], np.concatenate(more))],
            names=["bucket", "u", "v", "low", "several"])

    def run(batches):
        held = None
        for batch in batches:
            lists = batch.column(8)
            cols = [np.asarray(batch.column(i), dtype=np.int64) for i in range(7)] + [
                batch.column(7).to_pylist(), [np.asarray(lists[i].values, dtype=np.int64) for i in range(len(lists))]]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held[:7], cols[:7])] + [h + c for h, c in zip(held[7:], cols[7:])]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if cut:
                yield pairs_of([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield pairs_of(held)

    return dealt.mapInArrow(run, "bucket bigint, u bigint, v bigint, low bigint, several boolean")


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct unordered pairs (u, v), the larger one first."""
    return rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def linked_classes(docs: DataFrame, printed: DataFrame, text_col: str = "text", shingle: int = SHINGLE,
                   percent: int = PERCENT) -> DataFrame:
    """(u, root) of the sets' keys that are linked to a smaller one, at any
    number of links."""
    classes = stored(printed.where("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("th").alias("th")), "join-classes")
    large = large_buckets(docs, text_col, shingle, percent)
    shared = stored(shared_buckets(meetings(docs, text_col, shingle, percent), large), "join-buckets")
    stars = shared.where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v")).distinct()
    near = stored(near_pairs(stars, classes, percent), "join-near")
    first = stored(links(docs, text_col, near, classes, shingle, percent), "join-links")
    roots = stored(connected_components(first), "join-roots")
    # Each set's nearest in every open bucket, then all pairs of what that has
    # left apart: a pair not tried there is of two sets that have several.
    closest = stored(walked(open_buckets(shared, roots, percent), classes, percent, every=False), "join-closest")
    near = stored(_pairs(closest), "join-near")
    second = links(docs, text_col, near, classes, shingle, percent)
    roots = stored(connected_components(roots.select("u", F.col("root").alias("v")).unionByName(second)), "join-roots")
    members = closest.where("several").groupBy("bucket", F.col("u").alias("key")).agg(F.min("low").alias("low"))
    # A set has at most two of these for each of its buckets.
    tried = closest.groupBy(F.col("u").alias("key")).agg(F.array_union(F.collect_set("v"), F.collect_set("low")).alias("tried"))
    rooted = stored(_rooted(members, roots), "join-rooted")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    rest = walked(rooted.join(several, "bucket").join(tried, "key"), classes, percent, every=True)
    near = stored(_pairs(rest).join(near, ["u", "v"], "left_anti"), "join-near")
    third = links(docs, text_col, near, classes, shingle, percent)
    return connected_components(roots.select("u", F.col("root").alias("v")).unionByName(third))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that
    links lead to, its own included)."""
    printed = stored(prints(docs, id_col, text_col, shingle), "join-prints")
    roots = stored(linked_classes(docs, printed, text_col, shingle, percent), "join-roots").select(F.col("u").alias("key"), "root")
    classes = printed.where("n > 0").groupBy("key").agg(F.min("id").alias("least")).join(roots, "key", "left")
    classes = stored(classes.select("key", "least", F.coalesce("root", "key").alias("root")), "join-classes")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(classes.join(smallest, "root").select("key", "component_id"), "join-members")
    return printed.join(members, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def oracle_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """Brute force in DuckDB: common shingles of all pairs, then reachability."""
    return f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (
  select doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') as t
  from (select doc_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - {shingle - 1}) + 1)) as i from words)),
tokens as (select distinct doc_id, md5(t) as t from shingles),
sets as (select words.doc_id, count(t) as n from words left join tokens using (doc_id) group by all),
pairs as (
  select u, v from (
    select a.doc_id as u, b.doc_id as v, count(*) as shared from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id)
  join sets a on a.doc_id = u join sets b on b.doc_id = v where 100 * shared >= {percent} * (a.n + b.n - shared)),
reach as (
  select doc_id as u, doc_id as v from sets
  union select reach.u, pairs.v from reach join pairs on pairs.u = reach.v)
select doc_id, n as n_shingles, component_id
from sets join (select u as doc_id, min(v) as component_id from reach group by u) using (doc_id)
"""
