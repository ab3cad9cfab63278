"""BPE encoding and decoding with a contiguous rank array.

A word is held as an array of parts beside an array with the merge rank of
each adjacent pair.  The smallest rank is found by a scan, the boundary behind
it deleted, and the two neighbouring ranks looked up anew, until no pair has a
rank.  All distinct words of a slice of rows advance together, one numpy row a
word, grouped by length.  Words beyond ``SHORT`` bytes, where rescans would be
quadratic, keep the same parts and ranks in a heap instead.

Defined results: a null or empty text has no tokens (and decodes to ""); any
text has the ids the tokenizers library gives it; repeated rows give equal
rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder, ranges, text_slices
from .common import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
SHORT = 64
#: Bytes of words that are merged together.
TOGETHER = 1 << 19
# ASCII marks but for the apostrophe (contractions) and "<" (special tokens).
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
# Letters below U+0250 that stay single when lower-cased, then marks.
PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]*[!-&(-/:;=-@\[-`{-~]*$"
NO_RANK = np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class RankArrayBpe:
    """Encoder and decoder of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        # Normalising and the class of rare letters are Unicode tables, which
        # must be of the same version: they come from the library.
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        end = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges] + [0], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # Fixed value: the vocabulary's own word pattern.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+").findall
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for token, i in {**vocab, **self.special}.items():
            self.token[i] = token.encode()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], NO_RANK)

    def _short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of one length, one a row; returns (parts, part counts).
        Each round takes one part from every word that can still merge."""
        out, counts = parts.copy(), np.full(len(parts), parts.shape[1])
        rows, width = np.arange(len(parts)), parts.shape[1]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while width > 1 and len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best != NO_RANK
            if not going.all():
                done = ~going
                out[rows[done], :width], counts[rows[done]] = parts[done], width
                rows, parts, ranks, at, best = rows[going], parts[going], ranks[going], at[going], best[going]
            each = np.arange(len(rows))
            parts[each, at] = self.merged[best]
            # Delete the boundary behind ``at``: what follows moves up by one.
            before = np.arange(width - 1) <= at[:, None]
            parts = np.where(before, parts[:, :-1], parts[:, 1:])
            width -= 1
            if width > 1:
                ranks = np.where(np.arange(width - 1) < at[:, None], ranks[:, :-1], ranks[:, 1:])
                for left in (at - 1, at):
                    ok = (left >= 0) & (left < width - 1)
                    i, j = each[ok], left[ok]
                    ranks[i, j] = self.ranks(parts[i, j], parts[i, j + 1])
        out[rows, :width], counts[rows] = parts, width
        return out, counts

    def _long(self, parts: np.ndarray) -> np.ndarray:
        """Merge one long word with a heap of (rank, place)."""
        parts, n = parts.tolist(), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist() + [int(NO_RANK)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NO_RANK]
        heapq.heapify(heap)
        gone = bytearray(n)

        def refresh(i: int) -> None:
            j = after[i]
            ranks[i] = int(NO_RANK) if j >= n else int(self.ranks(np.array([parts[i]]), np.array([parts[j]]))[0])
            if ranks[i] != NO_RANK:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if gone[i] or ranks[i] != rank:
                continue
            j = after[i]
            parts[i] = int(self.merged[rank])
            gone[j], after[i] = 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return np.array([p for p, g in zip(parts, gone) if not g], dtype=np.uint32)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their counts."""
        words = words.cast(pa.binary())
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes = np.diff(at)
        counts = np.zeros(len(words), dtype=np.int64)
        found = []
        order = np.argsort(sizes, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            width = int(sizes[own[0]])
            if not width:
                continue
            for low in range(0, len(own), max(1, TOGETHER // width)):
                rows = own[low:low + max(1, TOGETHER // width)]
                raw = data[at[rows][:, None] + np.arange(width)]
                parts = self.inner[raw]
                parts[:, -1] = self.final[raw[:, -1]]
                if width > SHORT:
                    for row, p in zip(rows, parts):
                        merged = self._long(p)
                        counts[row] = len(merged)
                        found.append((np.array([row]), merged))
                    continue
                parts, counts[rows] = self._short(parts)
                found.append((rows, parts[np.arange(width) < counts[rows][:, None]]))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.uint32)
        for rows, ids in found:
            flat[ranges(starts[rows], counts[rows])] = ids
        return flat, counts

    def split(self, chunk: str) -> list[bytes | int]:
        """Words of any space-free chunk as UTF-8 bytes; special tokens as ids."""
        if self.at_special and (hit := self.at_special.search(chunk)):
            return [*self.split(chunk[:hit.start()]), self.special[hit.group()], *self.split(chunk[hit.end():])]
        text = chunk.lower() if chunk.isascii() else self.normalize(chunk)
        if not text or max(text) < "ɐ":
            return [w.encode() for w in self.words(text)]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.pre_tokenize(text)]

    def encode_distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space-free chunks, one after the other, and their counts."""
        n = len(chunks)
        # Latin letters, then marks: at most two words, found in bulk.
        plain = np.asarray(pc.match_substring_regex(chunks, PLAIN))
        lower = pc.utf8_lower(chunks.filter(pa.array(plain)))
        stems = pc.ascii_rtrim(lower, characters=MARKS)
        tail_size = np.asarray(pc.binary_length(lower)) - np.asarray(pc.binary_length(stems))
        tailed = np.flatnonzero(tail_size)
        tails = [w[-k:].encode() for w, k in zip(lower.take(pa.array(tailed)).to_pylist(), tail_size[tailed].tolist())]
        rest = np.flatnonzero(~plain)
        split = [self.split(c) for c in chunks.take(pa.array(rest)).to_pylist()]

        stem_code = stems.dictionary_encode()
        known = stem_code.dictionary.cast(pa.binary())
        other = list({w: None for w in [*tails, *(w for s in split for w in s if isinstance(w, bytes))]})
        words = pa.concat_arrays([known, pa.array(other, pa.binary())])
        flat, counts = self._with_special(words)
        number = {w: len(known) + i for i, w in enumerate(other)} | {i: len(words) + k for k, i in enumerate(self.special.values())}

        # Words of each chunk: stem and tail, or the split ones; an empty stem
        # is a word without ids.
        size = np.empty(n, dtype=np.int64)
        size[plain] = 1 + (tail_size > 0)
        size[rest] = [len(s) for s in split]
        first = np.cumsum(size) - size
        listed = np.empty(int(size.sum()), dtype=np.int64)
        listed[first[plain]] = np.asarray(stem_code.indices)
        listed[first[plain][tailed] + 1] = [number[w] for w in tails]
        for at, s in zip(first[rest].tolist(), split):
            listed[at:at + len(s)] = [number[w] for w in s]
        starts = np.cumsum(counts) - counts
        ids = flat[ranges(starts[listed], counts[listed])]
        ends = np.concatenate([[0], np.cumsum(counts[listed])])
        return ids, ends[first + size] - ends[first]

    def _with_special(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = self.encode_words(words)
        special = np.array(list(self.special.values()), dtype=np.uint32)
        return np.append(flat, special), np.append(counts, np.ones(len(special), dtype=np.int64))

    def decode(self, ids) -> bytes:
        """UTF-8 of the decoded text: the tokens, joined by spaces (the file
        names no decoder)."""
        return b" ".join(map(self.token.__getitem__, ids))


def _encoded(path: str, batches, finish):
    """Record batches from ``finish(ids, decoded text)`` of each text."""
    bpe = RankArrayBpe(path)
    encoder = ChunkEncoder(bpe.encode_distinct)
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            ids, at = encoder(texts)
            whole = ids.astype("<u4")
            out = [finish(own.tobytes(), bpe.decode(own.tolist())) for own in (whole[a:b] for a, b in zip(at, at[1:]))]
            yield rows.column(0), pa.array(np.diff(at)), *zip(*out)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text.  Returns the id, n_tokens, ids (binary,
    little-endian uint32) and decoded text (UTF-8 binary)."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        for key, n, ids, decoded in _encoded(path, batches, lambda i, d: (i, d)):
            yield pa.RecordBatch.from_arrays([key, n, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                                             names=["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``round_trip`` with SHA-256 digests in place of ids and text; the large
    values stay inside the task."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        def hashed(ids: bytes, decoded: bytes) -> tuple[str, str]:
            return hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        for key, n, ids, decoded in _encoded(path, batches, hashed):
            yield pa.RecordBatch.from_arrays([key, n, pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed(
        "id", id_col)
