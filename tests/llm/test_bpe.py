import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pivotspark.llm import bpe as B
from pivotspark.llm.chunks import ChunkEncoder
from pivotspark.llm.common import vocabulary_path

from .helpers import ODD_TEXTS, documents, prose


@pytest.fixture(scope="module")
def own():
    return B.RankArrayBpe(vocabulary_path(B.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(B.VOCABULARY))


def test_ids_are_those_of_the_library(own, library):
    rng = random.Random(1)
    ranges = [*range(1, 0x300), *range(0x300, 0x370), *range(0x370, 0x600), *range(0x2000, 0x2070), *range(0x1F300, 0x1F650)]
    texts = [t or "" for t in ODD_TEXTS]
    texts += ["".join(chr(rng.choice(ranges)) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("aAbeé'sStT.,<| \n\t1") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["ab" * 3000, "the" * 40, "é" * 200, prose(1, 2000)]
    ids, at = ChunkEncoder(own.encode_distinct)(pa.array(texts))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == e.ids, texts[i]


def test_long_texts_piece_by_piece(own, library, monkeypatch):
    from pivotspark.llm import chunks as C
    text = " ".join(t or "" for t in ODD_TEXTS)
    assert b"".join(C.pieces(text.encode(), 5)) == text.encode()
    monkeypatch.setattr(C, "SLICE_BYTES", 100)
    monkeypatch.setattr(C.pieces, "__defaults__", (100,))
    ids, at = ChunkEncoder(own.encode_distinct)(pa.array([text]))
    assert at.tolist() == [0, len(ids)] and ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_give_what_short_ones_would(own, monkeypatch):
    words = pa.array([prose(i, 1).encode() * 8 for i in range(30)] + [b"a" * 60, bytes(range(64))])
    want = own.encode_words(words)
    monkeypatch.setattr(B, "SHORT", 0)
    got = own.encode_words(words)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def test_round_trip_and_digests(spark, library):
    docs = documents(spark, ODD_TEXTS, extra=True)
    trips = {r.doc_id: r for r in B.round_trip(docs).collect()}
    digests = {r.doc_id: r for r in B.digests(docs).collect()}
    assert sorted(trips) == sorted(digests) == list(range(len(ODD_TEXTS)))
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert trips[i].n_tokens == digests[i].n_tokens == len(ids)
        assert bytes(trips[i].ids) == np.array(ids, "<u4").tobytes() and trips[i].decoded.decode() == back
        assert digests[i].ids_sha256 == hashlib.sha256(trips[i].ids).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table(spark):
    none = documents(spark, ["a"]).limit(0)
    assert B.digests(none).count() == 0 and B.round_trip(none).count() == 0
