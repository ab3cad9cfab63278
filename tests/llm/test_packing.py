import zlib
from collections import defaultdict

import numpy as np
import pytest

from pivotspark.llm import packing as P
from pivotspark.llm.common import vocabulary_path

from .helpers import ODD_TEXTS, documents, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(P.VOCABULARY))


@pytest.mark.parametrize("window", [16, 4096])
def test_every_id_lies_in_one_piece(spark, library, window):
    texts = [*ODD_TEXTS, prose(1, 9000)]
    rows = P.pack(documents(spark, texts, extra=True).repartition(3), window=window).collect()
    by_doc, by_place = defaultdict(list), {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        assert r.offset + r.length <= window
        by_doc[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        by_place[r.sequence_id, r.offset] = r
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        got = sorted(by_doc[i])
        assert [x for _, ids, _ in got for x in ids] == want
        assert all(n == len(want) for *_, n in got)
    at = 0
    for key in sorted(by_place):
        assert key[0] * window + key[1] == at
        at += by_place[key].length
    assert all(r.padded_length == window for r in rows if r.sequence_id < at // window)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b c", "a b c"], ids=[5, 5])
    assert P.pack(docs).agg({"length": "sum"}).first()[0] == 8
    assert P.pack(docs.limit(0)).count() == 0
