from collections import defaultdict

import pytest

from pivotspark.llm import token_counts as T

from .helpers import ODD_TEXTS, documents


@pytest.fixture(scope="module")
def offsets():
    """Character offsets by the other library that reads this vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).offsets


TEXTS = [*ODD_TEXTS, "One two. Three four! Five\n\n\n  six? Seven"]


@pytest.mark.parametrize("sections", ["sentences", "lines"])
@pytest.mark.parametrize("rule", ["first", "last"])
def test_counts_match_offsets(spark, offsets, sections, rule):
    rows = defaultdict(list)
    for r in T.count_tokens(documents(spark, TEXTS, extra=True), sections=sections, rule=rule).collect():
        rows[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        own = sorted(rows[i], key=lambda r: r.section)
        spans = offsets(text)
        assert own[0].start == 0 and own[-1].end == len(text or "")
        assert all(a.end == b.start for a, b in zip(own, own[1:]))
        assert sum(r.n_tokens for r in own) == len(spans) == own[0].doc_tokens
        if (text or "").isascii():  # else a token may be a part of a character
            for r in own:
                assert r.n_tokens == sum(r.start <= (a if rule == "first" else b - 1) < r.end for a, b in spans)
                assert r.crosses_end == any(a < r.end < b for a, b in spans)


def test_given_spans_and_shares(spark):
    docs = documents(spark, ["hello world", None, "aé日本"])
    spans = {0: "array(named_struct('start', 0L, 'end', 7L), named_struct('start', 7L, 'end', 99L))"}
    docs = docs.selectExpr("doc_id", "text", f"case when doc_id = 0 then {spans[0]} end as spans")
    rows = {(r.doc_id, r.section): r for r in T.count_tokens(docs, spans_col="spans", rule="share").collect()}
    assert set(rows) == {(0, 0), (0, 1)}  # null lists have no section
    assert rows[0, 0].n_tokens == pytest.approx(1 + 2 / 6) and rows[0, 1].n_tokens == pytest.approx(4 / 6)
    assert rows[0, 0].crosses_end and not rows[0, 1].crosses_end and rows[0, 1].end == 11


def test_empty_table(spark):
    assert T.count_tokens(documents(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(documents(spark, ["a"]), rule="none")
