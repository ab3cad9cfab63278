import re
from collections import Counter

from pivotspark.llm import quality_rules as Q

from .helpers import ODD_TEXTS, documents, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


TEXTS = [*ODD_TEXTS, prose(1, 300), prose(1, 60) + " " + prose(2, 100) + " " + prose(1, 60),
         " ".join(f"{w}!!" for w in prose(3, 50).upper().split()), " ".join(f"{w}###" for w in prose(4, 80).split()),
         "same same same same same same same " * 1 + prose(5, 10), "same " * 500]


def test_measures_match_brute_force(spark):
    rows = Q.judge(documents(spark, TEXTS, extra=True)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.kept == (not r.base_failed and r.failed_rules == "")


def test_rules_reject_junk_and_keep_prose(spark):
    rows = {r.doc_id: r for r in Q.judge(documents(spark, TEXTS)).collect()}
    n = len(ODD_TEXTS)
    assert rows[n].kept
    assert "exclamations" in rows[n + 2].failed_rules and "symbols" in rows[n + 3].failed_rules
    assert not any(rows[i].kept for i in (0, 1, 2, n + 2, n + 3, n + 5))


def test_keep_documents_keeps_columns_and_repeats(spark):
    docs = documents(spark, [prose(1, 300), prose(1, 300), None], extra=True)
    kept = Q.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert Q.keep_documents(docs.limit(0)).count() == 0 and Q.judge(docs.limit(0)).count() == 0


def test_no_python_and_no_shuffle_in_the_plan(spark):
    plan = Q.judge(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
