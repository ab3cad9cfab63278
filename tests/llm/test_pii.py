import hashlib
import random
import re
import time

import pytest

from pivotspark.llm import pii as P

from .helpers import ODD_TEXTS, documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


@pytest.fixture(scope="module")
def automaton():
    return P._automaton()


def test_base_spans_are_those_of_the_patterns(automaton):
    rng = random.Random(2)
    parts = ["a", "b.", "@", ".", "1", "12", "255", "256", "0", "+", "-", " ", "(", ")", "x@y.z", "4417744280351547", "%",
             "é", "\n", "1.2.3.4", "+1 (017) 555-7713", "_", '"']
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 18)))
        assert [s for s in P.find_spans(text, automaton) if s[2] in P.BASE] == brute(text), text


@pytest.mark.parametrize("text", ["a" * 200000 + "@", "@" * 100000, "1" * 200000, "1." * 100000, "+1" * 100000,
                                  "a." * 100000 + "@b", "1-" * 50000, "+1" + "(" * 100000, ("a" * 1000 + "é") * 300 + "@",
                                  "token" * 40000, "AB12" * 50000, "http://" * 40000, "token=" * 170000,
                                  "x://a@" * 170000, "a" * 500000 + "://u@h", "Token=a1" * 120000, "+1" * 500000])
def test_long_runs_take_linear_time(automaton, text):
    start = time.time()
    P.find_spans(text, automaton)
    assert time.time() - start < 3


@pytest.mark.parametrize("text, kind, span", [
    ("pay to GB82 WEST 1234 5698 7654 32 now", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("ssn 123-45-6789.", "ssn", "123-45-6789"), ("ssn 000-45-6789.", "ssn", None),
    ("at https://bob:pw@host.example/x, ok", "url", "https://bob:pw@host.example/x"),
    ('token = "04dbebab91ab85687d33"', "secret", "04dbebab91ab85687d33"), ("token of thanks", "secret", None),
    ("apiKey: abcdef123456x", "secret", "abcdef123456x"), ("h" * 80 + "://u:p@h.example", "url", "h" * 80 + "://u:p@h.example"),
    ("GB83 WEST 1234 5698 7654 32", "iban", None)])
def test_added_kinds(automaton, text, kind, span):
    got = [text[a:b] for a, b, k in P.find_spans(text, automaton) if k == kind]
    assert got == ([span] if span else [])


def brute_added(text):
    """Urls and secrets one after the other, by patterns over the whole text."""
    out, end = [], 0
    for m in re.finditer("://", text):
        scheme = re.search(r"[A-Za-z][A-Za-z0-9+.-]*\Z", text[end:m.start()])
        user = re.match(r"[^\s/?#@\"'<>]+@[^\s\"'<>]+", text[m.end():])
        if m.start() >= end and scheme and user:
            out.append((m.start() - len(scheme.group()), m.end() + len(user.group().rstrip(".,;:!?)")), "url"))
            end = m.end() + user.end()
    end = 0
    cues = sorted({m.start() + len(c) for c in P.CUES for m in re.finditer(f"(?={re.escape(c)})", text, re.I | re.A)})
    for at in cues:
        m = re.match(r"[\"']?\s{0,3}(?:[=:]|=>)\s{0,3}[\"']?([A-Za-z0-9_\-+/=.]{12,})", text[at:])
        if at >= end and m:
            end = at + m.end()
            if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                out.append((at + m.start(1), end, "secret"))
    return sorted(out)


def test_added_spans_are_those_of_the_rules(automaton):
    rng = random.Random(9)
    parts = ["a", "x", "1", "://", "@", "host", ".", ",", " ", "apiKey", "Token", "SECRET", "=", ":", "=>", "'", "abc123def456",
             "zzzzzzzzzzzzz", "/", "İ", "+", "-", "\n"]
    found = 0
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        want = brute_added(text)
        found += len(want)
        assert [s for s in P.find_spans(text, automaton) if s[2] in ("url", "secret")] == want, text
    assert found > 400


TEXTS = [*ODD_TEXTS, "x a@b.c y +1 (017) 555-7713 é 1.2.3.4", "a@b.c", "nothing here"]


def test_detect(spark):
    rows = {r.doc_id: r for r in P.detect(documents(spark, TEXTS, extra=True)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = brute(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in P.BASE] == [sum(s[2] == k for s in spans) for k in P.BASE]
        assert rows[i].spans == listed  # none of the added kinds is in here


def test_redact(spark):
    docs = documents(spark, TEXTS, extra=True)
    out = P.redact(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[0].n_chars is None
    n = len(ODD_TEXTS)
    assert rows[n].text == "x <EMAIL> y <PHONE> é <IP>" and rows[n].n_chars == len(rows[n].text)
    assert all(rows[i].text == TEXTS[i] for i in [*range(n), n + 2])
    assert P.redact(docs.limit(0)).count() == 0 and P.detect(docs.limit(0)).count() == 0
    assert P.redacted("ab cd", [(0, 4, "url"), (1, 3, "email")]) == "<URL>d"
