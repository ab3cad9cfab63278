"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in a text: at-signs, scheme
separators, digit neighbours and identifier cues.  A parser local to the
anchor's kind expands each to its boundaries and validates what it found.  The
parsers read every character a bounded number of times, whatever the text.

Base kinds: ``email``, ``ip`` (parts up to 255), ``card`` (14 to 19 digits,
Luhn) and ``phone`` (10 to 15 digits after a plus sign), each the leftmost
non-overlapping matches of its pattern, failing ones dropped.  Added kinds:
``url`` (with user information), ``iban`` (mod-97), ``ssn`` (the valid number
areas) and ``secret`` (the value after a key, token or password cue).

Defined results: a null or empty text has no spans; matches that touch or
overlap across kinds are all reported, redaction covers their union; repeated
rows give equal rows; an empty table gives an empty result; ``redact`` keeps
all columns of its input whatever their names are.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import text_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "secret")

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_SCHEME = string.ascii_letters + string.digits + "+.-"
_USER_URL = re.compile(r"[^\s/?#@\"'<>]++@[^\s\"'<>]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"[\"']?\s{0,3}(?:[=:]|=>)\s{0,3}[\"']?([A-Za-z0-9_\-+/=.]{12,})")

CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")


def _automaton():
    """Anchors: characters that every match of a kind must hold."""
    import ahocorasick

    digits = "0123456789"
    found: dict[str, set[str]] = {"@": {"email"}, "://": {"url"}}
    for a in digits:
        found.setdefault(f"+{a}", set()).add("phone")
        for b in digits:
            found.setdefault(f"{a}.{b}", set()).add("ip")
            for s in ("", " ", "-"):
                found.setdefault(f"{a}{s}{b}", set()).add("card")
    for cue in CUES:
        found.setdefault(cue, set()).add("secret")
    auto = ahocorasick.Automaton()
    for anchor, kinds in found.items():
        auto.add_word(anchor, (len(anchor), tuple(sorted(kinds))))
    auto.make_automaton()
    return auto


def _luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def _run_start(text: str, at: int, floor: int, characters: str) -> int:
    """Start of the run of ``characters`` that ends at ``at``; the run is
    looked at once, since ``floor`` moves past it."""
    size = 64
    while True:
        low = max(floor, at - size)
        start = low + len(text[low:at].rstrip(characters))
        if start > low or low == floor:
            return start
        size *= 4


def _emails(text: str, anchors: list[int]):
    end = 0  # of the last match
    seen = 0  # behind the last at-sign: no local part reaches across it
    for at in anchors:
        if at < end:
            continue
        start = _run_start(text, at, max(end, seen), _LOCAL)
        seen = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end


def _ips(text: str, anchors: list[int]):
    end = 0
    for at in anchors:
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in "0123456789":
            start -= 1
        m = _DOTTED.match(text, start)
        end = m.end()
        parts, place = m.group().split("."), start
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i:i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i:i + 4]):
                yield place, place + size
            place += size + 1


def _cards(text: str, anchors: list[int]):
    end = 0
    for at in anchors:
        if at < end:
            continue
        m = _CARD.match(text, at)
        end = m.end()
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield at, end


def _phones(text: str, anchors: list[int]):
    for at in anchors:
        m = _PHONE.match(text, at)
        if m is None:
            continue
        end = at + len(m.group().rstrip(" ().-"))
        digits = sum(c.isdigit() for c in text[at:end])
        # The pattern wants a character between the first and the last digit.
        if end - at >= 4 and 10 <= digits <= 15:
            yield at, end


def _urls(text: str, anchors: list[int]):
    """Addresses that carry user information (user:password@host); an anchor
    inside the last one is a part of it."""
    end = 0   # of the last match
    seen = 0  # behind the last separator: no scheme reaches across it
    for at in anchors:
        if at < end:
            continue
        start = _run_start(text, at, max(end, seen), _SCHEME)
        while start < at and not (text[start].isascii() and text[start].isalpha()):
            start += 1
        seen = at + 3
        if start < at and (m := _USER_URL.match(text, at + 3)):
            end = m.end()
            yield start, at + 3 + len(m.group().rstrip(".,;:!?)"))


def _ibans(text: str, anchors: list[int]):
    """Two letters before two digits; the check digits must hold."""
    end = 0
    for at in anchors:
        start = at - 2
        if start < end or start > 0 and text[start - 1].isalnum():
            continue
        if (m := _IBAN.match(text, start)) is None:
            continue
        for size in range(len(m.group()), 14, -1):
            if start + size < len(text) and text[start + size].isalnum() or text[start + size - 1] == " ":
                continue
            code = text[start:start + size].replace(" ", "")
            if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                end = start + size
                yield start, end
                break


def _ssns(text: str, anchors: list[int]):
    for at in anchors:
        if at and (text[at - 1].isalnum() or text[at - 1] in "-+"):
            continue
        if (m := _SSN.match(text, at)) and text[at:at + 3] not in ("000", "666") and text[at] != "9" and (
                text[at + 4:at + 6] != "00" and text[at + 7:at + 11] != "0000"):
            yield at, m.end()


def _secrets(text: str, anchors: list[int]):
    """The value after a cue; one of letters and digits mixed.  A cue inside a
    value is a part of it (where that one has no digit, what follows the cue
    has none either)."""
    end = 0
    for at in anchors:
        if at >= end and (m := _SECRET.match(text, at)):
            end = m.end(1)
            if re.search("[0-9]", m.group(1)) and re.search("[A-Za-z]", m.group(1)):
                yield m.start(1), end


def _folded(text: str) -> str:
    """Lower case with every character in its place (one capital letter has a
    small form of two characters)."""
    return text.replace("\u0130", "I").lower()


def find_spans(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    at: dict[str, list[int]] = {}
    for last, (size, kinds) in automaton.iter(_folded(text)):
        for kind in kinds:
            at.setdefault(kind, []).append(last + 1 - size if kind != "secret" else last + 1)
    if not at:
        return []
    out: list[tuple[int, int, str]] = []
    for kind, parse in (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones), ("url", _urls),
                        ("secret", _secrets)):
        if kind in at:
            out += [(a, b, kind) for a, b in parse(text, sorted(set(at[kind])))]
    if "card" in at:
        numbers = sorted(set(at["card"]))
        out += [(a, b, "iban") for a, b in _ibans(text, [i for i in numbers if i >= 2 and text[i - 1].isupper()])]
        out += [(a, b, "ssn") for a, b in _ssns(text, numbers)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base
    spans, all spans, and the counts of the added kinds."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    added = [k for k in KINDS if k not in BASE]
    names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in added)]

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                found = [find_spans(t, automaton) for t in texts.to_pylist()]
                counts = {k: pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in KINDS}
                base = [hashlib.sha256(_listed([s for s in f if s[2] in BASE]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(counts[k] for k in BASE), pa.array(base, pa.string()),
                     pa.array([_listed(f) for f in found], pa.string()), *(counts[k] for k in added)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    longs = lambda kinds: ", ".join(f"n_{k} bigint" for k in kinds)
    return rows.mapInArrow(run, f"id {kind}, {longs(BASE)}, base_sha256 string, spans string, {longs(added)}"
                           ).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans of its texts replaced and, where it has such a
    column, the length in code points set anew."""
    names = docs.columns
    at, size = names.index(text_col), names.index(length_col) if length_col in names else -1

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            for part, _ in text_slices(batch, batch.schema.names[at]):
                columns = list(part.columns)
                texts = [None if t is None else redacted(t, find_spans(t, automaton)) for t in columns[at].to_pylist()]
                columns[at] = pa.array(texts, columns[at].type)
                if size >= 0:
                    same = pc.is_null(columns[at])
                    new = pc.utf8_length(columns[at]).cast(columns[size].type)
                    columns[size] = pc.if_else(same, columns[size], new)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
