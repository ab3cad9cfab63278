"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over one row's text, so the filter is
a scan without a shuffle and without Python.  Words are maximal runs of
characters other than space and U+0009..U+000D.

Defined results: a null or empty text has no words (all measures 0, fails the
base rule); ties and repeated rows are judged alike, row by row; an empty
table gives an empty result; other columns of the input are not looked at and,
in ``keep_documents``, pass through whatever their names are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

# The commonest function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it a with was on are this as by be at from or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "le la de et les que en un une est pour qui dans par du pas au sur plus avec "
    "el los las del se por con para su al lo como no"
).split()


class Rule(NamedTuple):
    """Reject when 100 * measure > limit * per (``above``) or < (not above),
    in texts of at least ``words`` words (few words say little of a share)."""
    name: str
    measure: str
    per: str
    above: bool
    limit: int
    words: int = 0


RULES = (
    Rule("symbols", "n_symbols", "n_words", True, 10),
    Rule("exclamations", "n_exclamations", "n_words", True, 30),
    Rule("capitals", "n_upper", "word_chars", True, 40),
    Rule("non_letters", "n_non_letters", "word_chars", True, 45),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", True, 35),
    Rule("stuttered_words", "n_stutters", "n_words", True, 30),
    Rule("stop_words", "n_stop_words", "n_words", False, 6, words=50),
    Rule("long_words", "word_chars", "n_words", True, 900),
    Rule("short_words", "word_chars", "n_words", False, 250),
)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more.

    Windows are compared by a 64-bit hash of their word hashes.  Texts without
    a repeated window (nearly all) stop at the distinct count; the others sort
    (hash, position), keep positions whose neighbour has the same hash and add
    up the union of their spans: n log n at worst, whatever repeats.
    """
    windows = F.when(
        F.size(hashes) >= WINDOW + 1,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                    lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = let(pairs, lambda p: F.filter(p, lambda x, k: (
            F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))))
        starts = F.sort_array(F.transform(repeats, lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n")),
            lambda a: a["n"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def measures(text: Column) -> Column:
    """Struct of all measures of a text (longs)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        stops = F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(STOP_WORDS))
        by_hash = let(hashes, lambda h: F.struct(
            _repeat_words(h).alias("repeat"),
            F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)))).alias("stutter")))
        return let(by_hash, lambda r: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            r["repeat"].cast("long").alias("n_repeat_words"),
            r["stutter"].cast("long").alias("n_stutters"),
            F.size(stops).cast("long").alias("n_stop_words")))

    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    return let(F.struct(let(words, of_words).alias("w"), by_line.alias("l")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        m["l"]["n_lines"].alias("n_lines"),
        m["w"]["n_stutters"].alias("n_stutters"),
        m["w"]["n_stop_words"].alias("n_stop_words"),
        count(r"!").alias("n_exclamations"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[^\p{L}\x20\x09-\x0D]").alias("n_non_letters")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])


def failed_rules(m: Column, rules=RULES) -> Column:
    """Names of the rules that reject, comma-joined in table order ("" if none)."""
    hits = []
    for r in rules:
        got, bound = 100 * m[r.measure], r.limit * m[r.per]
        hits.append(F.when((got > bound if r.above else got < bound) & (m["n_words"] >= r.words), F.lit(r.name)))
    return F.concat_ws(",", *hits)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, measures, verdict of the base rule, names of
    the failed rules, and ``kept``."""
    rows = docs.select(F.col(id_col), measures(F.col(text_col)).alias("m"))
    m = F.col("m")
    return rows.select(
        id_col, m["n_words"].alias("n_words"), *[m[c].alias(c) for c in (
            "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & (failed_rules(m, rules) == "")).alias("kept"),
        failed_rules(m, rules).alias("failed_rules"))


def keep_documents(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    verdict = let(measures(F.col(text_col)), lambda m: ~base_failed(m) & (failed_rules(m, rules) == ""))
    return docs.filter(verdict)


def oracle_sql() -> str:
    """The same verdicts in DuckDB SQL, windows compared as word lists."""
    hits = ", ".join(
        f"CASE WHEN 100 * {r.measure} {'>' if r.above else '<'} {r.limit} * {r.per} AND n_words >= {r.words} THEN '{r.name}' END" for r in RULES)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
starts AS (SELECT rid, i, words[i:i + {WINDOW - 1}] AS win
           FROM (SELECT rid, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM starts) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS r(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines,
        len(list_filter(generate_series(2, len(words)), lambda i: words[i] = words[i - 1])) AS n_stutters,
        len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stop}))) AS n_stop_words,
        len(regexp_extract_all(text, '!')) AS n_exclamations,
        len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper,
        len(regexp_extract_all(text, '[^\p{{L}}\x20\x09-\x0D]')) AS n_non_letters
      FROM w LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
        concat_ws(',', {hits}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j"""
