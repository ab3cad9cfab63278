"""String expressions: tokenisation, prompt building, answer extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference for identical results.
# Number after the final-answer marker, with optional sign, thousands
# groups and decimals:
MARKED_NUMBER = r"####\s*([+-]?\d+(?:,\d{3})*(?:\.\d+)?)"
# Any number (used when the marker is absent; the last one wins):
ANY_NUMBER = r"[-+]?\d*\.?\d+"
# Prompt template around a question.
PROMPT_TEMPLATE = "Question: {q}\n\nLet's think step by step.\n\n"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokens(text) -> Column:
    """Default tokeniser: split on single spaces, drop empty tokens."""
    return F.filter(F.split(_c(text), " "), lambda t: t != F.lit(""))


def strip_ws(s) -> Column:
    # most strings have no white space, which is found out faster
    return F.when(_c(s).rlike(r"\s"), F.regexp_replace(_c(s), r"^\s+|\s+$", "")).otherwise(_c(s))


def extract_answer(text) -> Column:
    """Number after '####' (commas removed), else the last number, else null."""
    t = _c(text)
    marked = F.nullif(F.regexp_extract(t, MARKED_NUMBER, 1), F.lit(""))
    last_any = F.try_element_at(F.regexp_extract_all(t, F.lit(ANY_NUMBER), F.lit(0)), F.lit(-1))
    return F.coalesce(F.replace(marked, F.lit(","), F.lit("")), last_any)


def is_correct(pred, truth) -> Column:
    """null -> false; strip and remove commas; numeric equality when both
    parse as numbers, else string equality."""
    p, g = plain_answer(pred), plain_answer(truth)
    return same_answer(pred, truth, p, g, p.try_cast("double"), g.try_cast("double"))


def plain_answer(s) -> Column:
    return F.replace(strip_ws(s), F.lit(","), F.lit(""))


def same_answer(pred, truth, p: Column, g: Column, pn: Column, gn: Column) -> Column:
    """``is_correct`` with the plain answers p and g and their numbers; never
    null, and known to be so: a filter on it would else be pushed down to the
    texts as a test for null that computes it all again, many times over."""
    numeric = pn.isNotNull() & gn.isNotNull()
    num_eq = (pn == gn) & ~F.isnan(pn)
    return F.coalesce(F.when(_c(pred).isNull() | _c(truth).isNull(), F.lit(False))
                      .when(numeric, num_eq)
                      .otherwise(p == g), F.lit(False))


def build_prompt(question) -> Column:
    pre, post = PROMPT_TEMPLATE.split("{q}")
    return F.concat(F.lit(pre), _c(question), F.lit(post))
