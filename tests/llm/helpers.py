"""Small tables for the corpus operators."""

import random

#: Texts that every operator must take: null, empty, blank, ties, marks, other
#: scripts, characters beyond 16 bits, a long text and a long word.
ODD_TEXTS = [
    None, "", "   \n\t ", "a", "A b c", "A b c", "x" * 5000, "İstanbul ΑΣ ΟΔΟΣ. ﬁ don't we'LL", "日本語 текст 12345 ½",
    "\x00 a\x1cb\x85c", "😀👍🏽 <|endoftext|> <|startoftext|>x", "one two three four five six seven eight nine ten " * 400,
    "line one here\nline one here\n\nother\n", "!!! ### $$$", "café naïve Ünïcode ß é",
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, ids=None, extra=False):
    """A documents table; ``extra`` adds columns whose names operators use
    inside."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, langs[i] if langs else None, "s", None if t is None else len(t)))
    schema = DOCUMENTS
    if extra:
        schema += ", id long, fp string, words string, `row` int, host string, m string, `range` int, __text string"
        rows = [(*r, 1, "f", "w", 2, "h", "m", 3, "t") for r in rows]
    return spark.createDataFrame(rows, schema)


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or ["alpha", "beta", "gamma", "delta", "the", "of", "and", "omega", "river", "stone", "light", "to"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
