"""Collocations: phrases of two to four words that hold together, per language.

Phrases are counted level by level.  The frequent phrases of one length go into
double-array tries that are broadcast; every text position is a state, and all
states of a slice advance together in numpy, one word a step.  A position whose
state accepts, and whose follower's does, begins an Apriori-safe candidate of
the next length (both shorter parts are frequent); the candidates' positions
are counted by slice and the counts of the slices summed by Spark.  Candidates
are those that occur: joining frequent phrases on their common middle would
make all pairs of a frequent word's neighbours.

A trie holds ``SHARD`` phrases at most; more are dealt to several tries, each
with a pass of its own over the texts, whose candidates are apart.  With
several tries the follower is not looked up (it may be in another one), which
makes more candidates and the same counts.

A word is known by a 64-bit hash of its language and its bytes (two words of
one hash would be counted as one; no such pair is to be expected below 10^9
words); the words themselves are looked up for what is reported.

Defined results: a null text counts as empty; a null language is ``und``, as is
the language of that name; repeated rows count each; languages without a
frequent phrase have no row; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import text_slices
from .common import stored

LEAST = 30
LONGEST = 4
TOP = 2000
#: Share of a phrase's occurrences, in percent, inside a longer candidate from
#: which on the phrase is dropped.
INSIDE = 80
SCALE = 2_000_000
#: Phrases of one trie; bounds what is broadcast and what the driver holds.
SHARD = 1 << 20
SLICE = 8 << 20
#: Children of a trie node beyond which its place is searched for by itself.
FEW = 8
TRIES = 64
#: Parts in which a language's first phrases are found before they meet.
SALTS = 64
UNKNOWN = "und"

_BREAK = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(b"\t" + _BREAK, b" " + b"\n" * len(_BREAK))


class DoubleArray:
    """Trie over rows of ``d`` symbols: the child of state s for code c is
    ``base[s] + c`` if ``check`` there is s.  States are slots; the root is 0."""

    def __init__(self, phrases: np.ndarray):
        self.alphabet, codes = np.unique(phrases, return_inverse=True)
        codes = codes.reshape(phrases.shape).astype(np.int64) + 1
        parents, symbols, children, n = [], [], [], 1
        node = np.zeros(len(phrases), dtype=np.int64)
        for depth in range(phrases.shape[1]):
            key = node * (len(self.alphabet) + 1) + codes[:, depth]
            edges, which = np.unique(key, return_inverse=True)
            parents.append(edges // (len(self.alphabet) + 1))
            symbols.append(edges % (len(self.alphabet) + 1))
            children.append(n + np.arange(len(edges)))
            node, n = n + which, n + len(edges)
        parent, symbol, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, symbols, children))
        bases, size = _place(parent, symbol, n, len(self.alphabet))
        slot = np.zeros(n, dtype=np.int64)
        slot[child] = bases[parent] + symbol
        self.base = np.zeros(size + len(self.alphabet) + 1, dtype=np.int32)
        self.check = np.full(len(self.base), -1, dtype=np.int32)
        self.base[slot] = bases
        self.check[slot[child]] = slot[parent]
        # The phrase that an accepting state stands for.
        self.phrase = np.full(len(self.base), -1, dtype=np.int32)
        self.phrase[slot[node]] = np.arange(len(phrases))
        self.phrases = phrases

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.alphabet, self.base, self.check, self.phrase, self.phrases


def _place(parent: np.ndarray, symbol: np.ndarray, n: int, top: int) -> tuple[np.ndarray, int]:
    """A base for each node, such that no two children meet, and the slots
    used.  The root (with slots 1 to ``top`` for itself) has base 0; nodes of
    many children come first, each where it fits in some tries or else at the
    end; nodes of few all try places at once; single children fill gaps."""
    rng = np.random.default_rng(1)
    bases = np.zeros(n, dtype=np.int64)
    order = np.lexsort((symbol, parent))
    parent, symbol = parent[order], symbol[order]
    nodes, first, counts = np.unique(parent, return_index=True, return_counts=True)
    last = first + counts - 1
    below = nodes > 0
    end = top + 1
    taken = np.zeros(2 * end + 4 * len(symbol), dtype=bool)
    taken[:end] = True
    large = np.flatnonzero(below & (counts > FEW))
    for i in large[np.argsort(-counts[large], kind="stable")].tolist():
        own = symbol[first[i]:last[i] + 1]
        at = None
        if end > top + 1 + own[-1]:
            tries = rng.integers(top + 1, end - own[-1], TRIES)
            free = np.flatnonzero(~taken[tries[:, None] + own].any(axis=1))
            at = int(tries[free[0]]) if len(free) else None
        if at is None:
            at = end - int(own[0])
            end = at + int(own[-1]) + 1
            if end + top > len(taken):
                taken = np.append(taken, np.zeros(len(taken) + top, dtype=bool))
        taken[at + own] = True
        bases[nodes[i]] = at
    some = np.flatnonzero(below & (counts > 1) & (counts <= FEW))
    size = end + top + 4 * int(counts[some].sum()) + int((counts == 1).sum())
    taken = np.append(taken, np.zeros(max(0, size + top + 1 - len(taken)), dtype=bool))
    claim = np.full(len(taken), -1, dtype=np.int64)
    while len(some):
        at = rng.integers(top + 1, size - top, len(some))
        owner = np.repeat(np.arange(len(some)), counts[some])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
        slots = at[owner] + symbol[first[some][owner] + within]
        claim[slots] = owner
        lost = np.bincount(owner, taken[slots] | (claim[slots] != owner), len(some)) > 0
        bases[nodes[some[~lost]]] = at[~lost]
        taken[slots[~lost[owner]]] = True
        some = some[lost]
    one = np.flatnonzero(below & (counts == 1))
    free = np.flatnonzero(~taken[:size])
    free = free[free > top][:len(one)]
    bases[nodes[one]] = free - symbol[first[one]]
    return bases, size


def step(base: np.ndarray, check: np.ndarray, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The states that follow; -1 where there is none.  States of -1 stay."""
    slots = base[states] + codes
    return np.where((states >= 0) & (codes > 0) & (check[slots] == states), slots, -1)


def _tokens(texts: list[str]) -> list[bytes]:
    """Words of the texts in order, with a line feed between pieces."""
    joined = "\n".join(texts).encode().lower().translate(_CLEAN)
    return [w for w in joined.replace(b"\n", b" \n ").split(b" ") if w]


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """For each slice of texts and language: the language, the distinct words,
    their hashes and the words' numbers in order (a line feed between pieces
    is one of the words)."""
    from xxhash import xxh64_intdigest as xxh

    for part, texts in text_slices(batch, "__text", SLICE):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts.to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            coded = pa.array(_tokens(own), pa.binary()).dictionary_encode()
            seed = xxh(lang.encode())
            hashes = np.array([xxh(w, seed) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
            yield lang, coded.dictionary, hashes, np.asarray(coded.indices, dtype=np.int64)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col], F.lit(UNKNOWN)).alias("lang"), docs[text_col].alias("__text"))


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, hash, f) of all words."""
    def run(batches):
        for batch in batches:
            for lang, words, hashes, at in _coded(batch):
                counts = np.bincount(at, minlength=len(words))
                keep = np.array([w != b"\n" for w in words.to_pylist()], dtype=bool)
                kept = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kept), pa.string()), words.take(kept).cast(pa.string()),
                     pa.array(hashes[keep].view(np.int64)), pa.array(counts[keep])], names=["lang", "word", "hash", "f"])

    rows = _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, hash bigint, f bigint")
    return rows.groupBy("lang", "word", "hash").agg(F.sum("f").alias("f"))


def occurrences(base, check, phrase, codes: np.ndarray, length: int, follower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions that begin a candidate of ``length`` words, and the phrase of
    their first ``length - 1``."""
    states = np.zeros(len(codes), dtype=np.int64)
    for depth in range(length - 1):
        ahead = np.zeros(len(codes), dtype=np.int64)
        ahead[:len(codes) - depth] = codes[depth:]
        states = step(base, check, states, ahead)
    safe = states >= 0
    if follower:
        safe[:-1] &= safe[1:]
        safe[-1:] = False
    at = np.flatnonzero(safe)
    return at, phrase[states[at]]


def extensions(docs: DataFrame, frequent: DataFrame, length: int, lang_col: str = "lang", text_col: str = "text",
               shard: int = SHARD) -> DataFrame:
    """``frequent``: a stored table of phrases ``p`` (hashes) of length - 1
    words.  Returns (p, f) of all Apriori-safe phrases of ``length`` words that
    occur, with their counts."""
    spark = docs.sparkSession
    shards = -(-frequent.count() // shard)
    texts = _texts(docs, lang_col, text_col)
    schema = ", ".join(f"w{i} bigint" for i in range(length)) + ", f bigint"
    rows = spark.createDataFrame([], schema)
    for k in range(shards):
        own = frequent.where(F.pmod(F.xxhash64("p"), F.lit(shards)) == k).select(
            *[F.get("p", i).alias(f"w{i}") for i in range(length - 1)]).toArrow()
        phrases = np.stack([np.asarray(c).view(np.uint64) for c in own.columns], axis=1)
        trie = spark.sparkContext.broadcast(DoubleArray(phrases).arrays())

        def run(batches, trie=trie):
            alphabet, base, check, phrase, phrases = trie.value
            for batch in batches:
                for _, words, hashes, numbers in _coded(batch):
                    place = np.minimum(np.searchsorted(alphabet, hashes), len(alphabet) - 1)
                    code = np.where(alphabet[place] == hashes, place + 1, 0)
                    feed = words.index(b"\n").as_py()
                    if feed >= 0:
                        code[feed] = 0
                    at, prefix = occurrences(base, check, phrase, code[numbers], length, shards == 1)
                    inside = at + length - 1 < len(numbers)
                    at, prefix = at[inside], prefix[inside]
                    nexts = numbers[at + length - 1]
                    prefix, nexts = prefix[nexts != feed], nexts[nexts != feed]
                    keys, counts = np.unique(prefix.astype(np.int64) * len(words) + nexts, return_counts=True)
                    found = phrases[keys // max(1, len(words))].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.ascontiguousarray(found[:, i])) for i in range(length - 1)),
                         pa.array(hashes[keys % max(1, len(words))].view(np.int64)), pa.array(counts)],
                        names=[*(f"w{i}" for i in range(length)), "f"])

        rows = rows.unionByName(texts.mapInArrow(run, schema))
    names = [f"w{i}" for i in range(length)]
    return rows.groupBy(*names).agg(F.sum("f").alias("f")).select(F.array(*names).alias("p"), "f")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                     longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The word counts, and (p, f) of all frequent phrases of 1 to ``longest``
    words; p is the array of the words' hashes."""
    words = stored(word_counts(docs, lang_col, text_col), "words")
    level = stored(words.where(F.col("f") >= least).select(F.array("hash").alias("p"), "f"), "phrases")
    phrases = level
    for length in range(2, longest + 1):
        more = extensions(docs, level, length, lang_col, text_col, shard)
        level = stored(more.where(F.col("f") >= least), "phrases")
        phrases = phrases.unionByName(level)
    return words, phrases


def scored(phrases: DataFrame) -> DataFrame:
    """(p, a, l, r, score) of the candidates, by their lowest cut."""
    parts = phrases.select(F.col("p").alias("part"), F.col("f").alias("part_f"))
    cuts = phrases.where(F.size("p") > 1).select("p", F.col("f").alias("a"),
                                                 F.explode(F.expr("sequence(1, size(p) - 1)")).alias("k"))
    cuts = cuts.withColumn("part", F.expr("slice(p, 1, k)")).join(parts, "part").withColumnRenamed("part_f", "l")
    cuts = cuts.withColumn("part", F.expr("slice(p, k + 1, size(p) - k)")).join(parts, "part").withColumnRenamed("part_f", "r")
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("p", "a").agg(lowest.alias("cut")).select("p", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Candidates that no longer one holds in most of their occurrences."""
    within = F.expr("""flatten(transform(sequence(2, size(p) - 1), n ->
        transform(sequence(1, size(p) - n + 1), s -> slice(p, s, n))))""")
    longer = candidates.where(F.size("p") > 2).select(F.explode(within).alias("p"), F.col("a").alias("longer"))
    longer = longer.groupBy("p").agg(F.max("longer").alias("longer"))
    drop = F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {inside}")
    return candidates.join(longer, "p", "left").where(~F.coalesce(drop, F.lit(False))).drop("longer")


def spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """With lang and phrase in place of p."""
    names = words.select("hash", "lang", "word")
    parts = candidates.select("p", F.posexplode("p").alias("at", "hash")).join(names, "hash")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return candidates.join(parts.groupBy("p").agg(F.first("lang").alias("lang"), phrase.alias("phrase")), "p")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
                 longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top``
    phrases by score, count and phrase."""
    words, phrases = frequent_phrases(docs, lang_col, text_col, least, longest, shard)
    candidates = stored(scored(phrases), "collocations")
    named = spelled(uncovered(candidates), words.where(F.col("f") >= least))
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """Brute force in DuckDB: every phrase of one to four words."""
    grams = "\nunion all\n".join(
        f"select lang, {k} as k, array_to_string(w[i:i + {k - 1}], ' ') as p "
        f"from (select lang, w, unnest(range(1, len(w) - {k} + 2)) as i from pieces)" for k in range(1, 5))
    return f"""
with texts as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
pieces as (
  select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from texts),
freq as (
  select lang, k, p, count(*) as f from ({grams}) group by all),
words as (select lang, sum(f)::bigint as n from freq where k = 1 group by lang),
cand as (select lang, k, p, string_split(p, ' ') as w, f as a from freq where k > 1 and f >= {least}),
cuts as (
  select c.lang, c.k, c.p, c.w, c.a, s.c as cut, l.f as l, r.f as r,
    ({SCALE}::hugeint * c.a) // (l.f + r.f) as score
  from cand c join (select unnest([1, 2, 3]) as c) s on s.c < c.k
  join freq l on l.lang = c.lang and l.k = s.c and l.p = array_to_string(c.w[1:s.c], ' ')
  join freq r on r.lang = c.lang and r.k = c.k - s.c and r.p = array_to_string(c.w[s.c + 1:], ' ')),
low as (
  select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
longer as (
  select lang, sub, max(a) as a from (
    select lang, a, unnest(case k when 3 then [array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]
      else [array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' '),
            array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] end) as sub
    from cand where k > 2) group by all),
kept as (
  select low.* from low left join longer on longer.lang = low.lang and longer.sub = low.p
  where longer.a is null or 100 * longer.a::hugeint < {INSIDE} * low.a::hugeint)
select lang, rank, p as phrase, a, l, r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from kept)
join words using (lang) where rank <= {top}
"""
