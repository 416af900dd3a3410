"""Spelling variant grouping by finite-state composition (operator 11).

The composed machine reads word pairs: vocabulary acceptor, one-edit transducer, vocabulary acceptor.  Until
the edit is spent both sides are in one state, the state of the prefix read so far; afterwards they must read
the same rest.  The machine is cut at a frontier of such unspent states:

1. The frontier lies one symbol below the initial state, and deeper where more than ``LIMIT`` words start
   alike, so a prefix that a third of all words share is split by its next symbols.
2. Every frontier state is one group: its words make a minimised acceptor, which is composed with the
   transducer and with itself, and the accepted pairs are enumerated.
3. Edits spent before the frontier lead to states whose sides must accept equal rests.  That is an equality,
   so Spark joins on (prefix read, rest): one row per word and symbol before its frontier.

Words are numbered inside each acceptor by the counts of its right languages, so pairs are pairs of numbers
and memory follows the number of words and pairs of a group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.llm.frames import stored

#: A maximal run of letters; shorter runs can hold no word.
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
MODULUS = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least this many times as often as its variant.
RATIO = 5
#: Words of a frontier state at most, unless its words end there.
LIMIT = 4000
#: Depths that the first pass over the words counts; each further pass counts twice as many.
DEPTHS = 6


def occurrences(docs: DataFrame, modulus: int = MODULUS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word) of every run of ``docs`` (doc_id, text) with at least ``min_length`` code points.

    A-Z are lower-cased; of runs whose crc32 of ``doc_id:run`` is a multiple of ``modulus`` one code point
    is deleted first, as a stand-in for typing errors.  A row without doc_id has an empty one.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(RUN % min_length), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return hashed.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word")).filter(
        F.length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words that occur at least ``min_count`` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words; children have smaller numbers than parents."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.first: list[dict[str, int]] = []
        self.known: dict[tuple, int] = {}
        # The path of the last word: edges so far and whether a word ends there.
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        before = ""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._close(path, before, same)
            path.extend(({}, False) for _ in range(len(word) - same))
            path[-1] = (path[-1][0], True)
            before = word
        self._close(path, before, 0)
        self.root = self._state(*path[0])

    def _close(self, path: list[tuple[dict[str, int], bool]], word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            edges, final = path.pop()
            path[-1][0][word[len(path) - 1]] = self._state(edges, final)

    def _state(self, edges: dict[str, int], final: bool) -> int:
        key = (final, *edges.items())
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            total, first = int(final), {}
            for symbol, to in edges.items():
                first[symbol] = total
                total += self.size[to]
            self.first.append(first)
            self.size.append(total)
        return state


class Composition:
    """The acceptor composed with the one-edit transducer and with itself."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.met: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Numbers (in p, in q) of the words that both states accept: the edit is spent."""
        if p == q:
            return [(i, i) for i in range(self.a.size[p])]
        if p > q:
            return [(j, i) for i, j in self.common(q, p)]
        found = self.met.get((p, q))
        if found is not None:
            return found
        edges, first, final, met = self.a.edges, self.a.first, self.a.final, self.met
        todo = [(p, q)]
        while todo:
            p1, q1 = todo[-1]
            if (p1, q1) in met:
                todo.pop()
                continue
            one, two = edges[p1], edges[q1]
            short, other = (one, two) if len(one) <= len(two) else (two, one)
            both = [s for s in short if s in other]
            wait = [k for k in ((min(one[s], two[s]), max(one[s], two[s])) for s in both)
                    if k[0] != k[1] and k not in met]
            if wait:
                todo.extend(wait)
                continue
            rows = [(0, 0)] if final[p1] and final[q1] else []
            for s in both:
                x, y = one[s], two[s]
                i0, j0 = first[p1][s], first[q1][s]
                if x == y:
                    rows.extend((i0 + i, j0 + i) for i in range(self.a.size[x]))
                elif x < y:
                    rows.extend((i0 + i, j0 + j) for i, j in met[x, y])
                else:
                    rows.extend((i0 + i, j0 + j) for j, i in met[y, x])
            met[p1, q1] = rows
            todo.pop()
        return met[p, q]

    def pairs(self) -> list[tuple[int, int]]:
        """Numbers of the accepted pairs of different words, each once."""
        edges, first, final = self.a.edges, self.a.first, self.a.final
        open_: list[list[tuple[int, int]]] = []
        for state in range(self.a.root + 1):  # children before parents
            rows: list[tuple[int, int]] = []
            symbols = list(edges[state].items())
            for k, (s, to) in enumerate(symbols):
                base = first[state][s]
                rows.extend((base + i, base + j) for i, j in open_[to])
                for t, other in symbols[k + 1:]:  # s replaced by t
                    there = first[state][t]
                    rows.extend((base + i, there + j) for i, j in self.common(to, other))
                # s deleted: the rest is read from here, not by s again, which the states below cover.
                if final[to] and final[state]:
                    rows.append((base, 0))
                for t, below in edges[to].items():
                    if t != s and t in edges[state]:
                        i0, j0 = base + first[to][t], first[state][t]
                        rows.extend((i0 + i, j0 + j) for i, j in self.common(below, edges[state][t]))
            open_.append(rows)
        return open_[self.a.root]


def _compose(table: pa.Table) -> pa.Table:
    counts = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
    words = sorted(counts)
    pairs = Composition(Acceptor(words)).pairs()
    one, two = [words[i] for i, _ in pairs], [words[j] for _, j in pairs]
    return pa.table([pa.array(one, pa.string()), pa.array([counts[w] for w in one], pa.int64()),
                     pa.array(two, pa.string()), pa.array([counts[w] for w in two], pa.int64())],
                    names=["a", "a_n", "b", "b_n"])


def frontier(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``words`` (word, n) with depth: symbols read before the word's frontier state, at least one.

    A prefix is hot if more than ``limit`` words begin with it; the frontier lies one symbol below the
    longest hot prefix.  A word that is hot to its end has a depth of its length plus one.
    """
    left, done, base, end = words.withColumn("depth", F.lit(1)), None, 0, DEPTHS
    while True:
        deep = left.withColumn("d", F.explode(F.sequence(F.lit(base + 1), F.least(F.lit(end), F.length("word"))))
                               ).withColumn("prefix", F.substr("word", F.lit(1), F.col("d")))
        hot = stored(deep.groupBy("prefix").count().filter(F.col("count") > limit).select("prefix"), "hot-prefixes")
        under = deep.join(hot, "prefix", "left_semi").groupBy("word").agg(F.max("d").alias("hot"))
        cut = stored(left.join(under, "word", "left").select(
            "word", "n", F.greatest(F.col("depth"), F.coalesce(F.col("hot") + 1, F.lit(1))).alias("depth")), "frontier")
        more = (F.col("depth") == end + 1) & (F.length("word") >= F.col("depth"))
        settled = cut.filter(~more)
        done = settled if done is None else done.unionByName(settled)
        left, base, end = cut.filter(more), end, 3 * end - 2 * base
        if left.isEmpty():
            return done


def near_words(cut: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words one edit apart, each once; ``cut`` comes from ``frontier``."""
    fields = "a string, a_n long, b string, b_n long"
    inside = cut.filter(F.length("word") >= F.col("depth")).select(
        F.substr("word", F.lit(1), F.col("depth")).alias("state"), "word", "n")
    composed = inside.groupBy("state").applyInArrow(_compose, fields)
    spent = cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.least(F.col("depth"), F.length("word"))))).select(
        "word", "n", "at", F.substr("word", F.lit(1), F.col("at") - 1).alias("prefix"),
        F.substr("word", F.col("at"), F.lit(1)).alias("symbol"), F.substr("word", F.col("at") + 1).alias("rest"))
    spent = stored(spent.select("at", F.concat("prefix", "rest").alias("read"), "word", "n", "symbol",
                                F.substr("rest", F.lit(1), F.lit(1)).alias("next")), "spent-states")
    one, two = spent.alias("x"), spent.alias("y")
    replaced = one.join(two, ["at", "read"]).filter(F.col("x.symbol") < F.col("y.symbol")).select(
        F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))
    # The last symbol of a run of equal ones is the one deleted, so that a pair comes once.
    deleted = spent.filter(F.col("symbol") != F.col("next")).join(
        cut.select(F.col("word").alias("b"), F.col("n").alias("b_n")), F.col("read") == F.col("b")).select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n")
    return composed.unionByName(replaced).unionByName(deleted)


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; ``forms`` has word and form, without cycles.

    Each round doubles the length of the steps, so rounds grow with the logarithm of the longest chain.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(now.join(step, "root", "left"), "roots")
        now = further.select("word", F.coalesce("further", "root").alias("root"))
        if further.filter(F.col("further").isNotNull()).isEmpty():
            return now


def group_variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``words`` (distinct word, n): word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point turns one into the other.  The form is the
    near word of largest n (ties: first in code-point order) if its n is at least ``ratio`` times the
    word's, else null; root is the last word when forms are followed, the word itself without a form.
    Null words are left out.  No words give no rows.
    """
    if ratio < 2:
        raise ValueError("forms must occur more often than their variants")
    pairs = stored(near_words(frontier(words.select("word", "n").filter(F.col("word").isNotNull()), limit)), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("other")).alias("near")).unionAll(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("other")).alias("near")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near")).select(
        "word", "n_near", (-F.col("near.less")).alias("other_n"), F.col("near.other").alias("other"))
    fits = F.col("other_n") >= ratio * F.col("n")
    found = stored(words.select("word", "n").filter(F.col("word").isNotNull()).join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("other")).alias("form"), F.when(fits, F.col("other_n")).alias("form_n")), "forms")
    roots = follow(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, limit: int = LIMIT, modulus: int = MODULUS) -> DataFrame:
    """Spelling variants among the words of ``docs`` (doc_id, text); see ``group_variants`` for the columns.

    Words are counted over whole texts; null and empty texts have none, a null doc_id counts as empty,
    repeated rows count each, and other columns are ignored.  No rows give no rows.
    """
    words = stored(vocabulary(occurrences(docs, modulus, min_length), min_count), "vocabulary")
    return group_variants(words, ratio, limit)
