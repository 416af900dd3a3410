"""Place mentions in free text (D18, G4) and embedding search."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions import wordlists as W
from railweave.functions.text import bind
from railweave.operators.linking import scored_frame
from railweave.operators.scale import Stage, top_per_group

_EDGE = "[" + "".join(re.escape(c) for c in W.MENTION_BOUNDARY_CHARS) + "]+"


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, _EDGE), lambda t: t != ""))


def find_mentions(docs: DataFrame, places: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, mentions): places found in each text that has any, ordered by position.

    ``places(name, ord)``; a mention is struct<start, end, text> with 0-based offsets.
    A place counts when its first occurrence stands between boundary characters; longer
    names claim their characters first.

    Each name is looked up by its rarest token, an equi-join that can only miss names
    that are not in the text.  Only texts with a candidate are read a second time.
    """
    lowered = places.select(F.lower("name").alias("place"), "ord").filter(
        F.length("place") >= 3).groupBy("place").agg(F.min("ord").alias("ord"))
    place_tokens = lowered.select("place", "ord", F.explode(_tokens(F.col("place"))).alias("token"))
    frequency = place_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    keyed = place_tokens.join(frequency, "token").groupBy("place").agg(
        # among equally rare tokens the longest is the least common in texts
        F.min_by("token", F.struct("df", -F.length("token"), "token")).alias("token"),
        F.first("ord").alias("ord"))
    found = docs.select(key, F.explode(_tokens(F.lower(text))).alias("token")).join(
        keyed, "token").groupBy(key).agg(
        F.collect_list(F.struct((-F.length("place")).alias("len"), "ord", "place")).alias("places"))
    # the text is lowered once per row, also where the optimiser repeats the expression
    mentions = bind(F.lower(text), lambda value: bind(
        _bounded_places(value, F.col("places")), _longest_first))
    return docs.select(key, text).join(found, key).select(key, mentions.alias("mentions")).filter(
        F.size("mentions") > 0)


def _bounded_places(value: Column, places: Column) -> Column:
    """First occurrence of each place in the text, where it stands between boundaries."""
    edges = F.lit(W.MENTION_BOUNDARY_CHARS)

    def at_edge(position: Column) -> Column:
        char = F.substring(value, position, F.lit(1))
        return (position < 1) | (char == "") | F.contains(edges, char)

    # F.locate only takes a literal needle
    placed = F.transform(F.sort_array(places), lambda p: F.struct(
        F.call_function("locate", p["place"], value).alias("at"),
        F.length(p["place"]).alias("len"), p["place"].alias("place")))
    return F.filter(placed, lambda m: (m["at"] > 0) & at_edge(m["at"] - 1)
                    & at_edge(m["at"] + m["len"]))


def _longest_first(places: Column) -> Column:
    """Fold over places ordered by length: one that overlaps a taken span is dropped."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def keep(taken: Column, m: Column) -> Column:
        start, end = m["at"] - 1, m["at"] - 1 + m["len"]
        clash = F.exists(taken, lambda t: (t["start"] < end) & (t["end"] > start))
        mention = F.struct(start.alias("start"), end.alias("end"), m["place"].alias("text"))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(mention)))

    return F.sort_array(F.aggregate(places, empty, keep))


def title_case(name: Column) -> Column:
    """'saint-denis' -> 'Saint-Denis': a capital after every non-letter."""
    pieces = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(pieces, F.initcap), "")


def normalised(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(
        F.transform(vector, lambda x: x.cast("double")))


def mean_pool(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Mean vector per key, combined map-side."""
    return vectors.groupBy(key).agg(F.array(*[
        F.avg(F.element_at(vector, i + 1).cast("double")) for i in range(dims)]).alias(vector))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


#: Angles are widened by this much, more than rounding can move one.
SLACK = 1e-6
#: Cell of zero vectors, which stand at a right angle to everything.
ZERO_CELL = -1


def _unit_vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, vec) as unit vectors; a vector that is missing or holds a missing value or NaN is left out."""
    broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    return df.select(key, normalised(F.col("vec")).alias("vec")).filter(F.col("vec").isNotNull() & ~broken)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def place_cells(places: DataFrame, pivots: np.ndarray) -> DataFrame:
    """places(place, vec) with the number of their nearest pivot (``cell``) and the angle to it."""
    def assign(parts):
        for part in filter(len, parts):
            vectors = np.stack(part["vec"].to_numpy())
            zero = ~vectors.any(axis=1)
            cell, angle = np.full(len(part), ZERO_CELL), np.full(len(part), np.pi / 2)
            if len(pivots):
                far = _angles(vectors, pivots)
                cell = np.where(zero, ZERO_CELL, far.argmin(axis=1))
                angle = np.where(zero, np.pi / 2, far.min(axis=1))
            yield part.assign(cell=cell.astype("int32"), angle=angle)

    place_type = places.schema["place"].dataType.simpleString()
    return places.mapInPandas(assign, f"place {place_type}, vec array<double>, cell int, angle double")


def reached_cells(queries: DataFrame, pivots: np.ndarray, rings: dict[int, tuple[float, float]],
                  k: int, threshold: float) -> DataFrame:
    """queries(q, vec) with the cells that may hold one of their ``k`` best places.

    A place within angle ``a`` of the query lies within ``a`` of the query's own angle to the pivot, so a
    cell whose ring (least and greatest angle of its places) lies further off is ruled out.  ``a`` comes
    from the threshold and, as pivots are places too, from the k-th nearest pivot.
    """
    widest = float(np.arccos(np.clip(threshold, -1.0, 1.0))) if threshold <= 1 else -1.0
    cells = [c for c in sorted(rings) if c != ZERO_CELL]
    low, high = (np.array([rings[c][i] for c in cells], dtype=float) for i in (0, 1))

    def reach(parts):
        for part in filter(len, parts):
            vectors = np.stack(part["vec"].to_numpy())
            zero = ~vectors.any(axis=1)
            far = _angles(vectors, pivots) if len(pivots) else np.zeros((len(part), 0))
            near = np.sort(far, axis=1)[:, k - 1] if far.shape[1] >= k else np.full(len(part), np.pi)
            # a zero vector scores 0 everywhere, so nothing but the threshold rules a cell out
            bound = np.where(zero, widest, np.minimum(near, widest)) + SLACK
            own = far[:, cells] if cells else far
            touched = (own - bound[:, None] <= high) & (own + bound[:, None] >= low) & (bound > 0)[:, None]
            right_angle = bound >= np.pi / 2
            touched[zero] = right_angle[zero, None]
            found = [[cells[i] for i in np.flatnonzero(row)] for row in touched]
            if ZERO_CELL in rings:
                found = [f + [ZERO_CELL] if r else f for f, r in zip(found, right_angle)]
            yield part.assign(cells=found)

    q_type = queries.schema["q"].dataType.simpleString()
    return queries.mapInPandas(reach, f"q {q_type}, vec array<double>, cells array<int>")


def nearest_places(queries: DataFrame, places: DataFrame, k: int = 1, threshold: float = 0.85,
                   pivots: int = 256, block_rows: int = 20_000) -> DataFrame:
    """queries(q, vec) x places(place, vec) -> (q, place, score, rank), exact.

    About sqrt(places) of the places, ``pivots`` at most, serve as pivots; every place belongs to its
    nearest one, and a query meets only the cells that ``reached_cells`` cannot rule out.  A cell and the
    queries that reach it are dealt into blocks of about ``block_rows``, so no task grows with the data;
    one matrix product scores a pair of blocks and only the best k per query leave it.  Scores are
    rounded to 12 digits, and equal ones go by place.  Vectors that are missing or hold a missing value
    or NaN match nothing.
    """
    stage = Stage(queries.sparkSession, "nearest")
    units = stage.save(_unit_vectors(places, "place"))
    wanted = min(pivots, math.isqrt(units.count()) + 1)
    chosen = units.filter(F.exists("vec", lambda x: x != 0)).orderBy(
        F.xxhash64("place", "vec"), "place").limit(wanted).collect()
    pivot_rows = np.array([row.vec for row in chosen], dtype=float)
    known = stage.save(place_cells(units, pivot_rows))
    # one row per pivot
    sizes = {r.cell: r for r in known.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    rings = {cell: (r.low, r.high) for cell, r in sizes.items()}
    asked = stage.save(reached_cells(_unit_vectors(queries, "q"), pivot_rows, rings, k, threshold))
    visits = asked.select("q", "vec", F.explode("cells").alias("cell"))
    counts = {r.cell: r["count"] for r in visits.groupBy("cell").count().collect()}
    dealt = queries.sparkSession.createDataFrame(
        [(cell, -(-r.n // block_rows), -(-counts[cell] // block_rows)) for cell, r in sizes.items() if cell in counts],
        "cell int, blocks long, slices long")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = visits.join(dealt, "cell").select(
        "q", "vec", "cell", F.pmod(F.xxhash64("q"), "slices").alias("s"), numbers("blocks").alias("b"))
    right = known.join(dealt, "cell").select(
        "place", "vec", "cell", F.pmod(F.xxhash64("place", "vec"), "blocks").alias("b"), numbers("slices").alias("s"))

    def score(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return scored_frame([], "place")
        known = known.sort_values("place")
        names = known["place"].to_numpy()
        matrix = np.stack(known["vec"].to_numpy()).T
        out = []
        # a few thousand query rows at a time bound the score matrix
        step = max(1, 20_000_000 // len(names))
        for begin in range(0, len(asked), step):
            part = asked.iloc[begin:begin + step]
            scores = np.round(np.stack(part["vec"].to_numpy()) @ matrix, 12)
            for q, row in zip(part["q"], scores):
                best = np.argsort(-row, kind="stable")[:k]
                out += [(q, names[i], float(row[i])) for i in best if row[i] >= threshold]
        return scored_frame(out, "place")

    types = {"q": queries.schema["q"].dataType.simpleString(), "place": places.schema["place"].dataType.simpleString()}
    key = ("cell", "s", "b")
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        score, f"q {types['q']}, place {types['place']}, score double")
    return top_per_group(best, ["q"], [F.desc("score"), F.col("place")], k)
