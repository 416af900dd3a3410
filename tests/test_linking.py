"""D11-D15 against brute force, and the search cascade's exact substring join."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.operators import candidates as C
from railweave.operators import gazetteer as G
from railweave.operators import linking as L
from railweave.operators.mentions import nearest_places, reached_cells

NAMES = ["paris gare de lyon", "paris est", "lyon part dieu", "lyon perrache", "marseille st charles",
         "bordeaux st jean", "nantes", "rennes", "lille flandres", "lille europe", "strasbourg",
         "mulhouse ville", "dijon ville", "nice ville", "toulouse matabiau", "grenoble", "avignon tgv",
         "aix en provence tgv", "saint etienne chateaucreux", "saint malo", "la rochelle ville",
         "le mans", "le havre", "metz ville", "nancy ville", "brest", "quimper", "angers st laud",
         "tours", "orleans"]
QUERIES = ["nante", "bordeau", "lyon", "pari", "strasbour", "st charles marseille", "gare de lyon",
           "saint etiene", "le hvare", "xyz123", "ville", "aix", "paris", "grenobel", "tgv avignon", "a"]


def stations(spark):
    return spark.createDataFrame([(str(i), n, n, "", f"{i:04d}") for i, n in enumerate(NAMES)],
                                 "uic string, name string, name_norm string, commune string, ord string")


def classic_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_the_classic_table():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 150))) for _ in range(60)]
    block = L.NameBlock(words)
    for query in words[:20]:
        want = [classic_lcs(query, w) for w in words]
        assert [L.lcs(query, w) for w in words] == want
        if query:
            assert block.common(query).tolist() == want


def test_bound_never_undercuts_the_score():
    rng = random.Random(2)
    words = NAMES + [" ".join(rng.choice(["aa", "ab", "ba", "c", "aab"]) for _ in range(rng.randint(1, 6)))
                     for _ in range(200)]
    block = L.NameBlock(words)
    for query in QUERIES + words[-40:]:
        bound = L.weighted_bound(block, query, block.common(query))
        for i, word in enumerate(words):
            assert L.weighted_ratio(query, word) <= bound[i] + 1e-6, (query, word)


@pytest.mark.parametrize("letters,most", [("ab", 3), ("abcd", 5), ("abcdefgh", 2), ("aé", 8)])
def test_pruned_block_top_is_exact(letters, most):
    rng = random.Random(letters + "!")
    names, queries = strings(rng, 150, letters, most), strings(rng, 40, letters, most) + ["", "zz", "a" * 70, "a  b"]
    names = names + ["", " ", "b" * 80] + [f"line {'ab' * (i % 3)} east {i}" for i in range(300)]
    block = L.NameBlock(names)
    for query in queries + ["east 12", "line ab east", "lne abab east 77"]:
        full = [L.weighted_ratio(query, n) for n in names]
        for k, floor in ((1, 80.0), (5, -1.0), (10, 80.0), (1000, -1.0)):
            want = sorted((-s, i) for i, s in enumerate(full) if s >= floor)[:k]
            assert L._top_weighted(block, query, k, floor) == [(i, -s) for s, i in want], (query, k, floor)


def test_few_names_scored_one_by_one(monkeypatch):
    """What counts and lengths settle is not scored again: the old bound left every name with a common token."""
    names = [f"{w} {v} small {i}" for i in range(400) for w in ("old", "large") for v in ("ring", "gear")]
    scored, real = [], L.weighted_ratio
    monkeypatch.setattr(L, "weighted_ratio", lambda *a, **k: scored.append(a) or real(*a, **k))
    for query in ("old rng small 321", "small 77", "ring large"):
        scored.clear()
        L._top_weighted(L.NameBlock(names), query, 5)
        assert len(scored) < len(names) / 2, (query, len(scored))


def test_slices_follow_the_cores(spark):
    """A few thousand pairs of one slice and one block used to be one task."""
    q = spark.createDataFrame([(f"stop {i}",) for i in range(400)], "q string")
    names = spark.createDataFrame([(f"stop {i}", f"{i:04d}") for i in range(300)], "name string, ord string")
    top = L.fuzzy_top(q, names, "name", 1, "weighted")
    cells = re.findall(r"hashpartitioning\(_slice#\d+L?, _block#\d+L?, (\d+)\)", top._jdf.queryExecution().toString())
    assert cells and min(map(int, cells)) >= 8
    assert all(r.name == r.q for r in top.collect() if int(r.q.split()[1]) < 300)


def best_link(query):
    """The rule in plain Python: prefix, else the best of both top tens."""
    for name in NAMES:
        if name.startswith(query + " "):
            return name, 95.0
    firsts = {}
    for name in NAMES:
        firsts.setdefault(name.split(" ")[0], name)
    by_first = sorted(firsts, key=lambda w: -L.ratio(query, w))[:10]
    scores = {}
    for word in by_first:
        scores[firsts[word]] = min(100, L.ratio(query, word) + 20)
    for name in sorted(NAMES, key=lambda n: -L.weighted_ratio(query, n))[:10]:
        scores[name] = max(scores.get(name, 0), L.weighted_ratio(query, name))
    name = max(scores, key=scores.get)
    return (name, scores[name]) if scores[name] >= 80 else None


@pytest.mark.parametrize("block_names", [20_000, 7])
def test_links_equal_brute_force(spark, block_names):
    df = spark.createDataFrame([(q,) for q in QUERIES] + [("",), (None,)], "query string")
    got = {r.query: (r.name, r.score) for r in L.link_names(df, stations(spark), block_names=block_names).collect()}
    for query in QUERIES:
        want = best_link(query)
        if want is None:
            assert query not in got
        else:
            assert got[query][0] == want[0] and got[query][1] == pytest.approx(want[1])
    assert "" not in got and None not in got


def test_fixture_expectations(spark):
    df = spark.createDataFrame([("Nante",), ("bordeau",), ("lyon",)], "query string")
    got = {r.query: r for r in L.link_names(df, stations(spark)).collect()}
    assert "nantes" in got["Nante"].name and got["Nante"].score >= 75
    assert "bordeaux" in got["bordeau"].name and got["lyon"].name.startswith("lyon")
    strict = L.link_names(spark.createDataFrame([("XYZ123",)], "query string"), stations(spark), threshold=95)
    assert strict.count() == 0


def test_exact_first_option(spark):
    more = stations(spark).union(spark.createDataFrame([("99", "lyon", "lyon", "", "9999")]))
    df = spark.createDataFrame([("lyon",)], "query string")
    assert L.link_names(df, more).first().name == "lyon part dieu"
    assert L.link_names(df, more, exact_first=True).first().name == "lyon"


def test_details_are_the_true_top(spark):
    df = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    got = {}
    for r in L.link_details(df, stations(spark), 4, block_names=7).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.score)
    for query in QUERIES:
        want = sorted((L.weighted_ratio(query, n) for n in NAMES), reverse=True)[:4]
        assert got[query] == pytest.approx(want)


def strings(rng, n, letters, most):
    """Short strings over few letters, with repeated tokens, single letters and long ones."""
    made = set()
    while len(made) < n:
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 7]))) for _ in range(rng.randint(1, most))]
        made.add(" ".join(words))
    return sorted(made)


@pytest.mark.parametrize("letters,most", [("ab", 3), ("abcd", 5), ("abcdefgh", 2), ("aé", 8)])
def test_candidates_lose_no_pair_above_the_threshold(spark, letters, most):
    rng = random.Random(letters)
    names, queries = strings(rng, 70, letters, most), strings(rng, 70, letters, most)
    n = spark.createDataFrame([(v, f"{i * 7 % 70:04d}") for i, v in enumerate(names)], "name string, ord string")
    q = spark.createDataFrame([(v,) for v in queries], "q string")
    order = {v: f"{i * 7 % 70:04d}" for i, v in enumerate(names)}
    for scorer, weighted, threshold in ((L.ratio, False, 200 / 3), (L.ratio, False, 90.0), (L.weighted_ratio, True, 80.0)):
        got = {}
        for r in C.best_above(q, n, "name", 3, scorer, weighted, threshold).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append((r.name, r.score))
        for query in queries:
            best = sorted(((-scorer(query, v), order[v], v) for v in names))[:3]
            want = [(v, -s) for s, _, v in best if -s >= threshold]
            assert got.get(query, []) == want, (query, scorer.__name__)


def test_random_links_equal_blocks(spark):
    rng = random.Random(9)
    names = sorted({" ".join(rng.choice(["saint", "gare", "ville", "mont", "le", "rivage", "valbon", "est"]) + rng.choice(["", "", "s", "x"])
                             for _ in range(rng.randint(1, 4))) for _ in range(90)})
    queries = sorted({v.replace(rng.choice("aeilnst"), "", 1) for v in names} | {"zz", "saint", "estx gares", "q"})
    st = spark.createDataFrame([(str(i), v, v, "", f"{i:04d}") for i, v in enumerate(names)],
                               "uic string, name string, name_norm string, commune string, ord string")
    df = spark.createDataFrame([(v,) for v in queries], "query string")
    fast = {r.query: (r.name, r.score) for r in L.link_names(df, st).collect()}
    global NAMES
    before, NAMES = NAMES, names
    try:
        want = {v: best_link(v) for v in queries}
    finally:
        NAMES = before
    assert fast == {v: x for v, x in want.items() if x}


def test_known_scores():
    assert L.weighted_ratio("lyon", "lyon") == 100
    assert L.ratio("lion", "lyon") == 75
    assert L.token_ratio("gare paris", "paris gare") == 100
    assert L.partial_ratio("lyon", "gare de lyon") == 100


def test_slots_keep_what_does_not_link(spark):
    rows = spark.createDataFrame([(1, "nante", "zzzqqq", ["lile", "brest"]), (2, None, "", [])],
                                 "id int, departure string, destination string, intermediate array<string>")
    got = {r.id: r for r in L.link_slots(rows, stations(spark), "id").collect()}
    assert (got[1].departure, got[1].destination, got[1].intermediate) == ("nantes", "zzzqqq", ["lille flandres", "brest"])
    assert got[2].departure is None and got[2].destination == ""


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    needles = sorted({make(rng.randint(1, 5)) for _ in range(40)})
    hays = sorted({make(rng.randint(1, 9)) for _ in range(60)})
    got = {(r.needle, r.hay) for r in G.containment_pairs(
        spark.createDataFrame([(n,) for n in needles], "needle string"),
        spark.createDataFrame([(h,) for h in hays], "hay string")).collect()}
    assert got == {(n, h) for n in needles for h in hays if n in h}


PASSENGER = [("Paris Gare de Lyon", "PLY", 2.37, 48.84, "87686006"), ("Lyon Part Dieu", "LPD", 4.86, 45.76, "87723197"),
             ("Marseille St Charles", "MSC", 5.38, 43.30, "87751008"),
             ("Aeroport Charles de Gaulle 2 TGV", "RYT", 2.57, 49.0, "87271494;87001479")]


def test_gazetteer_fixture(spark):
    p = spark.createDataFrame([(n, s, "A", (lon, lat), "", k, i) for i, (n, s, lon, lat, k) in enumerate(PASSENGER)],
                              "nom string, libellecourt string, segment_drg string, position_geographique struct<lon double, lat double>, "
                              "codeinsee string, codes_uic string, ord long")
    rows = [("87686006", "Paris", "N", "O", "830000", "PARIS", "PARIS", 2.37, 48.84, None, "1+0", 0),
            ("87723197", "Lyon", "O", "O", "830000", "", "RHONE", 4.86, 45.76, None, "2+0", 1),
            ("87723197", "Lyon", "N", "O", "840000", "LYON", "X", 4.86, 45.76, None, "2+0", 2),
            ("87999999", "Fret", "O", "N", "999000", "FRET", "Y", 1.0, 44.0, None, "3+0", 3),
            ("87001479", "CDG", "N", "O", "226000", "ROISSY", "VAL", 2.5, 49.0, None, "4+0", 4)]
    lines = spark.createDataFrame(rows, "code_uic string, libelle string, fret string, voyageurs string, code_ligne string, commune string, "
                                        "departemen string, x_wgs84 double, y_wgs84 double, c_geo struct<lon double, lat double>, pk string, ord long")
    st = G.merge_gazetteer(p, lines)
    got = {r.uic: r for r in st.collect()}
    assert len(got) == 6
    assert got["87686006"].commune == "PARIS" and got["87686006"].department == "PARIS"
    assert got["87723197"].commune == "LYON" and got["87723197"].department == "RHONE"
    assert got["87723197"].line_codes == ["830000", "840000"] and got["87723197"].is_freight is False
    assert got["87271494"].name == got["87001479"].name and got["87271494"].commune == "ROISSY"
    assert got["87999999"].is_freight and not got["87999999"].is_passenger
    aliases = G.alias_table(spark)
    hits = G.search_cascade(spark.createDataFrame([("cdg",), ("Lyon",), ("marseille",), ("de gaulle",)], "query string"), st, aliases)
    first = {r.query: r.name for r in G.first_hit(hits, st).collect()}
    assert first["cdg"].startswith("Aeroport") and first["Lyon"] == "Lyon Part Dieu" and first["de gaulle"].startswith("Aeroport")


@pytest.mark.parametrize("limit", [1, 3])
def test_first_holders_equal_brute_force(spark, limit):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    needles = sorted({make(rng.randint(1, 5)) for _ in range(30)} | {"", "zz"})
    names = [(make(rng.randint(0, 8)), i) for i in range(50)] + [("abab", 90), ("abab", 91), (None, 92)]
    got = {(r.needle, r.rank): (r.tier, r.ord) for r in G.first_holders(
        spark.createDataFrame([(n,) for n in needles] + [(None,), ("ab",)], "needle string"),
        spark.createDataFrame(names, "hay string, ord int"), ["ord"], limit).collect()}
    want = {}
    for needle in filter(None, {*needles, "ab"}):
        tier = lambda h: 0 if h == needle else 1 if h.startswith(needle) else 2  # noqa: E731,B023
        found = sorted((tier(h), o) for h, o in names if h is not None and needle in h)
        want.update({(needle, i): f for i, f in enumerate(found[:limit], 1)})
    assert got == want


def test_first_hits_are_the_first_of_all_hits(spark):
    rng = random.Random(5)
    make = lambda: " ".join(rng.choice(["gare", "nord", "sud", "lyon", "paris", "ville"]) for _ in range(rng.randint(1, 3)))
    names = [make() for _ in range(80)]
    st = spark.createDataFrame([(f"u{i}", n, n, rng.choice(["", "paris", "lyon nord"]), f"{i:04}") for i, n in enumerate(names)],
                               "uic string, name string, name_norm string, commune string, ord string")
    aliases = spark.createDataFrame([("paris", "capitale"), ("lyon", "capitale")], "name_norm string, alias string")
    asked = spark.createDataFrame([(make(),) for _ in range(30)] + [("capitale",), ("ar",), ("ille no",), ("x",)], "query string")
    hits = {}
    for r in G.search_cascade(asked, st, aliases).collect():
        hits.setdefault(r.query, []).append((r.tier, r.ord, r.uic))
    for limit in (1, 4):
        got = {}
        for r in G.search_cascade(asked, st, aliases, limit=limit).collect():
            got.setdefault(r.query, []).append((r.tier, r.ord, r.uic))
        assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:limit] for q, v in hits.items()}


@pytest.mark.parametrize("k, threshold, pivots, block", [(1, -1.0, 256, 20_000), (3, 0.85, 9, 7), (2, 0.0, 1, 20_000), (4, 0.5, 3, 5), (1, 1.5, 4, 9)])
def test_nearest_places_equal_brute_force(spark, k, threshold, pivots, block):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5))
    def vectors(n):
        return [(centres[i % 6] + rng.normal(scale=0.2, size=5)).tolist() for i in range(n)]
    # a third of the places are copies; some vectors are zero, missing or broken
    places = [(f"p{i:03}", v) for i, v in enumerate(vectors(60) + [centres[0].tolist()] * 30 + [[0.0] * 5] * 2)]
    queries = list(enumerate(vectors(40) + [centres[0].tolist(), [0.0] * 5]))
    broken = [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5]
    got = {(r.q, r.rank): (r.place, round(r.score, 9)) for r in nearest_places(
        spark.createDataFrame(queries + [(100 + i, v) for i, v in enumerate(broken)], "q int, vec array<double>"),
        spark.createDataFrame(places + [(f"x{i}", v) for i, v in enumerate(broken)], "place string, vec array<double>"),
        k, threshold, pivots, block).collect()}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = {}
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(p)), 12), name) for name, p in places)
        want.update({(q, i): (name, round(-s, 9) + 0.0) for i, (s, name) in enumerate(
            [x for x in scored if -x[0] >= threshold][:k], 1)})
    assert got == want


def test_far_cells_are_ruled_out(spark):
    pivots = np.eye(8)
    rings = {i: (0.0, 0.1) for i in range(8)}
    rows = spark.createDataFrame([(i, np.eye(8)[i].tolist()) for i in range(8)], "q int, vec array<double>")
    assert {r.q: r.cells for r in reached_cells(rows, pivots, rings, 1, 0.85).collect()} == {i: [i] for i in range(8)}


def test_nothing_is_near_in_empty_tables(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0])], "q int, vec array<double>")
    places = spark.createDataFrame([("a", [1.0, 0.0])], "place string, vec array<double>")
    assert nearest_places(some, places.limit(0)).count() == 0
    assert nearest_places(some.limit(0), places).count() == 0


def test_postings_in_blocks(spark):
    rows = [("hot", f"u{i:03}", f"{i:03}") for i in range(25)] + [("cold", "c", "000"), ("cold", "c", "000"), (None, "n", "001")]
    got = sorted(((r.key or ""), r.block, r.n, r.uics) for r in G.postings(
        spark.createDataFrame(rows, "key string, uic string, ord string"), 10).collect())
    hot = [f"u{i:03}" for i in range(25)]
    assert got == [("", 0, 1, ["n"]), ("cold", 0, 1, ["c"])] + [("hot", b, 25, hot[10 * b:10 * b + 10]) for b in range(3)]
