"""Searches over tables that grow: what goes through the driver, and how many pairs meet."""

import pytest

from railweave.operators import gazetteer as G
from railweave.operators.scale import Stage

STATIONS = "uic string, name string, name_norm string, commune string, ord string"


@pytest.fixture()
def station_table(spark):
    return Stage(spark, "test").save(spark.createDataFrame([
        (str(i), f"Gare {i:05d}", f"gare {i:05d}", f"Ville {i % 3}", f"{i:05d}") for i in range(60)], STATIONS))


def test_search_first_broadcasts_no_table_that_grows(spark, station_table):
    queries = Stage(spark, "test").save(spark.createDataFrame([("Gare 00007",), ("00012",), ("bis",), ("Gare 00003 Nord",), ("Ville 1",), ("nulle part",)], "query string"))
    aliases = Stage(spark, "test").save(spark.createDataFrame([("gare 00009", "bis")], "name_norm string, alias string"))
    found = G.first_hit(G.search_cascade(queries, station_table, aliases, limit=1), station_table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert {(r["query"], r["uic"]) for r in found.collect()} == {
        ("Gare 00007", "7"), ("00012", "12"), ("bis", "9"), ("Gare 00003 Nord", "3"), ("Ville 1", "1")}


def test_names_that_share_a_pattern_meet_by_longer_pieces(spark):
    names = [f"arret {i:09d}" for i in range(300)]
    rest = ["00", "arr", "arret 00000001", "ret 000000123 x", "zz", "", "a"]
    hays = [n + " bis" for n in names] + ["ar", "arret", "1", "", "a"]
    ask = spark.createDataFrame([(n,) for n in names + rest], "needle string")
    have = spark.createDataFrame([(h,) for h in hays], "hay string")
    found = G.containment_pairs(ask, have)
    got = [(r.needle, r.hay) for r in found.collect()]
    assert sorted(got) == sorted((n, h) for n in names + rest for h in hays if n and n in h)
    # a name of twelve digits and letters has a key that few others hold, not three digits out of a thousand
    assert max(len(k) for (k,) in spark.createDataFrame([("arret 000000123",)], "needle string").select(
        G.F.explode(G.pieces(G.F.col("needle"), G.F.lit(G.PIECE)))).collect()) == 8
