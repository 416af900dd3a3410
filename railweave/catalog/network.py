"""Queries of the network and routing jobs (sections D2-D4, D9, D16, D22, D23, E27-E29, F1-F4, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave.catalog import query, table
from railweave.catalog import sql as S
from railweave.functions.labels import route_line
from railweave.operators import network as N
from railweave.operators import routing as R
from railweave.plans import roles
from railweave.plans.resolve import resolve_routes

ROUNDS = 24  # relaxation rounds of the unrolled oracle, well beyond the longest best path

NODES = """node AS (SELECT s_suppkey::VARCHAR AS uic, s_name AS name, s_suppkey AS ord, s_nationkey AS hub,
  42 + (s_suppkey * 37 % 900) / 100.0::DOUBLE AS lat, -4 + (s_suppkey * 53 % 1200) / 100.0::DOUBLE AS lon FROM supplier)"""
STOPS = f"""{NODES}, stop AS (SELECT DISTINCT l_orderkey::VARCHAR AS line, l_suppkey::VARCHAR AS uic,
  l_linenumber + lpad((l_quantity * 10)::INT::VARCHAR, 3, '0')::DOUBLE / 1000 AS pk FROM lineitem)"""
EDGES = f"""{STOPS},
kept AS (SELECT * FROM stop QUALIFY uic IS DISTINCT FROM lag(uic) OVER (PARTITION BY line ORDER BY pk, uic)),
pair AS (SELECT line, uic AS src, pk, lead(uic) OVER w AS dst, lead(pk) OVER w AS pk_next FROM kept WINDOW w AS (PARTITION BY line ORDER BY pk, uic)),
raw AS (SELECT line, src, dst, abs(pk_next - pk) AS along, {S.distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS direct,
  o_orderpriority = '1-URGENT' AS fast FROM pair JOIN node a ON a.uic = src JOIN node b ON b.uic = dst LEFT JOIN orders ON o_orderkey::VARCHAR = line),
dist AS (SELECT *, CASE WHEN along < 0.1 OR along > 500 THEN direct ELSE along END AS dist_km FROM raw),
edge AS (SELECT src, dst, line, 'TRAIN' AS type, dist_km, CASE WHEN fast THEN dist_km / 3.0 ELSE dist_km END AS weight,
  CASE WHEN fast THEN 280.0 ELSE 80.0 END AS speed FROM dist WHERE dist_km >= 0.1)"""
WALKS = f"""walk AS (SELECT hub, src, dst, km FROM (SELECT a.hub, a.uic AS src, b.uic AS dst, {S.distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km
  FROM node a JOIN node b ON a.hub = b.hub AND a.ord < b.ord) WHERE km < 8)"""
ARCS = f"""{EDGES}, {WALKS},
both_edges AS (SELECT src, dst, line, type, dist_km, weight, speed FROM edge UNION ALL SELECT src, dst, 'TRANSFERT', 'WALK', km, 15.0, 5.0 FROM walk),
arc AS (SELECT src, dst, line, type, dist_km, weight, speed FROM both_edges UNION ALL SELECT dst, src, line, type, dist_km, weight, speed FROM both_edges),
best_arc AS MATERIALIZED (SELECT src, dst, min(weight) AS weight, arg_min(line, {{'w': weight, 'l': line}}) AS line, arg_min(type, {{'w': weight, 'l': line}}) AS type FROM arc GROUP BY 1, 2)"""
REQUESTS = """hub AS (SELECT s_nationkey AS n, min(s_suppkey) AS first, max(s_suppkey) AS last FROM supplier GROUP BY 1),
request AS (SELECT a.n AS rid, a.first::VARCHAR AS origin, b.last::VARCHAR AS goal FROM hub a JOIN hub b ON b.n = (a.n + 1) % 25)"""


def relaxed(origins: str) -> str:
    """CTE 'reach'(origin, node, cost, path): unrolled min-plus rounds from some origins."""
    text = f"d0 AS MATERIALIZED (SELECT DISTINCT origin, origin AS node, 0.0::DOUBLE AS cost, [origin] AS path FROM ({origins}))"
    for k in range(1, ROUNDS + 1):
        text += f""",
d{k} AS MATERIALIZED (SELECT origin, node, min(cost) AS cost, arg_min(path, cost) AS path FROM (SELECT * FROM d{k - 1} UNION ALL
  SELECT origin, dst, cost + weight, list_append(path, dst) FROM d{k - 1} JOIN best_arc ON node = src) GROUP BY 1, 2)"""
    return text + f", reach AS (SELECT * FROM d{ROUNDS})"


@query("nodes_build", f"WITH {NODES} SELECT uic, name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM node")
def nodes_build(spark, sf):
    """I1, C2."""
    return roles.network_nodes(spark, sf).select("uic", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("line_stops", f"WITH {STOPS} SELECT line, count(*) AS n, round(min(pk), 6) AS first, round(max(pk), 6) AS last FROM stop GROUP BY 1")
def line_stops(spark, sf):
    """C1, D2, B3."""
    stops = N.line_stops(roles.line_rows(spark, sf), roles.network_nodes(spark, sf)).distinct()
    return stops.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("pk"), 6).alias("first"),
                                     F.round(F.max("pk"), 6).alias("last"))


@query("line_attributes", """SELECT o_orderkey::VARCHAR AS line, o_orderpriority = '1-URGENT' AS is_high_speed,
  round(42 + (o_orderkey * 37 % 900) / 100.0, 6)::DOUBLE AS first_lat, round(-4 + ((o_orderkey + 1) * 53 % 1200) / 100.0, 6)::DOUBLE AS last_lon FROM orders""")
def line_attributes(spark, sf):
    """High-speed flag and flipped geometry."""
    lines = N.line_attributes(roles.railway_lines(spark, sf))
    return lines.select("line", "is_high_speed", F.round(F.col("geometry")[0][0], 6).alias("first_lat"),
                        F.round(F.col("geometry")[1][1], 6).alias("last_lon"))


@query("edges_build", f"""WITH {EDGES} SELECT src, dst, line, round(dist_km, 6) AS dist_km, round(weight, 6) AS weight, speed::DOUBLE AS speed FROM edge""")
def edges_build(spark, sf):
    """F2, F1, C9 and weights over all line items."""
    return roles.network_edges(spark, sf).select(
        "src", "dst", "line", F.round("dist_km", 6).alias("dist_km"), F.round("weight", 6).alias("weight"), "speed")


@query("edge_geometry", f"WITH {EDGES} SELECT line, count(*) AS n, round(42 + (line::BIGINT * 37 % 900) / 100.0, 6)::DOUBLE AS first_lat FROM edge GROUP BY 1")
def edge_geometry(spark, sf):
    """Geometry attached to edges."""
    lines = N.line_attributes(roles.railway_lines(spark, sf))
    return N.with_geometry(roles.network_edges(spark, sf), lines).groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(F.col("geometry")[0][0]), 6).alias("first_lat"))


@query("hub_transfers", f"WITH {NODES}, {WALKS} SELECT hub::VARCHAR AS hub, src, dst, round(km, 6) AS km FROM walk")
def hub_transfers(spark, sf):
    """D16."""
    return N.hub_transfers(roles.nation_hubs(spark, sf)).select("hub", "src", "dst", F.round("dist_km", 6).alias("km"))


@query("wide_transfers", f"""WITH {NODES}, near AS (SELECT hub, a AS src, b AS dst, km FROM (SELECT a.hub, a.uic AS a, b.uic AS b, {S.distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km
  FROM node a JOIN node b ON a.hub = b.hub AND a.ord < b.ord) WHERE km < 200) SELECT hub::VARCHAR AS hub, src, dst, round(km, 6) AS km FROM near""")
def wide_transfers(spark, sf):
    """D16 with a wider radius, so that many pairs qualify."""
    return N.hub_transfers(roles.nation_hubs(spark, sf), 200.0).select(
        "hub", "src", "dst", F.round("dist_km", 6).alias("km"))


@query("arcs_build", f"WITH {ARCS} SELECT type, count(*) AS n, round(sum(dist_km), 3) AS km, round(sum(weight), 3) AS weight FROM arc GROUP BY 1")
def arcs_build(spark, sf):
    """Transfers appended, both directions."""
    return roles.network_arcs(spark, sf).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("dist_km"), 3).alias("km"), F.round(F.sum("weight"), 3).alias("weight"))


@query("edge_min", f"WITH {ARCS} SELECT src, dst, line, round(weight, 6) AS weight FROM best_arc")
def edge_min(spark, sf):
    """E29."""
    return N.cheapest_arcs(roles.network_arcs(spark, sf)).select("src", "dst", "line", F.round("weight", 6).alias("weight"))


@query("network_size", f"WITH {EDGES} SELECT (SELECT count(*) FROM node) AS nodes, count(*) AS edges FROM edge")
def network_size(spark, sf):
    """E27."""
    return N.network_size(roles.network_nodes(spark, sf), roles.network_edges(spark, sf))


@query("bound_check", f"""WITH {EDGES}, b AS (SELECT weight, {S.distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km
  FROM edge JOIN node a ON a.uic = src JOIN node b ON b.uic = dst)
SELECT count(*) AS edges, count(*) FILTER (km / 3.0 > weight) AS violations, round(min(CASE WHEN km > 0 THEN weight / km END), 8) AS factor FROM b""")
def bound_check(spark, sf):
    """I11."""
    return N.bound_violations(roles.network_edges(spark, sf), roles.network_nodes(spark, sf)).withColumn(
        "factor", F.round("factor", 8))


COSTS = f"""WITH {ARCS}, {REQUESTS}, {relaxed('SELECT origin FROM request')}
SELECT rid::BIGINT AS rid, round(cost, 6) AS cost, array_to_string(path, ' ') AS path FROM request r JOIN reach d ON d.origin = r.origin AND d.node = goal"""


def _costs(spark, sf, directed):
    requests = roles.hub_requests(spark, sf)
    found = R.shortest_paths(requests, roles.network_arcs(spark, sf), roles.network_nodes(spark, sf), directed)
    return requests.join(found, ["origin", "goal"]).select(
        "rid", F.round("cost", 6).alias("cost"), F.array_join("path", " ").alias("path"))


@query("shortest_paths", COSTS)
def shortest_paths(spark, sf):
    """I4: one journey per nation over the whole network."""
    return _costs(spark, sf, False)


@query("shortest_paths_bounded", COSTS)
def shortest_paths_bounded(spark, sf):
    """The same answers with the goal-directed bound."""
    return _costs(spark, sf, True)


CHAIN = """chain AS (SELECT a.n AS rid, a.first::VARCHAR AS o, b.last::VARCHAR AS v, c.first::VARCHAR AS g FROM hub a JOIN hub b ON b.n = (a.n + 1) % 25 JOIN hub c ON c.n = (a.n + 2) % 25)"""
ROUTES = f"""{ARCS}, {REQUESTS}, {CHAIN}, {relaxed('SELECT o AS origin FROM chain UNION SELECT v FROM chain')},
route AS (SELECT rid, o, v, g, x.cost + y.cost AS cost, list_concat(x.path, y.path[2:]) AS path FROM chain
  JOIN reach x ON x.origin = o AND x.node = v JOIN reach y ON y.origin = v AND y.node = g),
hop AS (SELECT rid, o, v, g, i AS pos, path[i] AS src, path[i + 1] AS dst, len(path) AS n FROM (SELECT *, unnest(range(1, len(path))) AS i FROM route)),
lined AS (SELECT h.*, line, type, lag(line) OVER (PARTITION BY rid ORDER BY pos) AS before FROM hop h JOIN best_arc USING (src, dst)),
shown AS (SELECT rid, pos * 2 AS p, src AS uic FROM lined WHERE pos = 1 OR before <> line OR src IN (o, v, g)
  UNION ALL SELECT rid, pos * 2 + 1, dst FROM lined WHERE pos = n - 1),
named AS (SELECT rid, p, name, lag(name) OVER (PARTITION BY rid ORDER BY p) AS before FROM shown JOIN node USING (uic)),
simple AS (SELECT rid, list(name ORDER BY p) AS path FROM named WHERE name IS DISTINCT FROM before GROUP BY 1)"""


def via_requests(spark, sf):
    """Journeys with one stop: first supplier of a nation, last of the next, first of the third."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.min_by("s_name", "s_suppkey").alias("first"), F.max_by("s_name", "s_suppkey").alias("last"))
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("rid"), F.pmod(F.col("n_nationkey") + 1, F.lit(25)).alias("b"),
        F.pmod(F.col("n_nationkey") + 2, F.lit(25)).alias("c"))
    return n.join(s.select(F.col("s_nationkey").alias("rid"), F.col("first").alias("departure")), "rid").join(
        s.select(F.col("s_nationkey").alias("b"), F.array("last").alias("intermediate")), "b").join(
        s.select(F.col("s_nationkey").alias("c"), F.col("first").alias("destination")), "c").select(
        "rid", "departure", "destination", "intermediate")


@query("route_complete", f"""WITH {ROUTES}
SELECT r.rid::BIGINT AS rid, array_to_string(s.path, '|') AS path, array_to_string(r.path, ' ') AS uics, round(cost, 6) AS cost, len(s.path) AS total_stops,
  (SELECT count(*) FROM lined l WHERE l.rid = r.rid AND before <> line) AS transfers FROM route r JOIN simple s USING (rid)""")
def route_complete(spark, sf):
    """Named requests with a stop on the way."""
    done = R.complete_routes(via_requests(spark, sf), roles.network_nodes(spark, sf), roles.network_arcs(spark, sf))
    return done.filter("error IS NULL").select(
        "rid", F.array_join("path", "|").alias("path"), F.array_join("uics", " ").alias("uics"),
        F.round("cost", 6).alias("cost"), "total_stops", "transfers")


@query("route_details", f"""WITH {ROUTES}
SELECT rid::BIGINT AS rid, pos, src, a.name AS src_name, dst, b.name AS dst_name, line, type FROM lined JOIN node a ON a.uic = src JOIN node b ON b.uic = dst""")
def route_details(spark, sf):
    """Hops with names, line and type."""
    nodes, arcs = roles.network_nodes(spark, sf), roles.network_arcs(spark, sf)
    found = R.find_routes(via_requests(spark, sf), nodes, arcs)
    return R.route_details(found, nodes, arcs).select("rid", "pos", "src", "src_name", "dst", "dst_name", "line", "type")


@query("route_errors", """SELECT n_nationkey::BIGINT AS rid, n_nationkey || ', INVALID' AS line,
  'Station not found: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'unknown ' || n_name END AS error FROM nation""")
def route_errors(spark, sf):
    """Requests whose names are not in the network."""
    s = table(spark, sf, "supplier").agg(F.min("s_name").alias("known"))
    n = table(spark, sf, "nation").join(s)
    even = F.col("n_nationkey") % 2 == 0
    requests = n.select(
        F.col("n_nationkey").alias("rid"), F.when(even, F.col("n_name")).otherwise(F.col("known")).alias("departure"),
        F.concat(F.lit("unknown "), F.col("n_name")).alias("destination"), F.array("known").alias("intermediate"))
    done = R.complete_routes(requests, roles.network_nodes(spark, sf), roles.network_arcs(spark, sf))
    return done.select("rid", route_line(F.col("rid").cast("string"), F.col("path"), F.col("error")).alias("line"), "error")


SKY = """WITH c AS (SELECT DISTINCT l_partkey, l_quantity AS time, l_extendedprice AS distance, (l_discount * 100)::INT AS transfers FROM lineitem)
SELECT l_partkey, time, distance, transfers::BIGINT AS transfers FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.l_partkey = a.l_partkey
  AND b.time <= a.time AND b.distance <= a.distance AND b.transfers <= a.transfers
  AND (b.time < a.time OR b.distance < a.distance OR b.transfers < a.transfers))"""


@query("pareto_skyline", SKY)
def pareto_skyline(spark, sf):
    """I8: non-dominated line items of each part on three costs."""
    rows = table(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_quantity").alias("time"), F.col("l_extendedprice").alias("distance"),
        F.round(F.col("l_discount") * 100).cast("int").alias("transfers"))
    return R.skyline(rows, ["l_partkey"])


def region_requests(spark, sf):
    """One journey per region: its first supplier to the first one of the next region."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    first = s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("k"))
    a = first.select(F.col("n_regionkey").alias("r"), F.col("k").cast("string").alias("origin"))
    b = first.select(F.pmod(F.col("n_regionkey") - 1, F.lit(5)).alias("r"), F.col("k").cast("string").alias("goal"))
    c = first.select(F.pmod(F.col("n_regionkey") - 2, F.lit(5)).alias("r"), F.col("k").cast("string").alias("after"))
    return a.join(b, "r").join(c, "r").select(F.col("r").alias("rid"), "origin", "goal", "after")


TRADE_ROUNDS = 6  # hops of the unrolled trade-off search; the tables need fewer
JOURNEYS = """reg AS (SELECT n_regionkey AS r, min(s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
journey AS (SELECT a.r AS rid, a.k::VARCHAR AS o, b.k::VARCHAR AS v, c.k::VARCHAR AS g FROM reg a JOIN reg b ON b.r = (a.r + 1) % 5 JOIN reg c ON c.r = (a.r + 2) % 5)"""


def traded(pairs: str) -> str:
    """CTE 'legs'(o, g, rank, time, distance, transfers, path): unrolled rounds over all arcs of the network.

    Labels are (node, last line); the least distance among labels of no more time is a running minimum per
    number of transfers.
    """
    def least(level: str, keys: str, rounds: int) -> str:
        cases = " ".join(f"WHEN {level} = {t} THEN min(CASE WHEN tr <= {t} THEN km END) OVER (PARTITION BY {keys} "
                         "ORDER BY h, km, tr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for t in range(rounds))
        return f"CASE {cases} END"

    text = f"""hop AS MATERIALIZED (SELECT DISTINCT src, dst, line, dist_km / speed AS h, dist_km AS km FROM arc),
t0 AS MATERIALIZED (SELECT o, g, o AS node, NULL::VARCHAR AS line, 0::DOUBLE AS h, 0::DOUBLE AS km, 0 AS tr, [o] AS path, 0 AS round, true AS free FROM ({pairs}))"""
    for k in range(1, TRADE_ROUNDS + 1):
        text += f""",
m{k} AS (SELECT l.o, l.g, hop.dst AS node, hop.line, l.h + hop.h AS h, l.km + hop.km AS km,
    l.tr + CASE WHEN l.line IS NOT NULL AND l.line <> hop.line THEN 1 ELSE 0 END AS tr, list_append(l.path, hop.dst) AS path, {k} AS round
  FROM t{k - 1} l JOIN hop ON hop.src = l.node WHERE l.round = {k - 1} AND l.node <> l.g AND (l.free OR l.line = hop.line)),
s{k} AS (SELECT o, g, h, km, tr FROM t{k - 1} WHERE node = g),
n{k} AS (SELECT * FROM m{k} m WHERE NOT EXISTS (SELECT 1 FROM s{k} s WHERE s.o = m.o AND s.g = m.g AND s.h <= m.h AND s.km <= m.km AND s.tr <= m.tr)),
u{k} AS (SELECT o, g, node, line, h, km, tr, min(ROW(round, path)) AS best FROM (SELECT o, g, node, line, h, km, tr, path, round FROM t{k - 1}
    UNION ALL SELECT o, g, node, line, h, km, tr, path, round FROM n{k}) GROUP BY ALL),
w{k} AS (SELECT *, {least('tr', 'o, g, node', k)} AS any_km, {least('tr - 1', 'o, g, node', k)} AS spare_km, {least('tr', 'o, g, node, line', k)} AS line_km FROM u{k}),
t{k} AS MATERIALIZED (SELECT o, g, node, line, h, km, tr, best[2] AS path, best[1] AS round, coalesce(any_km > km, true) AS free FROM w{k}
  WHERE coalesce(spare_km > km, true) AND coalesce(line_km > km, true) AND NOT (node = g AND coalesce(any_km <= km, false)))"""
    return text + f""",
front AS (SELECT o, g, h, km, tr, min(path) AS path FROM t{TRADE_ROUNDS} WHERE node = g GROUP BY ALL),
legs AS (SELECT o, g, row_number() OVER (PARTITION BY o, g ORDER BY h, km, tr) AS rank, h, km, tr, path FROM front QUALIFY rank <= 3)"""


TRADED = "round({0}h, 9) AS time, round({0}km, 9) AS distance, {0}tr::INTEGER AS transfers"


def _rounded(df):
    """Sums of the same hops agree to the last bits, whichever way round they were added."""
    return df.withColumns({"time": F.round("time", 9), "distance": F.round("distance", 9)})


@query("pareto_routes", f"""WITH {ARCS}, {JOURNEYS}, {traded('SELECT o, v AS g FROM journey')}
SELECT o AS origin, g AS goal, rank::INTEGER AS rank, {TRADED.format('')}, array_to_string(path, ' ') AS path FROM legs""")
def pareto_routes(spark, sf):
    """Up to three trade-off routes per region pair over the whole network."""
    found = R.pareto_routes(region_requests(spark, sf), roles.network_arcs(spark, sf))
    return _rounded(found).select("origin", "goal", "rank", "time", "distance", "transfers", F.array_join("path", " ").alias("path"))


@query("pareto_via", f"""WITH {ARCS}, {JOURNEYS}, {traded('SELECT o, v AS g FROM journey UNION SELECT v, g FROM journey')},
sums AS (SELECT rid, a.h + b.h AS h, a.km + b.km AS km, a.tr + b.tr AS tr, min(list_concat(a.path, b.path[2:])) AS path
  FROM journey j JOIN legs a ON a.o = j.o AND a.g = j.v JOIN legs b ON b.o = j.v AND b.g = j.g GROUP BY ALL),
best AS (SELECT * FROM sums x WHERE NOT EXISTS (SELECT 1 FROM sums y WHERE y.rid = x.rid AND y.h <= x.h AND y.km <= x.km AND y.tr <= x.tr
  AND (y.h < x.h OR y.km < x.km OR y.tr < x.tr)))
SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY h, km, tr)::INTEGER AS rank, {TRADED.format('')}, array_to_string(path, ' ') AS path
FROM best QUALIFY rank <= 3""")
def pareto_via(spark, sf):
    """Trade-off routes with a stop, from the Pareto legs."""
    req = region_requests(spark, sf).select("rid", "origin", F.col("goal").alias("via"), F.col("after").alias("goal"))
    legs = req.select("origin", F.col("via").alias("goal")).union(req.select("via", "goal")).distinct()
    found = R.pareto_routes(legs, roles.network_arcs(spark, sf))
    return _rounded(R.pareto_via(req, found)).select("rid", "rank", "time", "distance", "transfers", F.array_join("path", " ").alias("path"))


ASK = """ask AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS origin, ((s_suppkey + 1) % (SELECT count(*) FROM supplier))::VARCHAR AS goal FROM supplier)"""


@query("resolve_routes", f"""WITH {ARCS}, {ASK}, {relaxed('SELECT origin FROM ask')}
SELECT k, 'TRIP' AS intent, a.name AS departure, b.name AS destination, round(cost, 6) AS cost
FROM ask JOIN reach r ON r.origin = ask.origin AND r.node = goal JOIN node a ON a.uic = ask.origin JOIN node b ON b.uic = goal""")
def resolve_and_route(spark, sf):
    """One sentence per supplier, resolved and routed over the whole network."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    to = s.select(F.col("k").alias("to"), F.col("name").alias("other"))
    texts = s.join(n).withColumn("to", F.pmod(F.col("k") + 1, F.col("n"))).join(to, "to").select(
        "k", F.concat(F.lit("Je veux aller de "), "name", F.lit(" a "), "other").alias("text"))
    done = resolve_routes(texts, "k", roles.network_nodes(spark, sf), roles.network_arcs(spark, sf))
    return done.filter("error IS NULL").select("k", "intent", "departure", "destination", F.round("cost", 6).alias("cost"))
