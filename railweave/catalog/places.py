"""Queries of the gazetteer and linking jobs (sections A16, C3, D1, D5-D15, E5, E20, E21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave.catalog import query, table
from railweave.catalog import sql as S
from railweave.functions.text import normalize_name
from railweave.operators import gazetteer as G
from railweave.operators import linking as L
from railweave.operators.scale import Stage, padded
from railweave.plans import roles
from railweave.plans.resolve import search_linker
from railweave.sources.writers import city_blocks, city_mapping, station_list


def line_source(spark, sf):
    """Line items as stops, plus customers as freight-only stops."""
    c = table(spark, sf, "customer")
    text = lambda name: F.col(name).cast("string")
    none = F.lit(None).cast("double")
    extra = c.select(
        F.concat(F.lit("C"), text("c_custkey")).alias("code_uic"), F.col("c_name").alias("libelle"),
        F.lit("O").alias("fret"), F.lit("N").alias("voyageurs"), text("c_nationkey").alias("code_ligne"),
        F.col("c_mktsegment").alias("commune"), F.lit("").alias("departemen"),
        none.alias("x_wgs84"), none.alias("y_wgs84"),
        F.struct(F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat")).alias("c_geo"),
        F.lit("").alias("pk"), padded(text("c_custkey"), 12).alias("ord"))
    return roles.line_rows(spark, sf).unionByName(extra)


def stations(spark, sf):
    """D1 over suppliers, line items and customers, stored once as the searches read it often."""
    return Stage(spark, "stations").save(
        G.merge_gazetteer(roles.station_rows(spark, sf), line_source(spark, sf)))


STATIONS = f"""
src AS (SELECT l_suppkey::VARCHAR AS uic, CASE WHEN l_returnflag = 'A' THEN 'O' ELSE 'N' END AS fret, l_orderkey::VARCHAR AS line,
  'Commune ' || (l_suppkey % 17) AS commune, 'Dept ' || (l_suppkey % 5) AS dept,
  lpad(l_orderkey::VARCHAR, greatest(12, length(l_orderkey::VARCHAR))::INT, '0') || ' ' || l_linenumber || ' ' || lpad(l_partkey::VARCHAR, greatest(12, length(l_partkey::VARCHAR))::INT, '0') || ' ' || l_returnflag AS ord FROM lineitem
  UNION ALL SELECT 'C' || c_custkey, 'O', c_nationkey::VARCHAR, c_mktsegment, '', lpad(c_custkey::VARCHAR, greatest(12, length(c_custkey::VARCHAR))::INT, '0') FROM customer),
agg AS (SELECT uic, max_by(fret, ord) = 'O' AS is_freight, count(DISTINCT line) AS n_lines, min(commune) AS commune, min(dept) AS department FROM src GROUP BY 1),
st AS (SELECT coalesce(p.uic, a.uic) AS uic, coalesce(p.name, c.c_name) AS name, p.uic IS NOT NULL AS is_passenger,
  coalesce(is_freight, false) AS is_freight, coalesce(n_lines, 0) AS n_lines, coalesce(commune, '') AS commune, coalesce(department, '') AS department,
  coalesce(p.lat, 48.0)::DOUBLE AS latitude, CASE WHEN p.uic IS NOT NULL THEN 0 ELSE 1 END AS src, coalesce(p.k, c.c_custkey) AS k
  FROM (SELECT s_suppkey::VARCHAR AS uic, s_name AS name, s_suppkey AS k, 42 + (s_suppkey * 37 % 900) / 100.0 AS lat FROM supplier) p
  FULL JOIN agg a ON p.uic = a.uic LEFT JOIN customer c ON a.uic = 'C' || c.c_custkey),
stn AS (SELECT *, {S.normalize_name('name')} AS name_norm, {S.normalize_name('commune')} AS commune_norm,
  {S.normalize_name(S.city_name('name'))} AS city_norm FROM st),
alias AS (SELECT {S.normalize_name('s_name')} AS name_norm, n_name AS alias, {S.normalize_name('n_name')} AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey),
city AS (SELECT DISTINCT uic, key, src, k FROM (SELECT uic, city_norm AS key, src, k FROM stn WHERE city_norm <> '' AND city_norm <> name_norm
  UNION ALL SELECT uic, commune_norm, src, k FROM stn WHERE commune <> ''))"""


@query("gazetteer_merge", f"""WITH {STATIONS}
SELECT uic, name, name_norm, is_passenger, is_freight, n_lines, commune, department, round(latitude, 6) AS latitude FROM stn""")
def gazetteer_merge(spark, sf):
    """D1, A1, A2, B1."""
    return stations(spark, sf).select(
        "uic", "name", "name_norm", "is_passenger", "is_freight", F.size("line_codes").alias("n_lines"),
        "commune", "department", F.round("latitude", 6).alias("latitude"))


def nation_aliases(spark, sf):
    """Aliases from the data: a supplier is also known by its nation."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        normalize_name(F.col("s_name")).alias("name_norm"), F.col("n_name").alias("alias"))


@query("gazetteer_stats", f"""WITH {STATIONS}
SELECT count(*) AS total_stations, count(*) FILTER (is_passenger) AS passenger_stations, count(*) FILTER (is_freight) AS freight_stations,
  count(DISTINCT name_norm) AS unique_names, (SELECT count(DISTINCT key) FROM city) AS cities, (SELECT count(DISTINCT key) FROM alias) AS aliases FROM stn""")
def gazetteer_stats(spark, sf):
    """E5."""
    return G.gazetteer_stats(stations(spark, sf), nation_aliases(spark, sf))


@query("passenger_only", f"WITH {STATIONS} SELECT uic, name FROM stn WHERE is_passenger")
def passenger_only(spark, sf):
    """C3."""
    return G.only_passenger(stations(spark, sf)).select("uic", "name")


@query("station_listing", f"""WITH {STATIONS} SELECT uic, name FROM stn ORDER BY src, k LIMIT 20""")
def station_listing(spark, sf):
    """The first stations (a listing)."""
    return stations(spark, sf).orderBy("ord").limit(20).select("uic", "name")


@query("city_indexes", f"WITH {STATIONS} SELECT key, count(*) AS n, string_agg(uic, ' ' ORDER BY src, k) AS uics FROM city GROUP BY key")
def city_indexes(spark, sf):
    """Nested city index in file order."""
    return G.inverted(G.city_index(stations(spark, sf))).select(
        "key", F.size("uics").alias("n"), F.array_join("uics", " ").alias("uics"))


@query("city_postings", f"""WITH {STATIONS}, p AS (SELECT key, uic, src, k, row_number() OVER w AS rn, count(*) OVER (PARTITION BY key) AS n
  FROM city WINDOW w AS (PARTITION BY key ORDER BY src, k))
SELECT key, (rn - 1) // 100 AS block, n, string_agg(uic, ' ' ORDER BY rn) AS uics FROM p GROUP BY 1, 2, 3""")
def city_postings(spark, sf):
    """The city index in blocks of a hundred keys."""
    return G.postings(G.city_index(stations(spark, sf)), 100).withColumn("uics", F.array_join("uics", " "))


@query("alias_bridge", f"WITH {STATIONS} SELECT a.key, s.uic FROM alias a JOIN stn s USING (name_norm)")
def alias_bridge(spark, sf):
    """D5."""
    return G.alias_index(stations(spark, sf), nation_aliases(spark, sf)).select("key", "uic")


ASKED = """asked AS (SELECT DISTINCT q FROM (SELECT s_name AS q FROM supplier UNION ALL SELECT n_name FROM nation
  UNION ALL SELECT 'Commune ' || (s_suppkey % 17) FROM supplier UNION ALL SELECT right(s_name, 4) FROM supplier
  UNION ALL SELECT s_name || ' Gare' FROM supplier UNION ALL SELECT 'nowhere ' || c_custkey FROM customer))"""


def asked(spark, sf):
    s, n, c = (table(spark, sf, t) for t in ("supplier", "nation", "customer"))
    k = F.col("s_suppkey")
    each = [s.select("s_name"), n.select("n_name"),
            s.select(F.concat(F.lit("Commune "), F.pmod(k, F.lit(17)).cast("string"))),
            s.select(F.right("s_name", F.lit(4))), s.select(F.concat("s_name", F.lit(" Gare"))),
            c.select(F.concat(F.lit("nowhere "), F.col("c_custkey").cast("string")))]
    merged = each[0].toDF("query")
    for part in each[1:]:
        merged = merged.union(part.toDF("query"))
    return merged.distinct()


HITS = f"""{STATIONS}, {ASKED}, qk AS (SELECT q, {S.normalize_name('q')} AS key FROM asked),
h0 AS (SELECT q, uic, 0 AS tier, src, k FROM qk JOIN stn ON key = name_norm UNION ALL
  SELECT q, s.uic, 1, s.src, s.k FROM qk JOIN alias a USING (key) JOIN stn s USING (name_norm) UNION ALL
  SELECT q, uic, 2, src, k FROM qk JOIN city USING (key)),
h1 AS (SELECT q, uic, 3 AS tier, src, k FROM qk, stn WHERE q NOT IN (SELECT q FROM h0) AND (contains(name_norm, key) OR contains(key, name_norm))),
hits AS (SELECT q, uic, min(tier) AS tier, min(src) AS src, min(k) AS k FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1) GROUP BY 1, 2)"""


@query("search_cascade", f"WITH {HITS} SELECT q AS query, uic, tier::BIGINT AS tier FROM hits")
def search_cascade(spark, sf):
    """Exact, alias and city hits, else substrings either way."""
    st = stations(spark, sf)
    return G.search_cascade(asked(spark, sf), st, nation_aliases(spark, sf)).select("query", "uic", "tier")


@query("search_first", f"""WITH {HITS} SELECT q AS query, uic, name FROM (
  SELECT q, uic, row_number() OVER (PARTITION BY q ORDER BY tier, src, k) AS r FROM hits) JOIN stn USING (uic) WHERE r = 1""")
def search_first(spark, sf):
    """First result of each query."""
    st = stations(spark, sf)
    hits = G.search_cascade(asked(spark, sf), st, nation_aliases(spark, sf), limit=1)
    return G.first_hit(hits, st).select("query", "uic", "name")


@query("station_by_key", f"WITH {STATIONS} SELECT l.uic, name FROM (SELECT DISTINCT l_suppkey::VARCHAR AS uic FROM lineitem "
       "UNION SELECT 'X' || n_nationkey FROM nation) l LEFT JOIN stn USING (uic)")
def station_by_key(spark, sf):
    """Point lookups in bulk."""
    keys = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("uic")).distinct().union(
        table(spark, sf, "nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string"))))
    return G.by_uic(stations(spark, sf), keys).select("uic", "name")


CITY = f"""{STATIONS}, cq AS (SELECT DISTINCT commune AS q FROM stn WHERE commune <> ''),
ck AS (SELECT q, {S.normalize_name('q')} AS key FROM cq),
ch AS (SELECT q, uic, min(tier) AS tier, min(src) AS src, min(k) AS k FROM (SELECT q, uic, 0 AS tier, src, k FROM ck JOIN city USING (key)
  UNION ALL SELECT q, uic, 1, src, k FROM ck JOIN stn ON key = name_norm) GROUP BY 1, 2)"""


@query("city_stations", f"WITH {CITY} SELECT q AS query, uic, tier::BIGINT AS tier FROM ch")
def city_stations(spark, sf):
    """D8."""
    st = stations(spark, sf)
    return G.stations_of_city(st.filter("commune <> ''").select(F.col("commune").alias("query")), st).select(
        "query", "uic", "tier")


@query("city_export", f"WITH {CITY} SELECT q AS city, string_agg(name, '|' ORDER BY tier, ch.src, ch.k) AS stations FROM ch JOIN stn USING (uic) GROUP BY 1")
def city_export(spark, sf):
    """City -> station names."""
    st = stations(spark, sf)
    found = G.stations_of_city(st.filter("commune <> ''").select(F.col("commune").alias("query")), st)
    return city_mapping(found.join(st.select("uic", "name"), "uic")).select(
        "city", F.array_join("stations", "|").alias("stations"))


@query("city_export_blocks", f"""WITH {CITY}, p AS (SELECT q, name, row_number() OVER w AS rn, count(*) OVER (PARTITION BY q) AS n
  FROM ch JOIN stn USING (uic) WINDOW w AS (PARTITION BY q ORDER BY tier, ch.src, ch.k))
SELECT q AS city, (rn - 1) // 100 AS block, n, string_agg(name, '|' ORDER BY rn) AS stations FROM p GROUP BY 1, 2, 3""")
def city_export_blocks(spark, sf):
    """City -> station names in blocks of a hundred."""
    st = stations(spark, sf)
    found = G.stations_of_city(st.filter("commune <> ''").select(F.col("commune").alias("query")), st)
    return city_blocks(found.join(st.select("uic", "name"), "uic"), 100).withColumn(
        "stations", F.array_join("stations", "|"))


@query("station_export", f"""WITH {STATIONS}, al AS (SELECT name_norm, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM alias GROUP BY 1)
SELECT name, name_norm AS normalized, lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, 'S') AS short_code, commune, coalesce(aliases, '') AS aliases
FROM stn LEFT JOIN al USING (name_norm) WHERE is_passenger""")
def station_export(spark, sf):
    """Passenger stations with aliases."""
    st = G.with_aliases(stations(spark, sf), nation_aliases(spark, sf))
    return station_list(st).withColumn("aliases", F.array_join("aliases", "|"))


NODE_QUERIES = """nq AS (SELECT DISTINCT q FROM (SELECT lower(s_name) AS q FROM supplier UNION ALL SELECT left(s_name, 17) FROM supplier
  UNION ALL SELECT right(s_name, 3) FROM supplier UNION ALL SELECT n_name FROM nation)),
nm AS (SELECT q, s_suppkey AS uic, CASE WHEN lower(s_name) = trim(lower(q)) THEN 0 WHEN starts_with(lower(s_name), trim(lower(q))) THEN 1 ELSE 2 END AS tier
  FROM nq JOIN supplier ON contains(lower(s_name), trim(lower(q)))),
nr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, uic) AS r FROM nm)"""


def node_queries(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.select(F.lower("s_name").alias("query")).union(s.select(F.left("s_name", F.lit(17)))).union(
        s.select(F.right("s_name", F.lit(3)))).union(n.select("n_name")).distinct()


@query("resolve_names", f"WITH {NODE_QUERIES} SELECT q AS query, uic::VARCHAR AS uic, tier::BIGINT AS tier FROM nr WHERE r = 1")
def resolve_names(spark, sf):
    """D9."""
    return G.resolve_names(node_queries(spark, sf), roles.network_nodes(spark, sf))


@query("typeahead", f"WITH {NODE_QUERIES} SELECT q AS query, uic::VARCHAR AS uic, r AS rank FROM nr WHERE r <= 10")
def typeahead(spark, sf):
    """Up to ten suggestions per query."""
    return G.typeahead(node_queries(spark, sf), roles.network_nodes(spark, sf)).select("query", "uic", "rank")


@query("name_union", """SELECT DISTINCT trim(n) AS name FROM (SELECT p_name AS n FROM part UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation) WHERE n <> ''""")
def name_union(spark, sf):
    """H1."""
    return G.union_of_names(*[table(spark, sf, t).select(c) for t, c in (
        ("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name"))])


# --- linking: parts as stations, misspelt part names as queries ---------------------------

def part_stations(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("uic"), F.col("p_name").alias("name"),
        normalize_name(F.col("p_name")).alias("name_norm"), F.lit("").alias("commune"),
        padded(F.col("p_partkey"), 12).alias("ord"))


def misspelt(spark, sf):
    """Every part name without one of its letters."""
    at = (1 + F.col("p_partkey") % F.length("p_name")).cast("int")
    return table(spark, sf, "part").select(F.concat(
        F.substring("p_name", F.lit(1), at - 1),
        F.substring("p_name", at + 1, F.length("p_name"))).alias("query")).distinct()


MISSPELT = """nm AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1),
mq AS (SELECT DISTINCT left(p_name, (p_partkey % length(p_name))::INT) || substr(p_name, (p_partkey % length(p_name))::INT + 2) AS q FROM part)"""

# longest common subsequence, bit-parallel: one step per letter of the name
RATIO = f"""WITH RECURSIVE {MISSPELT},
step AS (SELECT q, name, ord, 0 AS i, ((1::BIGINT << length(q)) - 1)::BIGINT AS v FROM mq, nm
  UNION ALL
  SELECT q, name, ord, i + 1, (((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(q)) - 1))::BIGINT FROM (
    SELECT *, coalesce(list_sum(list_transform(range(1, length(q) + 1), lambda k: CASE WHEN q[k] = name[i + 1] THEN 1::BIGINT << (k - 1)::INT ELSE 0 END)), 0)::BIGINT AS m
    FROM step WHERE i < length(name))),
scored AS (SELECT q, name, ord, 200.0 * (length(q) - bit_count(v)) / (length(q) + length(name)) AS score FROM step WHERE i = length(name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord, name) AS r FROM scored)"""


@query("link_ratio", f"""{RATIO}
SELECT q AS query, CASE WHEN score >= 90 THEN name ELSE q END AS linked, CASE WHEN score >= 90 THEN round(score, 6)::DOUBLE END AS score FROM ranked WHERE r = 1""")
def link_ratio(spark, sf):
    """Best plain ratio above a cutoff, else the text itself."""
    names = part_stations(spark, sf).groupBy("name").agg(F.min("ord").alias("ord"))
    found = L.link_or_keep(misspelt(spark, sf), names, 90.0)
    return found.select("query", "linked", F.round("score", 6).alias("score"))


@query("link_topk", f"{RATIO} SELECT q AS query, name AS station, round(score, 6)::DOUBLE AS score, r AS rank FROM ranked WHERE r <= 3")
def link_topk(spark, sf):
    """D13 with the plain ratio: three candidates per query."""
    found = L.link_details(misspelt(spark, sf), part_stations(spark, sf), 3, "ratio")
    return found.select("query", "station", F.round("score", 6).alias("score"), "rank")


# --- weighted links: supplier stations, which grow with the tables ------------------------

def supplier_stations(spark, sf):
    """One station per supplier: the name and type of a part, and a number."""
    p = table(spark, sf, "part")
    s = table(spark, sf, "supplier").join(p, F.col("p_partkey") == F.col("s_suppkey"))
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("s_suppkey").cast("string"))
    return s.select(F.col("s_suppkey").cast("string").alias("uic"), name.alias("name"),
                    normalize_name(name).alias("name_norm"), F.lit("").alias("commune"), F.col("s_suppkey").alias("ord"))


def garbled(spark, sf):
    """Every supplier station without one letter, its middle word with the number, and its last two words in turn."""
    st = supplier_stations(spark, sf)
    at = (1 + F.col("ord") % F.length("name")).cast("int")
    parts = F.split("name", " ")
    cut = F.concat(F.substring("name", F.lit(1), at - 1), F.substring("name", at + 1, F.length("name")))
    short = F.concat_ws(" ", F.element_at(parts, -2), F.element_at(parts, -1))
    turned = F.concat_ws(" ", F.element_at(parts, 2), F.element_at(parts, 1))
    return st.select(F.explode(F.array(cut, short, turned)).alias("query")).distinct()


GARBLED = """nm AS (SELECT p_name || ' ' || lower(p_type) || ' ' || s_suppkey AS name, s_suppkey AS ord FROM supplier JOIN part ON p_partkey = s_suppkey),
mq AS (SELECT DISTINCT trim(regexp_replace(unnest([left(name, (ord % length(name))::INT) || substr(name, (ord % length(name))::INT + 2),
    string_split(name, ' ')[-2] || ' ' || string_split(name, ' ')[-1], string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1]]), ' +', ' ', 'g')) AS q FROM nm)"""

# Every string pair whose longest common subsequence some ratio needs, counted once; bit-parallel as above.
WEIGHTED = f"""WITH RECURSIVE {GARBLED},
forms AS (SELECT s, array_to_string(list_sort(w), ' ') AS sorted, list_sort(list_distinct(w)) AS t
  FROM (SELECT s, string_split(s, ' ') AS w FROM (SELECT q AS s FROM mq UNION SELECT name FROM nm))),
pair AS (SELECT q, name, ord, a.sorted AS sa, b.sorted AS sb, greatest(length(q), length(name)) / least(length(q), length(name)) AS stretch,
    array_to_string(list_filter(a.t, lambda x: list_contains(b.t, x)), ' ') AS mutual,
    array_to_string(list_filter(a.t, lambda x: NOT list_contains(b.t, x)), ' ') AS oa,
    array_to_string(list_filter(b.t, lambda x: NOT list_contains(a.t, x)), ' ') AS ob
  FROM mq, nm, forms a, forms b WHERE a.s = q AND b.s = name),
joint AS (SELECT *, trim(mutual || ' ' || oa) AS ja, trim(mutual || ' ' || ob) AS jb FROM pair),
whole AS (SELECT q AS x, name AS y FROM joint UNION SELECT sa, sb FROM joint WHERE stretch < 1.5
  UNION SELECT ja, jb FROM joint WHERE stretch < 1.5 UNION SELECT mutual, ja FROM joint WHERE stretch < 1.5 AND mutual <> ''
  UNION SELECT mutual, jb FROM joint WHERE stretch < 1.5 AND mutual <> ''),
part_of AS (SELECT DISTINCT x, y FROM (SELECT q AS x, name AS y FROM joint WHERE stretch >= 1.5 UNION SELECT sa, sb FROM joint WHERE stretch >= 1.5 AND mutual = ''
  UNION SELECT oa, ob FROM joint WHERE stretch >= 1.5 AND mutual = '')),
sides AS (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS short, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS long FROM part_of),
turns AS (SELECT x, y, short, long FROM sides UNION SELECT x, y, long, short FROM sides WHERE length(x) = length(y)),
slid AS (SELECT DISTINCT x, y, short, long[greatest(i, 0) + 1:i + length(short)] AS w
  FROM (SELECT *, unnest(range(1 - length(short), length(long))) AS i FROM turns)),
asked AS (SELECT x, y FROM whole UNION SELECT short, w FROM slid),
step AS (SELECT x, y, 0 AS i, ((1::BIGINT << length(x)) - 1)::BIGINT AS v FROM asked
  UNION ALL
  SELECT x, y, i + 1, (((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(x)) - 1))::BIGINT FROM (
    SELECT *, coalesce(list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN x[k] = y[i + 1] THEN 1::BIGINT << (k - 1)::INT ELSE 0 END)), 0)::BIGINT AS m
    FROM step WHERE i < length(y))),
ratio AS (SELECT x, y, 200::DOUBLE * (length(x) - bit_count(v)) / greatest(length(x) + length(y), 1) AS r FROM step WHERE i = length(y)),
partial AS (SELECT s.x, s.y, max(r.r) AS r FROM slid s JOIN ratio r ON r.x = s.short AND r.y = s.w GROUP BY ALL),
scored AS (SELECT j.q, j.name, j.ord, CASE WHEN stretch < 1.5 THEN greatest(p.r, 0.95::DOUBLE *
      CASE WHEN mutual <> '' AND (oa = '' OR ob = '') THEN 100 ELSE greatest(s.r, t.r, coalesce(u.r, 0), coalesce(v.r, 0)) END)
    ELSE greatest(p.r, e.r * scale, CASE WHEN mutual <> '' THEN 100::DOUBLE ELSE greatest(f.r, g.r) END * 0.95::DOUBLE * scale) END AS score
  FROM (SELECT *, CASE WHEN stretch <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale FROM joint) j
  JOIN ratio p ON p.x = j.q AND p.y = j.name LEFT JOIN ratio s ON s.x = sa AND s.y = sb LEFT JOIN ratio t ON t.x = ja AND t.y = jb
  LEFT JOIN ratio u ON u.x = mutual AND u.y = ja LEFT JOIN ratio v ON v.x = mutual AND v.y = jb
  LEFT JOIN partial e ON e.x = j.q AND e.y = j.name LEFT JOIN partial f ON f.x = sa AND f.y = sb LEFT JOIN partial g ON g.x = oa AND g.y = ob),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord, name) AS r FROM scored)"""

LINKED = """head AS (SELECT string_split(name, ' ')[1] AS w, min_by(name, ord) AS name, min(ord) AS ord FROM nm GROUP BY 1),
word_pair AS (SELECT q, w, name, ord FROM mq, head),
word_step AS (SELECT q, w, 0 AS i, ((1::BIGINT << length(q)) - 1)::BIGINT AS v FROM word_pair
  UNION ALL
  SELECT q, w, i + 1, (((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(q)) - 1))::BIGINT FROM (
    SELECT *, coalesce(list_sum(list_transform(range(1, length(q) + 1), lambda k: CASE WHEN q[k] = w[i + 1] THEN 1::BIGINT << (k - 1)::INT ELSE 0 END)), 0)::BIGINT AS m
    FROM word_step WHERE i < length(w))),
word_score AS (SELECT q, w, 200::DOUBLE * (length(q) - bit_count(v)) / (length(q) + length(w)) AS r FROM word_step WHERE i = length(w)),
word_rank AS (SELECT q, name, least(100, word_score.r + 20) AS score, row_number() OVER (PARTITION BY q ORDER BY word_score.r DESC, ord, w) AS place
  FROM word_score JOIN word_pair USING (q, w) QUALIFY place <= 10),
both_ways AS (SELECT q, name, max(score) AS score, min(place) AS place FROM (SELECT * FROM word_rank UNION ALL SELECT q, name, score, r + 10 FROM ranked WHERE r <= 10) GROUP BY ALL),
best AS (SELECT q, name, score FROM both_ways QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, place) = 1),
starts AS (SELECT q, min_by(name, ord) AS name FROM mq JOIN nm ON starts_with(name, q || ' ') GROUP BY q),
linked AS (SELECT q, name, 95::DOUBLE AS score FROM starts UNION ALL SELECT q, name, score FROM best WHERE score >= 80 AND q NOT IN (SELECT q FROM starts))"""


@query("link_best", f"{WEIGHTED}, {LINKED} SELECT q AS query, name, round(score, 6) AS score FROM linked")
def link_best(spark, sf):
    """Prefix link, else the best of first words and weighted scores, by candidates."""
    asked = garbled(spark, sf).select(F.trim(F.regexp_replace("query", " +", " ")).alias("query")).distinct()
    return L.link_names(asked, supplier_stations(spark, sf)).select("query", "name", F.round("score", 6).alias("score"))


@query("link_details_weighted", f"{WEIGHTED} SELECT q AS query, name AS station, round(score, 6) AS score, r AS rank FROM ranked WHERE r <= 5")
def link_details_weighted(spark, sf):
    """D13 with the weighted ratio: five candidates per query."""
    asked = garbled(spark, sf).select(F.trim(F.regexp_replace("query", " +", " ")).alias("query")).distinct()
    found = L.link_details(asked, supplier_stations(spark, sf), 5)
    return found.select("query", "station", F.round("score", 6).alias("score"), "rank")


@query("link_slots_fuzzy", f"""{WEIGHTED}, {LINKED},
rows AS (SELECT s_suppkey AS id, n.name AS full_name FROM supplier JOIN nm n ON n.ord = s_suppkey),
slot AS (SELECT id, trim(regexp_replace(left(full_name, (id % length(full_name))::INT) || substr(full_name, (id % length(full_name))::INT + 2), ' +', ' ', 'g')) AS d,
  string_split(full_name, ' ')[-2] || ' ' || string_split(full_name, ' ')[-1] AS t, string_split(full_name, ' ')[2] || ' ' || string_split(full_name, ' ')[1] AS v FROM rows)
SELECT id, coalesce(a.name, d) AS departure, coalesce(b.name, t) AS destination, coalesce(c.name, v) || '|zzqqzz' AS stops
FROM slot LEFT JOIN linked a ON a.q = d LEFT JOIN linked b ON b.q = t LEFT JOIN linked c ON c.q = v""")
def link_slots_fuzzy(spark, sf):
    """D15 by the fuzzy scores: three slots, one link over their distinct values, raw text where nothing links."""
    st = supplier_stations(spark, sf)
    at = (1 + F.col("ord") % F.length("name")).cast("int")
    parts = F.split("name", " ")
    cut = F.concat(F.substring("name", F.lit(1), at - 1), F.substring("name", at + 1, F.length("name")))
    rows = st.select(
        F.col("ord").alias("id"), F.trim(F.regexp_replace(cut, " +", " ")).alias("departure"),
        F.concat_ws(" ", F.element_at(parts, -2), F.element_at(parts, -1)).alias("destination"),
        F.array(F.concat_ws(" ", F.element_at(parts, 2), F.element_at(parts, 1)), F.lit("zzqqzz")).alias("intermediate"))
    return L.link_slots(rows, st, "id").select(
        "id", "departure", "destination", F.array_join("intermediate", "|").alias("stops"))


@query("prefix_link", """WITH nm AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1),
q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS q FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT q, min_by(name, ord) AS name_norm, 95.0::DOUBLE AS score FROM q JOIN nm ON starts_with(name, q || ' ') GROUP BY 1""")
def prefix_link(spark, sf):
    """D11."""
    p = table(spark, sf, "part")
    q = p.select(F.substring_index("p_name", " ", 1).alias("q")).union(p.select("p_brand")).distinct()
    return L.prefix_link(q, G.distinct_names(part_stations(spark, sf))).select("q", "name_norm", "score")


@query("first_words", """WITH nm AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1)
SELECT string_split(name, ' ')[1] AS first_word, count(*) AS n_names, min_by(name, ord) AS first_name FROM nm GROUP BY 1""")
def first_words(spark, sf):
    """E21."""
    return G.first_word_index(part_stations(spark, sf))


@query("link_slots", f"""WITH {S.sample_ctes()}, rows AS (SELECT sentence_id, upper(departure) AS d, destination || ' ?' AS t, '' AS via, intermediate FROM samples WHERE intent = 'TRIP')
SELECT sentence_id, lower(d) AS departure, regexp_replace(t, ' \\?$', '') AS destination, intermediate AS stops FROM rows""")
def link_slots(spark, sf):
    """D15 with the search cascade (J11): three slots, one link over distinct values."""
    st = part_stations(spark, sf)
    none = spark.createDataFrame([], "name_norm string, alias string")
    rows = roles.samples(spark, sf).filter("intent = 'TRIP'").select(
        "sentence_id", F.upper("departure").alias("departure"),
        F.concat("destination", F.lit(" ?")).alias("destination"),
        F.filter(F.array("intermediate"), lambda v: v != "").alias("intermediate"))
    linked = L.link_slots(rows, st, "sentence_id", linker=search_linker(st, none))
    return linked.select("sentence_id", "departure", "destination",
                         F.array_join("intermediate", "|").alias("stops"))
