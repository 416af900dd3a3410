"""Station gazetteer: merge, indexes, search and name resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railweave.functions import wordlists as W
from railweave.functions.text import extract_city_name, normalize_name, split_keys
from railweave.operators.scale import Stage, in_ranges, number_rows, padded, shuffled, top_per_group

#: Keys in one block of a posting list.
POSTING_BLOCK = 1000


def passenger_stations(source: DataFrame) -> DataFrame:
    """Passenger source (A1 schema + ``ord``) to one row per key; the last row of a key wins."""
    keyed = source.filter(F.coalesce("nom", F.lit("")) != "").select(
        F.explode(split_keys(F.coalesce("codes_uic", F.lit("")))).alias("uic"),
        "ord",
        F.struct(
            F.col("ord").alias("row_ord"),
            F.col("nom").alias("name"), F.col("libellecourt").alias("short_code"),
            split_keys("codes_uic").alias("uic_codes"),
            F.col("position_geographique.lat").alias("latitude"),
            F.col("position_geographique.lon").alias("longitude")).alias("row"))
    return keyed.groupBy("uic").agg(F.max_by("row", "ord").alias("p"), F.min("ord").alias("ord"))


def line_stations(source: DataFrame) -> DataFrame:
    """Station-line source (A2 schema + ``ord``) to one row per key.

    First named row gives name and place, first filled commune and department enrich,
    the last row decides the freight flag, line codes are united.
    """
    def filled(name: str) -> Column:
        value = F.struct("ord", F.col(name).alias("value"))
        return F.min(F.when(F.coalesce(F.col(name), F.lit("")) != "", value))

    place = F.struct(
        "ord", F.col("libelle").alias("name"),
        F.when(F.col("c_geo").isNotNull(), F.col("c_geo.lat")).otherwise(F.col("y_wgs84"))
        .alias("latitude"),
        F.when(F.col("c_geo").isNotNull(), F.col("c_geo.lon")).otherwise(F.col("x_wgs84"))
        .alias("longitude"),
        (F.coalesce("voyageurs", F.lit("N")) == "O").alias("is_passenger"))
    return source.filter(F.coalesce("code_uic", F.lit("")) != "").groupBy(
        F.col("code_uic").alias("uic")
    ).agg(
        F.min(F.when(F.coalesce("libelle", F.lit("")) != "", place)).alias("q"),
        filled("commune").alias("commune"),
        filled("departemen").alias("department"),
        F.max(F.struct("ord", (F.coalesce("fret", F.lit("N")) == "O").alias("value"))).alias("fret"),
        F.collect_set(F.nullif("code_ligne", F.lit(""))).alias("line_codes"),
        F.min("ord").alias("ord"),
    )


def merge_gazetteer(passenger: DataFrame, lines: DataFrame) -> DataFrame:
    """Passenger stations enriched by the line table; unmatched lines become stations.

    A passenger station is one object behind all of its keys, so what the line table
    says about one key counts for the others too.
    """
    joined = passenger_stations(passenger).alias("a").join(
        line_stations(lines).alias("b"), "uic", "full")
    known = F.col("p").isNotNull()
    merged = joined.filter(known | F.col("q").isNotNull()).select(
        "uic", "p", "q", "commune", "department", "fret", "line_codes",
        F.when(known, F.col("a.ord")).otherwise(F.col("b.ord")).alias("ord"),
        F.when(known, F.concat(F.lit("row "), F.col("p.row_ord").cast("string")))
        .otherwise(F.col("uic")).alias("owner"))
    same = Window.partitionBy("owner")
    codes = F.flatten(F.collect_list(F.coalesce("line_codes", F.array().cast("array<string>"))).over(same))
    known = F.col("p").isNotNull()
    return merged.select(
        "uic",
        F.coalesce("p.name", "q.name").alias("name"),
        normalize_name(F.coalesce("p.name", "q.name")).alias("name_norm"),
        F.coalesce("p.short_code", F.lit("")).alias("short_code"),
        F.coalesce("p.uic_codes", F.array("uic")).alias("uic_codes"),
        F.when(known, F.col("p.latitude")).otherwise(F.col("q.latitude")).alias("latitude"),
        F.when(known, F.col("p.longitude")).otherwise(F.col("q.longitude")).alias("longitude"),
        F.coalesce(F.min("commune").over(same)["value"], F.lit("")).alias("commune"),
        F.coalesce(F.min("department").over(same)["value"], F.lit("")).alias("department"),
        F.when(known, True).otherwise(F.col("q.is_passenger")).alias("is_passenger"),
        F.coalesce(F.max("fret").over(same)["value"], F.lit(False)).alias("is_freight"),
        F.sort_array(F.array_distinct(codes)).alias("line_codes"),
        # passenger stations come first, then the line table in its own order
        F.concat(F.when(known, "0").otherwise("1"), padded(F.col("ord"), 18),
                 F.lit(" "), "uic").alias("ord"),
    )


def station_key(uic_codes: Column, name_norm: Column) -> Column:
    """Identity of a station: its set of keys, else its normalised name."""
    return F.when(F.size(uic_codes) > 0, F.array_join(F.sort_array(uic_codes), ";")).otherwise(
        name_norm)


def only_passenger(stations: DataFrame, passenger_only: bool = True) -> DataFrame:
    """C3."""
    return stations.filter("is_passenger") if passenger_only else stations


def by_uic(stations: DataFrame, uics: DataFrame) -> DataFrame:
    """Point lookups, a batch at a time."""
    return uics.join(stations, "uic", "left")


def name_index(stations: DataFrame) -> DataFrame:
    """(key, uic, ord) for normalised names."""
    return stations.select(F.col("name_norm").alias("key"), "uic", "ord")


def city_index(stations: DataFrame) -> DataFrame:
    """City names (only where they differ from the station name) and communes."""
    city = normalize_name(extract_city_name(F.col("name")))
    commune = normalize_name(F.col("commune"))
    keys = F.filter(
        F.array(F.when((city != "") & (city != F.col("name_norm")), city),
                F.when(F.coalesce("commune", F.lit("")) != "", commune)),
        lambda k: k.isNotNull())
    return stations.select(F.explode(F.array_distinct(keys)).alias("key"), "uic", "ord")


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The curated aliases as a table (a fixed handful of rows)."""
    rows = [(name, alias) for name, many in (aliases or W.STATION_ALIASES).items()
            for alias in many]
    return spark.createDataFrame(rows, "name_norm string, alias string")


def alias_index(stations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Curated aliases of existing names."""
    return stations.join(aliases, "name_norm").select(
        normalize_name(F.col("alias")).alias("key"), "uic", "ord")


def with_aliases(stations: DataFrame, aliases: DataFrame) -> DataFrame:
    """The aliases as an array on each station."""
    grouped = aliases.groupBy("name_norm").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return stations.join(grouped, "name_norm", "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def inverted(index: DataFrame) -> DataFrame:
    """E20 in its nested form: key -> keys in file order."""
    pairs = F.sort_array(F.collect_set(F.struct("ord", "uic")))
    return index.groupBy("key").agg(F.transform(pairs, lambda p: p["uic"]).alias("uics"))


def numbered_blocks(rows: DataFrame, key: str, order: Sequence[str], block: int) -> DataFrame:
    """``rows`` with ``block``, ``rn`` (from 1) and ``n`` of their key, in the order of ``order``.

    Rows are numbered inside ranges of equal row counts, so a key with a third of all rows is many tasks.
    """
    first, *rest = order
    ranged = in_ranges(rows, key, first, rest)
    numbered = number_rows(ranged, [key], [F.col(c) for c in order], F.col("_range")).drop("_range")
    return numbered.withColumn("block", F.floor((F.col("rn") - 1) / block).cast("long"))


def postings(index: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """E20 in blocks: (key, block, n, uics); a city of any size is no single array.

    ``uics`` are the keys number ``block * size`` and following in file order, ``n`` is their number in
    the whole city.
    """
    numbered = numbered_blocks(index.distinct(), "key", ["ord", "uic"], block)
    part = F.sort_array(F.collect_list(F.struct("rn", "uic")))
    return numbered.groupBy("key", "block", "n").agg(F.transform(part, lambda p: p["uic"]).alias("uics"))


def first_word_index(stations: DataFrame) -> DataFrame:
    """First word -> number of names and the first name."""
    names = distinct_names(stations)
    return names.groupBy(F.substring_index("name_norm", " ", 1).alias("first_word")).agg(
        F.count(F.lit(1)).alias("n_names"), F.min_by("name_norm", "ord").alias("first_name"))


def distinct_names(stations: DataFrame) -> DataFrame:
    """A normalised name keeps its first position but shows the last original spelling."""
    return stations.groupBy("name_norm").agg(
        F.max_by("name", "ord").alias("name"), F.min("ord").alias("ord"))


def gazetteer_stats(stations: DataFrame, aliases: DataFrame) -> DataFrame:
    """E5."""
    base = stations.agg(
        F.count(F.lit(1)).alias("total_stations"),
        F.count_if("is_passenger").alias("passenger_stations"),
        F.count_if("is_freight").alias("freight_stations"))
    names = stations.select("name_norm").distinct().agg(F.count(F.lit(1)).alias("unique_names"))
    cities = city_index(stations).select("key").distinct().agg(F.count(F.lit(1)).alias("cities"))
    known = alias_index(stations, aliases).select("key").distinct().agg(
        F.count(F.lit(1)).alias("aliases"))
    # four one-row tables side by side
    return base.join(names).join(cities).join(known)


#: Length of the substrings by which needles meet hays; a shorter needle is met by itself.
PIECE = 8


def pieces(text: Column, size: Column) -> Column:
    """Distinct substrings of length ``size``, which is at most the length of the text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1),
                                        lambda i: F.substring(text, i, size)))


def containment_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Exact 'hay contains needle' join through the needle's rarest substring.

    ``needles(needle)`` and ``hays(hay)`` hold distinct strings.  If the hay holds the
    needle it holds each of its substrings, so one of them suffices as equi-join key,
    and the rarest one keeps the candidates few.  Keys are as long as ``PIECE``, so that a pattern that many
    names share, such as three digits of a number, is no key of its own.  Blank needles match nothing.
    """
    size = F.least(F.length("needle"), F.lit(PIECE))
    asked = needles.filter(F.length("needle") > 0)
    sizes = asked.agg(F.collect_set(size).alias("_sizes"))
    fitting = F.filter("_sizes", lambda n: n <= F.length("hay"))
    hay_grams = hays.join(sizes).select("hay", F.explode(fitting).alias("_size")).select(
        "hay", F.explode(pieces(F.col("hay"), F.col("_size"))).alias("gram"))
    frequency = hay_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    needle_grams = asked.select("needle", F.explode(pieces(F.col("needle"), size)).alias("gram"))
    # a substring that no hay holds rules the needle out at once
    rarest = needle_grams.join(shuffled(frequency), "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.coalesce("_df", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(shuffled(hay_grams), "gram").filter(F.contains("hay", "needle")).select(
        "needle", "hay")


def first_holders(needles: DataFrame, names: DataFrame, order: Sequence[str], limit: int,
                  tiers: bool = True) -> DataFrame:
    """The first ``limit`` rows of ``names(hay, ...)`` that hold each needle, exactly.

    Adds ``needle``, ``tier`` (0: the name is the needle, 1: starts with it, 2: holds it) and ``rank``;
    rows come by tier (unless ``tiers`` is off), then by the columns ``order``.  Every piece of a name that has the length of some
    needle gets a list of its first names, cut before the shuffle, and a needle meets only its own list:
    a piece that all names share costs ``limit`` rows per input task and no pair beyond the list is
    built.  Blank needles and names match nothing.
    """
    asked = needles.select("needle").filter(F.length("needle") > 0).distinct()
    sizes = asked.agg(F.collect_set(F.length("needle")).alias("_sizes"))
    long = F.length("hay")
    pieces = names.join(sizes).select(*names.columns, F.explode(
        F.filter("_sizes", lambda n: n <= long)).alias("_size"))
    pieces = pieces.select(*pieces.columns, F.explode(F.sequence(F.lit(1), long - F.col("_size") + 1)).alias("_at"))
    pieces = pieces.withColumn("needle", F.substring("hay", F.col("_at"), F.col("_size"))).filter(
        # a piece that occurs twice in a name counts at its first place
        F.call_function("locate", F.col("needle"), F.col("hay")) == F.col("_at"))
    tier = F.when(F.col("_size") == long, 0).when(F.col("_at") == 1, 1).otherwise(2)
    lists = top_per_group(pieces.withColumn("tier", tier).drop("_size", "_at"), ["needle"],
                          [F.col(c) for c in (["tier"] if tiers else []) + list(order)], limit)
    return lists.join(shuffled(asked), "needle", "left_semi")


def search_cascade(queries: DataFrame, stations: DataFrame, aliases: DataFrame,
                   exact: bool = False, limit: int | None = None) -> DataFrame:
    """(query, uic, tier, ord): exact, then alias, then city; substring only if none hit.

    With ``limit``, the first hits of each query only: every index is cut to its first rows per key
    before it meets a query.
    """
    stage = Stage(queries.sparkSession, "search")
    # every step reads the queries and what they hit so far: both are worked out once
    keyed = shuffled(stage.save(queries.select("query").distinct().withColumn("key", normalize_name(F.col("query")))))
    names = name_index(stations)
    tiers = [names]
    if not exact:
        tiers += [alias_index(stations, shuffled(aliases)).distinct(), city_index(stations)]
    if limit is not None:
        tiers = [top_per_group(t, ["key"], [F.col("ord"), F.col("uic")], limit).drop("rank") for t in tiers]
    hits = None
    for tier, index in enumerate(tiers):
        found = keyed.join(index, "key").select("query", "uic", F.lit(tier).alias("tier"), "ord")
        hits = found if hits is None else hits.unionByName(found)
    if not exact:
        hits = stage.save(hits)
        rest = shuffled(stage.save(keyed.join(hits.select("query").distinct(), "query", "left_anti").withColumnRenamed("key", "ask")))
        ask, have = rest.select("ask").distinct(), names.select("key").distinct()
        held = containment_pairs(have.select(F.col("key").alias("needle")), ask.select(F.col("ask").alias("hay"))
                                 ).select(F.col("hay").alias("ask"), F.col("needle").alias("key"))
        needles = ask.select(F.col("ask").alias("needle"))
        if limit is None:
            holding = containment_pairs(needles, have.select(F.col("key").alias("hay"))).select(
                F.col("needle").alias("ask"), F.col("hay").alias("key"))
            found = held.unionByName(holding).distinct().join(shuffled(names), "key").select("ask", "uic", "ord")
        else:
            # here a name that starts with the query is no better than one that holds it
            holding = first_holders(needles, names.withColumnRenamed("key", "hay"), ["ord", "uic"], limit, tiers=False)
            found = held.join(shuffled(tiers[0]), "key").select("ask", "uic", "ord").unionByName(
                holding.select(F.col("needle").alias("ask"), "uic", "ord"))
        hits = hits.unionByName(rest.join(found, "ask").select("query", "uic", F.lit(3).alias("tier"), "ord"))
    hits = hits.groupBy("query", "uic").agg(F.min("tier").alias("tier"), F.min("ord").alias("ord"))
    return hits if limit is None else top_per_group(
        hits, ["query"], [F.col("tier"), F.col("ord"), F.col("uic")], limit).drop("rank")


def first_hit(hits: DataFrame, stations: DataFrame) -> DataFrame:
    """The first result of each query, as (query, uic, name)."""
    best = hits.groupBy("query").agg(F.min(F.struct("tier", "ord", "uic")).alias("b"))
    return best.select("query", F.col("b.uic").alias("uic"), F.col("b.tier").alias("tier")).join(
        shuffled(stations.select("uic", "name")), "uic")


def stations_of_city(cities: DataFrame, stations: DataFrame) -> DataFrame:
    """City index, then name index, each station once."""
    keyed = cities.select("query").distinct().withColumn("key", normalize_name(F.col("query")))
    both = city_index(stations).withColumn("tier", F.lit(0)).unionByName(
        name_index(stations).withColumn("tier", F.lit(1)))
    return keyed.join(both, "key").groupBy("query", "uic").agg(F.min("tier").alias("tier"),
                                                              F.min("ord").alias("ord"))


def name_matches(queries: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes(uic, name, ord) whose name equals, starts with or holds the query."""
    asked = queries.select("query").distinct().withColumn("needle", F.trim(F.lower("query")))
    named = nodes.select("uic", "name", "ord", F.lower("name").alias("hay"))
    return asked.join(first_holders(asked, named, ["ord", "uic"], limit), "needle").select(
        "query", "uic", "name", "ord", "tier", "rank")


def resolve_names(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, uic, tier): exact, else prefix, else contains; first in file order."""
    return name_matches(queries, nodes, 1).select("query", "uic", "tier")


def typeahead(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` matches of each query, tier by tier."""
    return name_matches(queries, nodes, limit)


def union_of_names(*sources: DataFrame) -> DataFrame:
    """H1: distinct trimmed names of several one-column sources, sorted."""
    merged = None
    for source in sources:
        names = source.select(F.trim(F.col(source.columns[0])).alias("name"))
        merged = names if merged is None else merged.unionByName(names)
    return merged.filter(F.coalesce("name", F.lit("")) != "").distinct().orderBy("name")
