"""Rail network tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions import wordlists as W
from railweave.functions.geo import (
    SPEED_DEFAULT, SPEED_HIGH, SPEED_WALK, distance_km, earth_cell, parse_post,
)
from railweave.operators.scale import Stage, in_ranges, with_neighbour

TRANSFER_KM = 8.0


def build_nodes(stations: DataFrame) -> DataFrame:
    """Stations with key, name and both coordinates; (uic, name, lat, lon, ord).

    A station of several keys gives one node per key, so each of them meets the line table.
    """
    return stations.filter(
        (F.coalesce("uic", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
        & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ).select("uic", "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "ord")


def line_attributes(lines: DataFrame) -> DataFrame:
    """Code -> high-speed flag and geometry (latitude first)."""
    label = F.upper(F.coalesce("lib_ligne", F.lit("")))
    fast = F.contains(label, F.lit("LGV")) | F.contains(label, F.lit("VITESSE"))
    return lines.groupBy(F.col("code_ligne").alias("line")).agg(
        F.max(fast).alias("is_high_speed"),
        F.max_by(flip_geometry(F.col("geo_shape.geometry.coordinates")),
                 F.when(F.size("geo_shape.geometry.coordinates") > 0, F.col("ord")))
        .alias("geometry"))


def flip_geometry(coordinates: Column) -> Column:
    """A3: lon/lat pairs to lat/lon pairs."""
    return F.transform(coordinates, lambda c: F.array(c[1], c[0]))


def line_stops(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """Passenger rows of known stations with a line and a readable post; (line, uic, pk)."""
    return source.filter(
        (F.col("voyageurs") == "O") & (F.coalesce("code_ligne", F.lit("")) != "")
    ).select(F.col("code_ligne").alias("line"), F.col("code_uic").alias("uic"),
             parse_post(F.col("pk")).alias("pk")
             ).filter(F.col("pk").isNotNull()).join(nodes.select("uic"), "uic", "left_semi")


def consecutive_stops(stops: DataFrame, ranges: int | None = None) -> DataFrame:
    """F2 then F1: neighbours along each line once repeated stops are collapsed.

    Equal rows lie side by side in the order (pk, uic), so they are dropped first, with
    map-side aggregation.
    """
    ordered = in_ranges(stops.select("line", "uic", "pk").distinct(), "line", "pk", ["uic"], ranges)
    before = with_neighbour(ordered, "line", "pk", ["uic"], ["uic"], -1, "prev_")
    kept = Stage(stops.sparkSession, "stops").save(
        before.filter(~F.col("uic").eqNullSafe(F.col("prev_uic"))).drop("prev_uic"))
    paired = with_neighbour(kept, "line", "pk", ["uic"], ["uic", "pk"], 1, "next_")
    return paired.filter(F.col("next_uic").isNotNull()).select(
        "line", F.col("uic").alias("src"), F.col("next_uic").alias("dst"),
        "pk", F.col("next_pk").alias("pk_next"))


def _positions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates of both ends."""
    def end(prefix: str) -> DataFrame:
        return nodes.select(F.col("uic").alias(prefix), F.col("lat").alias(prefix + "_lat"),
                            F.col("lon").alias(prefix + "_lon"))

    return edges.join(end("src"), "src").join(end("dst"), "dst")


def build_edges(stops: DataFrame, nodes: DataFrame, lines: DataFrame,
                ranges: int | None = None) -> DataFrame:
    """(src, dst, line, type, dist_km, weight, speed), in line direction.

    ``lines`` is ``line_attributes``.
    """
    along = F.abs(F.col("pk_next") - F.col("pk"))
    direct = distance_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    fast = F.coalesce("is_high_speed", F.lit(False))
    return _positions(consecutive_stops(stops, ranges), nodes).withColumn(
        "dist_km", F.when((along < 0.1) | (along > 500), direct).otherwise(along)
    ).filter(F.col("dist_km") >= 0.1).join(
        lines.select("line", "is_high_speed"), "line", "left"
    ).select(
        "src", "dst", "line", F.lit("TRAIN").alias("type"), "dist_km",
        F.when(fast, F.col("dist_km") / 3.0).otherwise(F.col("dist_km")).alias("weight"),
        F.when(fast, SPEED_HIGH).otherwise(SPEED_DEFAULT).alias("speed"))


def with_geometry(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """The geometry of the edge's line, kept out of the search tables."""
    return edges.join(lines.select("line", "geometry"), "line", "left")


def name_hubs(nodes: DataFrame, hubs: list[str] | None = None) -> DataFrame:
    """(hub, uic, lat, lon, ord): nodes whose name holds a hub name."""
    wanted = F.filter(F.array(*map(F.lit, hubs or W.TRANSFER_HUBS)),
                      lambda h: F.contains(F.lower("name"), F.lower(h)))
    return nodes.select(F.explode(wanted).alias("hub"), "uic", "lat", "lon", "ord")


def hub_transfers(members: DataFrame, max_km: float = TRANSFER_KM) -> DataFrame:
    """Walks between stations of one hub that lie nearer than ``max_km``.

    Points share a grid cell or touch one, so only near pairs meet, however large a hub
    is.  Each pair appears once, in file order.
    """
    cell = earth_cell(F.col("lat"), F.col("lon"), max_km)
    placed = members.withColumn("cell", cell)
    steps = F.array(*[F.lit(v) for v in (-1, 0, 1)])

    def around(c: Column) -> Column:
        return F.flatten(F.transform(steps, lambda dx: F.flatten(F.transform(
            steps, lambda dy: F.transform(steps, lambda dz: F.struct(
                (c["cx"] + dx).alias("cx"), (c["cy"] + dy).alias("cy"),
                (c["cz"] + dz).alias("cz")))))))

    left = placed.select("hub", F.col("uic").alias("src"), F.col("lat").alias("a_lat"),
                         F.col("lon").alias("a_lon"), F.col("ord").alias("a_ord"),
                         F.explode(around(F.col("cell"))).alias("cell"))
    right = placed.select("hub", F.col("uic").alias("dst"), F.col("lat").alias("b_lat"),
                          F.col("lon").alias("b_lon"), F.col("ord").alias("b_ord"), "cell")
    dist = distance_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return left.join(right, ["hub", "cell"]).filter(F.col("a_ord") < F.col("b_ord")).withColumn(
        "dist_km", dist).filter(F.col("dist_km") < max_km).select(
        "hub", "src", "dst", F.lit("TRANSFERT").alias("line"), F.lit("WALK").alias("type"),
        "dist_km", F.lit(15.0).alias("weight"), F.lit(SPEED_WALK).alias("speed"))


def both_directions(edges: DataFrame) -> DataFrame:
    """The undirected multigraph as arcs, in one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(ends).alias("_e"), *rest).select(
        F.col("_e.a").alias("src"), F.col("_e.b").alias("dst"), *rest)


def cheapest_arcs(arcs: DataFrame) -> DataFrame:
    """The least weight per ordered node pair and the line that offers it."""
    return arcs.groupBy("src", "dst").agg(
        F.min(F.struct("weight", "line", "type", "dist_km", "speed")).alias("m")
    ).select("src", "dst", "m.*")


def network_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """E27."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(
        edges.agg(F.count(F.lit(1)).alias("edges")))


def bound_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose weight undercuts a third of the straight distance.

    ``factor`` is the largest multiple of the straight distance that never exceeds a
    weight; with it the lower bound of I5 holds on any network.
    """
    direct = distance_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return _positions(edges.select("src", "dst", "weight"), nodes).withColumn(
        "direct", direct).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("direct") / 3.0 > F.col("weight")).alias("violations"),
        F.min(F.when(F.col("direct") > 0, F.col("weight") / F.col("direct"))).alias("factor"))
