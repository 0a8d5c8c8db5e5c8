"""Deriving the undirected network from chains of stops.

The inputs and outputs are long tables:

* ``stops(route_id, pos, place)``   one row per stop, ``pos`` from 0
* ``edges(a, b, route_id)``         one row per edge and route, ``a < b``
* ``degree(place, degree)``         every place, isolated ones with 0
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import (
    CONFIRMED_GAP,
    CONFIRMED_MIN_ROUTES,
    CROSSROAD_DEGREE,
    LAZY_GAP,
    edge_ends,
)

# Chains are cut into blocks of this many stops before a window runs over them, so
# that no chain, however long, is sorted by one task.
BLOCK = 1024


def in_blocks(
    stops: DataFrame, ahead: int, block: int = BLOCK, pos: str = "pos"
) -> DataFrame:
    """Stops with a ``block`` column, the first ``ahead`` of a block also repeated in
    the block before it (``spill`` true), so each block sees what follows it."""
    at = F.floor(F.col(pos) / block).cast("long")
    home = F.struct(at.alias("block"), F.lit(False).alias("spill"))
    before = F.struct((at - 1).alias("block"), F.lit(True).alias("spill"))
    repeat = (at > 0) & (F.col(pos) % block < ahead)
    return stops.select(
        "*", F.explode(F.when(repeat, F.array(home, before)).otherwise(F.array(home))).alias("_b")
    ).select("*", "_b.block", "_b.spill").drop("_b")


def hops(stops: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every hop of every chain: ``(route_id, pos, place, onward)``, self-loops kept."""
    blocked = in_blocks(stops.select("route_id", "pos", "place"), 1, block)
    along = Window.partitionBy("route_id", "block").orderBy("pos")
    return (
        blocked.withColumn("onward", F.lead("place").over(along))
        .where(~F.col("spill") & F.col("onward").isNotNull())
        .select("route_id", "pos", "place", "onward")
    )


def edges(stops: DataFrame) -> DataFrame:
    """Edges with membership. A repeated edge of one route counts once."""
    return (
        hops(stops)
        .where(F.col("place") != F.col("onward"))
        .select(*edge_ends("place", "onward"), "route_id")
        .distinct()
    )


def links(edge_rows: DataFrame) -> DataFrame:
    """The edges alone, each once."""
    return edge_rows.select("a", "b").distinct()


def edge_records(edge_rows: DataFrame) -> DataFrame:
    """One record per edge with its sorted route ids."""
    return edge_rows.groupBy("a", "b").agg(
        F.sort_array(F.collect_set("route_id")).alias("route_ids")
    )


def edges_from_records(records: DataFrame) -> DataFrame:
    """The long form of stored edge records."""
    return records.select(*edge_ends("a", "b"), F.explode("route_ids").alias("route_id")).distinct()


def neighbour_rows(edge_rows: DataFrame) -> DataFrame:
    """Both directions of every edge: ``(place, neighbour)``."""
    pair = links(edge_rows)
    return pair.select(F.col("a").alias("place"), F.col("b").alias("neighbour")).unionAll(
        pair.select(F.col("b").alias("place"), F.col("a").alias("neighbour"))
    )


def places_of(stops: DataFrame) -> DataFrame:
    """Every place once."""
    return stops.select("place").distinct()


def degrees(edge_rows: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Connections per place; with ``places`` the isolated ones appear with 0."""
    counted = neighbour_rows(edge_rows).groupBy("place").agg(F.count("*").alias("degree"))
    if places is None:
        return counted
    return places.select("place").join(counted, "place", "left").select(
        "place", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )


def adjacency(edge_rows: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Sorted unique neighbours per place, empty for an isolated place."""
    near = neighbour_rows(edge_rows).groupBy("place").agg(
        F.sort_array(F.collect_set("neighbour")).alias("neighbours")
    )
    if places is None:
        return near
    return places.select("place").join(near, "place", "left").select(
        "place", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours")
    )


def is_crossroad(degree: Column) -> Column:
    return degree >= CROSSROAD_DEGREE


def crossroads(degree: DataFrame, min_degree: int = CROSSROAD_DEGREE) -> DataFrame:
    """The real intersections."""
    return degree.where(F.col("degree") >= min_degree)


def routes_on(pairs: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """The routes on each asked pair ``(x, y)``, in either order."""
    asked = pairs.select("*", *edge_ends("x", "y"))
    return asked.join(edge_rows, ["a", "b"], "left").drop("a", "b")


def route_ids(edge_rows: DataFrame) -> DataFrame:
    """Route ids present on any edge."""
    return edge_rows.select("route_id").distinct()


def known(asked: DataFrame, places: DataFrame) -> DataFrame:
    """The asked places that the network has."""
    return asked.join(places.select("place"), "place", "left_semi")


def without_places(
    edge_rows: DataFrame, degree: DataFrame, closed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The network without ``closed(place)``: its edges and its degrees.

    Neighbours of a closed place stay, isolated if need be; degrees change.
    """
    shut = closed.select("place").distinct()
    kept = edge_rows.join(shut, edge_rows["a"] == shut["place"], "left_anti").join(
        shut, F.col("b") == shut["place"], "left_anti"
    )
    return kept, degrees(kept, degree.join(shut, "place", "left_anti"))


def direct_takers(stops: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """How many authored routes take each direct hop, and the hop's gap budget.

    ``groups(route_id, group_id)`` names the authored route of each chain: the chains
    of one tree count once.
    """
    taken = edges(stops)
    if groups is None:
        taken = taken.withColumn("group_id", F.col("route_id"))
    else:
        taken = taken.join(groups, "route_id")
    return (
        taken.select("a", "b", "group_id")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("*").alias("takers"))
        .withColumn(
            "budget",
            F.when(F.col("takers") >= CONFIRMED_MIN_ROUTES, CONFIRMED_GAP).otherwise(LAZY_GAP),
        )
    )


def to_network(
    edge_rows: DataFrame, degree: DataFrame, registry: DataFrame, closed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes with closure flag and group, and links by display name.

    ``registry(place_id, name, group, display)``; ``closed(place)``.
    """
    names = registry.select(F.col("place_id").alias("place"), "group", "display")
    shut = closed.select("place").distinct().withColumn("compromised", F.lit(True))
    nodes = (
        degree.select("place")
        .join(names, "place")
        .join(shut, "place", "left")
        .select(
            F.col("display").alias("id"),
            F.coalesce("compromised", F.lit(False)).alias("compromised"),
            "group",
        )
    )
    ends = names.select("place", "display")
    out_links = (
        links(edge_rows)
        .join(ends.select(F.col("place").alias("a"), F.col("display").alias("source")), "a")
        .join(ends.select(F.col("place").alias("b"), F.col("display").alias("target")), "b")
        .select("source", "target")
    )
    return nodes, out_links
