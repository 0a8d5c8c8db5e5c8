"""Result records (J1-J8): labels, shares, legs and what of a chain is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import text as tx
from waymesh.operators import registry as rg


def run_rows(routes: DataFrame, key: list[str]) -> DataFrame:
    """The runs of routes' legs, one row each: ``(key..., leg, run, ...)``."""
    legs = routes.select(*key, F.posexplode("legs").alias("leg", "l"))
    return legs.select(
        *key,
        "leg",
        F.col("l.start_index").alias("leg_start"),
        F.expr("aggregate(l.runs, 0L, (s, r) -> s + r.length)").alias("leg_length"),
        F.posexplode("l.runs").alias("run", "r"),
    ).select(*key, "leg", "leg_start", "leg_length", "run", "r.*")


def run_endpoints(runs: DataFrame, stops: DataFrame) -> DataFrame:
    """The authored ends of each run's route, turned if it is ridden backwards; the run's
    own ends where the route is unknown: adds ``origin, destination``.

    ``stops`` are the authored corridors, before filling.
    """
    ends = stops.groupBy("route_id").agg(
        F.min_by("place", "pos").alias("head"), F.max_by("place", "pos").alias("tail")
    )
    at = stops.select("route_id", "place", "pos")
    placed = (
        runs.join(ends, "route_id", "left")
        .join(at.select("route_id", F.col("place").alias("start_place"), F.col("pos").alias("i1")), ["route_id", "start_place"], "left")
        .join(at.select("route_id", F.col("place").alias("end_place"), F.col("pos").alias("i2")), ["route_id", "end_place"], "left")
    )
    turned = F.coalesce(F.col("i1") > F.col("i2"), F.lit(False))
    return placed.withColumn(
        "origin", F.when(F.col("head").isNull(), F.col("start_place")).when(turned, F.col("tail")).otherwise(F.col("head"))
    ).withColumn(
        "destination", F.when(F.col("head").isNull(), F.col("end_place")).when(turned, F.col("head")).otherwise(F.col("tail"))
    ).drop("head", "tail", "i1", "i2")


def percent(part: Column) -> Column:
    """A share in whole percent, half to even."""
    return F.bround(part * 100, 0).cast("int")


def run_chips(routes: DataFrame, stops: DataFrame, key: list[str]) -> DataFrame:
    """One chip per run: its route's ends, its share of the leg, its stop range."""
    runs = run_endpoints(run_rows(routes, key), stops)
    along = Window.partitionBy(*key, "leg").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.withColumn("end_index", (F.col("leg_start") + F.sum("hops").over(along)).cast("int"))
        .withColumn("start_index", (F.col("end_index") - F.col("hops")).cast("int"))
        .select(
            *key,
            "leg",
            "run",
            F.when(F.col("route_id") >= 0, F.col("route_id")).otherwise(-1).alias("route_id"),
            "origin",
            "destination",
            F.when(F.col("leg_length") == 0, 100)
            .otherwise(percent(F.col("length") / F.col("leg_length")))
            .alias("share"),
            "priority",
            "start_index",
            "end_index",
        )
    )


def labelled(chips: DataFrame, registry: DataFrame) -> DataFrame:
    """Chips with their label by display name, a place without one by its number.
    ``registry(place_id, display)``."""
    names = registry.select("place_id", "display")
    shown = lambda name, place: F.coalesce(name, F.col(place).cast("string"))
    return (
        chips.join(names.select(F.col("place_id").alias("origin"), F.col("display").alias("o")), "origin", "left")
        .join(names.select(F.col("place_id").alias("destination"), F.col("display").alias("d")), "destination", "left")
        .withColumn("label", F.concat_ws(" - ", shown("o", "origin"), shown("d", "destination")))
        .drop("o", "d")
    )


def length_factor(q: Column, hhi: Column) -> Column:
    return F.when(hhi == 0, 1.0).otherwise(q / hhi)


def leg_records(routes: DataFrame, key: list[str]) -> DataFrame:
    """Per leg its ends, match on the route's scale and rating."""
    legs = routes.select(*key, "stops", "q", F.col("hhi").alias("route_hhi"), F.posexplode("legs").alias("leg", "l"))
    return legs.select(
        *key,
        "leg",
        F.expr("stops[l.start_index]").alias("start_place"),
        F.expr("stops[l.end_index]").alias("end_place"),
        F.col("l.start_index").alias("start_index"),
        F.col("l.end_index").alias("end_index"),
        percent(F.col("l.hhi") * length_factor(F.col("q"), F.col("route_hhi"))).alias("match"),
        F.col("l.priority").alias("priority"),
    )


def route_records(routes: DataFrame, stops: DataFrame, key: list[str]) -> DataFrame:
    """One record per route with its chips and legs nested in travel order."""
    chips = run_chips(routes, stops, key).groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("leg", "run", "route_id", "origin", "destination", "share", "priority", "start_index", "end_index")
            )
        ).alias("routes")
    )
    legs = leg_records(routes, key).groupBy(*key).agg(
        F.array_sort(
            F.collect_list(F.struct("leg", "start_place", "end_place", "start_index", "end_index", "match", "priority"))
        ).alias("legs")
    )
    return (
        routes.select(*key, "stops", "route_count", percent(F.col("q")).alias("match"), "priority")
        .join(chips, key, "left")
        .join(legs, key, "left")
    )


#: A chip as it is shown: the type of an empty list of them.
CHIPS = "array<struct<id:bigint,label:string,share:int,priority:int,startIndex:int,endIndex:int>>"


def display_records(routes: DataFrame, stops: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """Whole records by display name, ``(key..., path, meta)``.

    ``meta`` holds ``routeCount, match, priority, routes, legs``; every leg nests its own chips and
    ``routes`` lists those of all legs in travel order. A leg without runs has no chips; a place
    without a name shows its number. ``registry`` has ``place_id, name, group``.
    """
    named = rg.with_display(registry)
    chip = F.struct(
        F.col("route_id").cast("long").alias("id"), "label", "share", "priority",
        F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"),
    )
    chips = labelled(run_chips(routes, stops, key), named).groupBy(*key, "leg").agg(
        F.array_sort(F.collect_list(F.struct("run", chip.alias("chip")))).alias("sorted")
    )
    chips = chips.select(*key, "leg", F.transform("sorted", lambda e: e["chip"]).cast(CHIPS).alias("routes"))
    paths = rg.translate(routes.select(*key, F.col("stops").alias("path")), registry, key, "path")
    leg = F.struct(
        F.get("path", F.col("start_index")).alias("start"), F.get("path", F.col("end_index")).alias("end"),
        F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"), "match", "priority",
        F.coalesce("routes", F.expr(f"cast(array() as {CHIPS})")).alias("routes"),
    )
    legs = leg_records(routes, key).join(chips, [*key, "leg"], "left").join(paths, key)
    legs = legs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("leg", leg.alias("record")))).alias("sorted"))
    legs = legs.select(*key, F.transform("sorted", lambda e: e["record"]).alias("legs"))
    meta = F.struct(
        F.col("route_count").alias("routeCount"), percent(F.col("q")).alias("match"), "priority",
        F.flatten(F.transform("legs", lambda e: e["routes"])).alias("routes"), "legs",
    )
    return routes.select(*key, "route_count", "q", "priority").join(paths, key).join(legs, key).select(*key, "path", meta.alias("meta"))


def path_nodes(routes: DataFrame, key: list[str]) -> DataFrame:
    """The places on each path."""
    return routes.select(*key, F.explode("stops").alias("place")).distinct()


def path_links(routes: DataFrame, key: list[str]) -> DataFrame:
    """The edges on each path."""
    return routes.select(*key, F.explode("edges").alias("e")).select(*key, "e.a", "e.b")


def visible_path(stops: str, groups: str, hidden: str) -> Column:
    """A chain without interior stops of the hidden groups. ``groups`` is the class of
    every stop, ``hidden`` the hidden classes; ends and the default group always show."""
    return F.expr(
        f"filter({stops}, (p, i) -> i = 0 or i = size({stops}) - 1 or {groups}[i] = '{tx.DEFAULT_GROUP}' "
        f"or not array_contains({hidden}, {groups}[i]))"
    )


def classes(stops: str) -> Column:
    """D3 over a chain of display names."""
    return F.transform(stops, tx.classify)


def visible_segments(routes: DataFrame, key: list[str]) -> DataFrame:
    """Chains of display names ``(key..., stops, legs, hidden)`` as parts in travel order:
    ``(key..., part, kind, stops)``; each required stop is a part of its own."""
    cutup = routes.select(
        *key,
        "hidden",
        F.posexplode(
            F.expr(
                """flatten(transform(legs, (l, j) -> concat(
                     array(named_struct('kind', 'segment', 'stops', slice(stops,
                       l.start_index + if(j > 0, 1, 0) + 1,
                       greatest(l.end_index - if(j < size(legs) - 1, 1, 0) - (l.start_index + if(j > 0, 1, 0)) + 1, 0)))),
                     if(j < size(legs) - 1,
                       array(named_struct('kind', 'waypoint', 'stops', slice(stops, l.end_index + 1, 1))),
                       cast(array() as array<struct<kind:string,stops:array<string>>>)))))"""
            )
        ).alias("part", "p"),
    ).select(*key, "hidden", "part", "p.kind", "p.stops")
    shown = cutup.withColumn("groups", classes("stops")).withColumn(
        "stops",
        F.when(F.col("kind") == "waypoint", F.col("stops")).otherwise(visible_path("stops", "groups", "hidden")),
    )
    return shown.select(*key, "part", "kind", "stops")


def shown_stops(parts: DataFrame, key: list[str]) -> DataFrame:
    """The parts as one list again."""
    return parts.groupBy(*key).agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(part, stops))), e -> e.stops))").alias("stops")
    )


def present_groups(chains: DataFrame) -> DataFrame:
    """Per trip the groups among interior stops of ``chains(qid, stops)``, the default one left out."""
    inner = chains.select(
        "qid", F.explode(F.expr("slice(stops, 2, greatest(size(stops) - 2, 0))")).alias("text")
    )
    return (
        inner.select("qid", tx.classify(F.col("text")).alias("group"))
        .where(F.col("group") != tx.DEFAULT_GROUP)
        .distinct()
    )
