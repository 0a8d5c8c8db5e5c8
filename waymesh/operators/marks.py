"""Priority marks on the network and on chains.

``marks(route_id, start_place, end_place, priority)`` rates a stretch of one route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import BEST_PRIORITY, edge_ends
from waymesh.operators.network import hops


def rated(marks: DataFrame) -> DataFrame:
    """marks that say something; best-priority ones do not."""
    return marks.where(F.col("priority") != BEST_PRIORITY)


def route_priority(marks: DataFrame) -> DataFrame:
    """the worst priority each rated route can inflict."""
    return rated(marks).groupBy("route_id").agg(F.max("priority").alias("priority"))


def worst_priority(marks: DataFrame) -> DataFrame:
    """one row: the worst mark of the network and whether there is any."""
    return rated(marks).agg(
        F.coalesce(F.max("priority"), F.lit(BEST_PRIORITY)).cast("int").alias("worst"),
        (F.count("*") > 0).alias("has_priorities"),
    )


def run_priority(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """the rating of each ``spans(span_id, route_id, places)``: the worst mark of
    the route with both ends among the places."""
    held = (
        spans.join(rated(marks), "route_id")
        .where(
            F.array_contains("places", F.col("start_place"))
            & F.array_contains("places", F.col("end_place"))
        )
        .groupBy("span_id")
        .agg(F.max("priority").alias("priority"))
    )
    return spans.join(held, "span_id", "left").withColumn(
        "priority", F.coalesce("priority", F.lit(BEST_PRIORITY)).cast("int")
    )


def simple_routes(edge_rows: DataFrame) -> DataFrame:
    """which routes' edges form one simple path, with its two ends.

    A path touches two places once and none more than twice, and has one edge less
    than places; a ring beside a path would have as many edges as places.
    """
    per_place = (
        edge_rows.select("route_id", F.explode(F.array("a", "b")).alias("place"))
        .groupBy("route_id", "place")
        .agg(F.count("*").alias("near"))
    )
    return per_place.groupBy("route_id").agg(
        (
            (F.sum(F.when(F.col("near") == 1, 1).otherwise(0)) == 2)
            & (F.max("near") <= 2)
            & (F.sum("near") == 2 * (F.count("*") - 1))
        ).alias("simple"),
        F.min(F.when(F.col("near") == 1, F.col("place"))).alias("first_end"),
        F.max(F.when(F.col("near") == 1, F.col("place"))).alias("last_end"),
        F.count("*").alias("places"),
    )


def marked_edges(
    stops: DataFrame, marks: DataFrame, edge_rows: DataFrame | None = None
) -> DataFrame:
    """``(route_id, a, b, priority)``, the worst mark covering each edge of a route.

    ``stops`` are the filled chains, ``edge_rows`` the edges that are left of them (for
    instance of a network with places removed), all if not given. A route whose edges are
    not one simple path counts as wholly marked at its worst rating; a mark whose end is
    gone says nothing.
    """
    worth = rated(marks)
    touched = stops.join(worth.select("route_id").distinct(), "route_id", "left_semi")
    at = touched.select("route_id", F.col("place").alias("p"), F.col("pos").alias("i"))
    ranges = (
        worth.join(at.withColumnRenamed("p", "start_place").withColumnRenamed("i", "i1"), ["route_id", "start_place"])
        .join(at.withColumnRenamed("p", "end_place").withColumnRenamed("i", "i2"), ["route_id", "end_place"])
        .select("route_id", F.least("i1", "i2").alias("lo"), F.greatest("i1", "i2").alias("hi"), "priority")
        .where("lo < hi")
    )
    driven = hops(touched).where("place <> onward").select("route_id", "pos", *edge_ends("place", "onward"))
    if edge_rows is None:
        remaining, runs = driven.select("route_id", "a", "b").distinct(), driven
    else:
        remaining = edge_rows.join(worth.select("route_id").distinct(), "route_id", "left_semi")
        runs = driven.join(remaining, ["route_id", "a", "b"], "left_semi")
    whole = simple_routes(remaining.select("route_id", "a", "b").distinct()).select("route_id", "simple")
    broken = whole.where(~F.col("simple")).select("route_id")
    # A mark needs both of its ends on the chain that is left.
    ends = runs.join(whole.where("simple"), "route_id", "left_semi").groupBy("route_id").agg(
        F.min("pos").alias("first"), (F.max("pos") + 1).alias("last")
    )
    # One row per covered hop: the join with the hops stays an equi-join on
    # (route_id, pos) instead of a range join inside one route.
    alive = (
        ranges.join(ends, "route_id")
        .where("lo >= first and hi <= last")
        .select("route_id", "priority", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
        .groupBy("route_id", "pos")
        .agg(F.max("priority").alias("priority"))
    )
    kept_marks = (
        runs.join(alive, ["route_id", "pos"])
        .join(broken, "route_id", "left_anti")
        .groupBy("route_id", "a", "b")
        .agg(F.max("priority").alias("priority"))
    )
    all_marked = remaining.join(broken, "route_id", "left_semi").join(
        route_priority(marks), "route_id"
    ).select("route_id", "a", "b", "priority")
    return kept_marks.unionByName(all_marked)


def edge_priority(edge_rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``(a, b, priority)``: the best rating among the routes on an edge."""
    return (
        edge_rows.join(marked, ["route_id", "a", "b"], "left")
        .groupBy("a", "b")
        .agg(F.min(F.coalesce("priority", F.lit(BEST_PRIORITY))).cast("int").alias("priority"))
    )


def chain_hops(chains: DataFrame, key: list[str]) -> DataFrame:
    """The hops of ``chains(key..., stops)``: ``(key..., i, a, b)``, ``i`` from 0."""
    return chains.where(F.size("stops") > 1).select(
        *key,
        F.posexplode(
            F.expr(
                "transform(sequence(1, size(stops) - 1), k -> struct("
                "least(stops[k - 1], stops[k]) as a, greatest(stops[k - 1], stops[k]) as b))"
            )
        ).alias("i", "e"),
    ).select(*key, "i", "e.a", "e.b")


def on_route_spans(membership: DataFrame, key: list[str]) -> DataFrame:
    """maximal node windows ``[lo, hi]`` on which a chain stays on one route.

    ``membership(key..., i, route_id)``: the routes of each hop. Windows are bounded
    by the length of one chain.
    """
    along = Window.partitionBy(*key, "route_id").orderBy("i")
    return (
        membership.withColumn("island", F.col("i") - F.row_number().over(along))
        .groupBy(*key, "route_id", "island")
        .agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"))
        .drop("island")
    )


def ridden_marks(chains: DataFrame, spans: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """F8: marks a chain rides whole: ``(key..., lo, hi, priority)``.

    Both ends of the mark lie in one span of the marked route. A chain may repeat a
    place, so every occurrence counts.
    """
    seen = chains.select(*key, F.posexplode("stops").alias("at", "place"))
    first = seen.withColumnRenamed("place", "start_place").withColumnRenamed("at", "p1")
    second = seen.withColumnRenamed("place", "end_place").withColumnRenamed("at", "p2")
    return (
        spans.join(rated(marks), "route_id")
        .join(first, [*key, "start_place"])
        .where("p1 between lo and hi")
        .join(second, [*key, "end_place"])
        .where("p2 between lo and hi and p1 <> p2")
        .select(*key, F.least("p1", "p2").alias("lo"), F.greatest("p1", "p2").alias("hi"), "priority")
        .distinct()
    )


def stamp_runs(runs: DataFrame, ridden: DataFrame, key: list[str]) -> DataFrame:
    """runs ``(key..., run, first, last, ...)`` with the worst ridden mark they overlap."""
    worst = (
        runs.select(*key, "run", "first", "last")
        .join(ridden, key)
        .where("lo < last and first < hi")
        .groupBy(*key, "run")
        .agg(F.max("priority").alias("priority"))
    )
    return runs.join(worst, [*key, "run"], "left").withColumn(
        "priority", F.coalesce("priority", F.lit(BEST_PRIORITY)).cast("int")
    )


def tiers(chains: DataFrame, ridden: DataFrame, key: list[str]) -> DataFrame:
    """the worst mark each chain rides whole."""
    worst = ridden.groupBy(*key).agg(F.max("priority").alias("tier"))
    return chains.select(*key).join(worst, key, "left").select(
        *key, F.coalesce("tier", F.lit(BEST_PRIORITY)).cast("int").alias("tier")
    )
