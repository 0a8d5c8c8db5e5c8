"""Concentration of chains: the exact credit assignment, runs and records.

A chain's score is the Herfindahl index of how its length splits over the routes it
rides, for the assignment of hops to routes that maximises it. Squares are
superadditive, so an optimal assignment cuts the chain into intervals that each lie
on one common route, and ``best[j]`` only needs every start ``i`` from which one route
reaches ``j`` unbroken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import BEST_PRIORITY, LENGTH_EXPONENT, is_crossroad_expr
from waymesh.operators import marks as mk


@dataclass(frozen=True)
class Network:
    """A derived network: the long tables every scoring and search job reads."""

    stops: DataFrame  # route_id, pos, place: the filled chains
    edges: DataFrame  # a, b, route_id
    degree: DataFrame  # place, degree
    marks: DataFrame  # route_id, start_place, end_place, priority


def edge_units(edge_rows: DataFrame, degree: DataFrame, crossroads_only: bool = True) -> DataFrame:
    """G1: the length each edge contributes, the same in both directions."""
    pair = edge_rows.select("a", "b").distinct()
    if not crossroads_only:
        return pair.withColumn("unit", F.lit(1))
    flag = degree.select("place", is_crossroad_expr("degree").alias("x"))
    return (
        pair.join(flag.select(F.col("place").alias("a"), F.col("x").alias("xa")), "a")
        .join(flag.select(F.col("place").alias("b"), F.col("x").alias("xb")), "b")
        .select("a", "b", (F.col("xa") + F.col("xb")).alias("unit"))
    )


def prefix_lengths(chain_units: DataFrame, key: list[str]) -> DataFrame:
    """Running length of ``chain_units(key..., i, unit)`` after each hop."""
    along = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return chain_units.withColumn("length", F.sum("unit").over(along).cast("long"))


def stop_flags(chains: DataFrame, degree: DataFrame, key: list[str], crossroads_only: bool) -> DataFrame:
    """Each stop of each chain with its crossroad flag: ``(key..., at, place, x)``.

    Only places the chains visit are looked up.
    """
    seen = chains.select(*key, F.posexplode("stops").alias("at", "place"))
    if not crossroads_only:
        return seen.withColumn("x", F.lit(1))
    return seen.join(degree, "place", "left").select(
        *key, "at", "place", F.coalesce(is_crossroad_expr("degree"), F.lit(0)).alias("x")
    )


def chain_lengths(chains: DataFrame, degree: DataFrame, key: list[str], crossroads_only: bool = True) -> DataFrame:
    """Crossroads passed by each chain, both ends counted; or its hops."""
    if not crossroads_only:
        return chains.select(*key, F.greatest(F.size("stops") - 1, F.lit(0)).cast("long").alias("crossroad_hops"))
    return stop_flags(chains, degree, key, True).groupBy(*key).agg(
        F.sum("x").cast("long").alias("crossroad_hops")
    )


# The optimum over the starts that reach hop j. `flags` holds one 0/1 per stop, `reach`
# for every hop the leftmost hop from which one route runs unbroken up to it. States are
# ordered by (value, fewest transfers, longest last run).
_LENGTHS = (
    "transform(sequence(0, size(flags) - 1), k -> cast(if(k = 0, 0, aggregate("
    "sequence(1, k), 0L, (s, m) -> s + {unit})) as bigint))"
)
_UNIT = {True: "flags[m - 1] + flags[m]", False: "1"}
_BEST = (
    "aggregate(sequence(1, size(reach)), "
    "array(named_struct('v', 0L, 't', 0, 'back', 0)), "
    "(acc, j) -> array_append(acc, array_max(transform("
    "sequence(reach[j - 1], j - 1), i -> named_struct("
    "'v', acc[i].v + (len[j] - len[i]) * (len[j] - len[i]), 't', acc[i].t - 1, 'back', -i)))))"
)
_CUTS = (
    "aggregate(sequence(1, size(reach)), "
    "named_struct('at', size(reach), 'cuts', array(size(reach))), "
    "(s, k) -> if(s.at = 0, s, named_struct('at', -best[s.at].back, "
    "'cuts', concat(array(-best[s.at].back), s.cuts))), s -> s.cuts)"
)


def memberships(chains: DataFrame, edge_rows: DataFrame, key: list[str]) -> DataFrame:
    """The routes of each hop of each chain: ``(key..., i, route_id)``.

    H6: an edge no route carries is a route of its own, numbered below zero by the first
    hop of the chain that takes it, so a chain that takes it again stays on the same route.
    """
    same = Window.partitionBy(*key, "a", "b")
    return (
        mk.chain_hops(chains, key)
        .withColumn("first", F.min("i").over(same))
        .join(edge_rows, ["a", "b"], "left")
        .select(*key, "i", F.coalesce("route_id", -F.col("first").cast("long") - 1).alias("route_id"))
    )


def credit_cuts(
    chains: DataFrame, spans: DataFrame, degree: DataFrame, key: list[str], crossroads_only: bool
) -> DataFrame:
    """Where the optimal assignment cuts each chain: ``(key..., stops, len, cuts)``.

    The spans are reduced to one start per hop before anything is collected, so the
    arrays are as long as the chain however many routes share its edges.
    """
    reach = (
        spans.select(*key, "lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("i"))
        .groupBy(*key, "i")
        .agg(F.min("lo").alias("lo"))
        .groupBy(*key)
        .agg(F.expr("transform(array_sort(collect_list(struct(i, lo))), e -> cast(e.lo as int))").alias("reach"))
    )
    flags = (
        stop_flags(chains, degree, key, crossroads_only)
        .groupBy(*key)
        .agg(F.expr("transform(array_sort(collect_list(struct(at, x))), e -> cast(e.x as bigint))").alias("flags"))
    )
    lengths = F.expr(_LENGTHS.format(unit=_UNIT[crossroads_only]))
    return (
        chains.select(*key, "stops")
        .join(reach, key)
        .join(flags, key)
        .withColumn("len", lengths)
        .withColumn("best", F.expr(_BEST))
        .withColumn("cuts", F.expr(_CUTS))
        .select(*key, "stops", "len", "cuts", F.aggregate("flags", F.lit(0).cast("long"), lambda s, x: s + x).alias("crossings"))
    )


def assign_runs(cut_rows: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """The runs in travel order: ``(key..., run, first, last, route_id, length, hops,
    start_place, end_place)``. Among routes that carry a whole run the smallest id is named."""
    pieces = cut_rows.select(
        *key,
        F.posexplode(
            F.expr(
                "transform(sequence(1, size(cuts) - 1), c -> struct("
                "cuts[c - 1] as first, cuts[c] as last, "
                "len[cuts[c]] - len[cuts[c - 1]] as length, "
                "stops[cuts[c - 1]] as start_place, stops[cuts[c]] as end_place))"
            )
        ).alias("run", "r"),
    ).select(*key, "run", "r.*")
    named = (
        pieces.select(*key, "run", "first", "last")
        .join(spans, key)
        .where("lo <= first and last <= hi")
        .groupBy(*key, "run")
        .agg(F.min("route_id").alias("route_id"))
    )
    return pieces.join(named, [*key, "run"]).withColumn("hops", F.col("last") - F.col("first"))


def _record(runs: Column) -> list[Column]:
    """The columns that follow from the runs alone."""
    ids = F.transform(runs, lambda r: r["route_id"])
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["length"])
    squares = F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["length"] * r["length"])
    return [
        total.alias("length"),
        F.when(F.size(runs) == 0, F.lit(1.0))
        .when(total == 0, F.lit(1.0) / F.size(F.array_distinct(ids)))
        .otherwise(squares / (total * total).cast("double"))
        .alias("hhi"),
        F.array_sort(F.array_distinct(F.filter(ids, lambda r: r >= 0))).alias("route_ids"),
    ]


RUNS_TYPE = (
    "array<struct<route_id:bigint,length:bigint,hops:int,priority:int,"
    "start_place:bigint,end_place:bigint>>"
)


def score(
    chains: DataFrame, net: Network, key: list[str], crossroads_only: bool = True
) -> DataFrame:
    """Scored records of ``chains(key..., stops)``.

    Adds ``runs, hhi, priority, length, route_ids, route_count, crossroad_hops,
    total_hops``. Every join is keyed by the chain or by an edge the chain rides.
    """
    spans = mk.on_route_spans(memberships(chains, net.edges, key), key)
    cut_rows = credit_cuts(chains, spans, net.degree, key, crossroads_only)
    runs = assign_runs(cut_rows, spans, key)
    ridden = mk.ridden_marks(chains, spans, net.marks, key)
    stamped = mk.stamp_runs(runs, ridden, key)
    gathered = stamped.groupBy(*key).agg(
        F.expr(
            "transform(array_sort(collect_list(struct(run, cast(route_id as bigint) as route_id, "
            "cast(length as bigint) as length, cast(hops as int) as hops, cast(priority as int) as priority, "
            "start_place, end_place))), e -> struct(e.route_id, e.length, e.hops, e.priority, "
            "e.start_place, e.end_place))"
        ).alias("runs")
    )
    lone = chain_lengths(chains.where(F.size("stops") < 2), net.degree, key, crossroads_only)
    crossings = (
        cut_rows.select(
            *key,
            (F.col("crossings") if crossroads_only else (F.size("stops") - 1).cast("long")).alias("crossroad_hops"),
        ).unionByName(lone)
    )
    empty = F.expr(f"cast(array() as {RUNS_TYPE})")
    out = (
        chains.select(*key, "stops")
        .join(gathered, key, "left")
        .join(crossings, key, "left")
        .withColumn("runs", F.coalesce("runs", empty))
    )
    return out.select(
        *key,
        "stops",
        "runs",
        *_record(F.col("runs")),
        F.aggregate("runs", F.lit(BEST_PRIORITY), lambda s, r: F.greatest(s, r["priority"])).alias("priority"),
        F.coalesce("crossroad_hops", F.lit(0)).cast("long").alias("crossroad_hops"),
        F.greatest(F.size("stops") - 1, F.lit(0)).alias("total_hops"),
    ).withColumn("route_count", F.size("route_ids"))


def ranking_score(hhi: Column, c_min: Column, length: Column) -> Column:
    """Concentration tempered by length; untouched when either length is 0."""
    return F.when(
        (c_min > 0) & (length > 0), hhi * F.pow(c_min / length, F.lit(LENGTH_EXPONENT))
    ).otherwise(hhi)

