"""Trips with required stops (H13-H17, G10): order the stops, search leg by leg, combine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import (
    BEST_PRIORITY,
    WAYPOINT_MAX_STRETCH,
    path_edges,
)
from waymesh.operators import marks as mk
from waymesh.operators import search as se
from waymesh.operators.pool import Prepared, candidate_pool
from waymesh.operators.score import RUNS_TYPE, chain_lengths, memberships, ranking_score
from waymesh.operators.select import select_diverse
from waymesh.session import cut, together


def normalise_via(trips: DataFrame) -> DataFrame:
    """Required stops without blanks, repeats and the trip's own ends."""
    return trips.withColumn(
        "via",
        F.array_except(
            F.array_distinct(F.filter(F.coalesce("via", F.array().cast("array<bigint>")), lambda v: v.isNotNull())),
            F.array("start_place", "end_place"),
        ),
    )


def cheapest_order(count: int, cost: dict[tuple[int, int], int]) -> list[int] | None:
    """The cheapest order of stops 1..``count`` from 0 to ``count`` + 1, the first of equals.

    ``cost`` holds the hops that have a way. Every set of stops still to visit is priced once
    for every stop it can be entered from, so all orders are weighed without listing them.
    """
    end = count + 1
    rest: list[dict[int, int]] = [{} for _ in range(1 << count)]  # stops left (bits) -> place -> cost to the end
    for left in range(1 << count):
        for at in range(count + 1):
            if at and left >> (at - 1) & 1:
                continue
            if not left:
                ways = [cost[at, end]] if (at, end) in cost else []
            else:
                ways = [
                    cost[at, i] + rest[left ^ 1 << (i - 1)][i]
                    for i in range(1, end)
                    if left >> (i - 1) & 1 and (at, i) in cost and i in rest[left ^ 1 << (i - 1)]
                ]
            if ways:
                rest[left][at] = min(ways)
    left, at, order = (1 << count) - 1, 0, []
    if 0 not in rest[left]:
        return None
    while left:
        at, left = next(
            (i, left ^ 1 << (i - 1))
            for i in range(1, end)
            if left >> (i - 1) & 1
            and (at, i) in cost
            and i in rest[left ^ 1 << (i - 1)]
            and cost[at, i] + rest[left ^ 1 << (i - 1)][i] == rest[left][at]
        )
        order.append(at)
    return order


def best_order(trips: DataFrame, ready: Prepared, most_optimized: int | None = None) -> DataFrame:
    """The cheapest order by hops in which every leg has a way: ``(qid, points, rule)``.

    Each pair of a trip's points is priced once. ``rule`` is ``exact``; only if the caller
    bounds the work by ``most_optimized`` do trips with more stops keep their ``given`` order.
    Bans on a leg are soft, so an order with a way for every leg always yields a pool:
    the first order to yield one is the cheapest of these.
    """
    stops = trips.select("qid", F.concat(F.array("start_place"), "via", F.array("end_place")).alias("points")).withColumn(
        "rule", F.lit("exact") if most_optimized is None else F.when(F.size("points") - 2 > most_optimized, "given").otherwise("exact")
    )
    # Of a given order only neighbours are asked for, else any point but the end before any but the start.
    pairs = stops.select(
        "qid",
        F.explode(
            F.expr(
                "flatten(transform(sequence(0, size(points) - 2), i -> transform("
                "sequence(1, size(points) - 1), j -> struct(i, j, points[i] as src, points[j] as dst))))"
            )
        ).alias("p"),
        "rule",
    ).select("qid", "p.*", "rule").where("i <> j and (rule = 'exact' or j = i + 1)")
    pairs = cut(pairs.where("not (i = 0 and j > 1 and rule = 'given')").drop("rule"), "pairs")
    asked = pairs.select("src", "dst").distinct()
    probes = cut(
        se.plain_searches(asked, F.concat_ws("|", "src", "dst"), transfer=0, hop_weight=0, step=1), "probes"
    )
    got = se.found(se.search(probes, ready.rail, ends_alone=True), probes).join(probes.select("sid", "src", "dst"), "sid")
    priced = (
        pairs.join(got.select("src", "dst", "cost"), ["src", "dst"])
        .groupBy("qid")
        .agg(F.collect_list(F.struct("i", "j", "cost")).alias("priced"))
    )
    asked = stops.join(priced, "qid")

    def settle(batches):
        for batch in batches:
            rows = []
            for qid, points, rule, known in zip(batch["qid"], batch["points"], batch["rule"], batch["priced"], strict=True):
                points, cost = list(points), {(p["i"], p["j"]): p["cost"] for p in known}
                inner = len(points) - 2
                if rule == "given":
                    order = list(range(1, inner + 1)) if all((i, i + 1) in cost for i in range(inner + 1)) else None
                else:
                    order = cheapest_order(inner, cost)
                if order is not None:
                    rows.append((qid, [points[0], *[points[i] for i in order], points[-1]], rule))
            if rows:
                yield pd.DataFrame(rows, columns=["qid", "points", "rule"])

    kind = dict(trips.dtypes)
    return asked.mapInPandas(settle, f"qid {kind['qid']}, points array<{kind['start_place']}>, rule string")


def leg_trips(points: DataFrame) -> DataFrame:
    """Legs as trips ``(qid, leg, lid, start_place, end_place, banned)``; the other
    required stops of the trip are banned softly."""
    return points.select(
        "qid",
        F.expr("slice(points, 2, size(points) - 2)").alias("inner"),
        F.posexplode(
            F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] as s, points[i] as e))")
        ).alias("leg", "l"),
    ).select(
        "qid",
        "leg",
        F.concat_ws("#", "qid", "leg").alias("lid"),
        F.col("l.s").alias("start_place"),
        F.col("l.e").alias("end_place"),
        F.array_except("inner", F.array("l.s", "l.e")).alias("banned"),
    )


def trim_sizes(sizes: DataFrame, limit: int) -> DataFrame:
    """How many candidates each leg keeps so that the product stays within ``limit``:
    one at a time from the largest leg, the first of equals: ``(qid, leg, keep)``."""
    gathered = sizes.groupBy("qid").agg(
        F.expr("transform(array_sort(collect_list(struct(leg, n))), e -> cast(e.n as bigint))").alias("n")
    )
    steps = f"""
      aggregate(sequence(1, greatest(1, cast(aggregate(n, 0L, (s, x) -> s + x) as int))),
        named_struct('n', n, 'total', aggregate(n, 1L, (s, x) -> s * x)),
        (s, _) -> if(s.total > {limit} and array_max(s.n) > 1,
          named_struct(
            'n', transform(s.n, (x, i) -> if(i = array_position(s.n, array_max(s.n)) - 1, x - 1, x)),
            'total', s.total div array_max(s.n) * (array_max(s.n) - 1)),
          s), s -> s.n)"""
    return gathered.select("qid", F.posexplode(F.expr(steps)).alias("leg", "keep"))


def combine(
    leg_pool: DataFrame, points: DataFrame, ready: Prepared, crossroads_only: bool = True, limit: int | None = None
) -> DataFrame:
    """One candidate per leg, stitched and scored.

    All combinations are made unless the caller sets a ``limit`` (``MAX_LEG_COMBINATIONS`` is
    the customary one); ``trimmed`` tells which trips it left without some.

    ``leg_pool(qid, leg, slot, stops, runs, hhi, length)``. The trip's concentration is the
    mean of its legs', weighted by length; its tier is read off the whole chain.
    """
    if limit is None:
        kept, trimmed = leg_pool, None
    else:
        sizes = leg_pool.groupBy("qid", "leg").agg(F.count("*").alias("n"))
        keep = trim_sizes(sizes, limit)
        kept = leg_pool.join(keep, ["qid", "leg"]).where("slot < keep")
        trimmed = keep.join(sizes, ["qid", "leg"]).groupBy("qid").agg(F.max(F.expr("keep < n")).alias("trimmed"))
    part = F.struct("slot", "stops", "runs", "hhi", "length")
    legs = cut(kept.select("qid", "leg", part.alias("part")), "legs")
    last = legs.groupBy("qid").agg(F.max("leg").alias("last"))
    whole = legs.where("leg = 0").select("qid", F.array("part").alias("parts"))
    count = last.agg(F.max("last")).first()[0] or 0
    done = None
    for number in range(count + 1):
        if number:
            grown = whole.join(legs.where(F.col("leg") == number), "qid").select(
                "qid", F.concat("parts", F.array("part")).alias("parts")
            )
            whole = grown
        ended = whole.join(last.where(F.col("last") == number).select("qid"), "qid", "left_semi")
        done = ended if done is None else done.unionByName(ended)
    chains = cut(
        done.select(
            "qid",
            F.concat_ws("-", F.transform("parts", lambda p: p["slot"].cast("string"))).alias("cid"),
            F.expr(
                "flatten(transform(parts, (p, i) -> if(i = 0, p.stops, slice(p.stops, 2, size(p.stops) - 1))))"
            ).alias("stops"),
            F.expr("flatten(transform(parts, p -> p.runs))").alias("flat"),
            F.expr("transform(parts, p -> named_struct('hops', size(p.stops) - 1, 'hhi', p.hhi, 'n', size(p.runs), 'length', p.length))").alias("spans"),
        ),
        "combined",
    )
    key = ["qid", "cid"]
    on = mk.on_route_spans(memberships(chains, ready.net.edges, key), key)
    ridden = mk.ridden_marks(chains, on, ready.net.marks, key)
    runs = (
        chains.select(*key, F.posexplode("flat").alias("run", "r"))
        .select(*key, "run", "r.route_id", "r.length", "r.hops", "r.start_place", "r.end_place")
        .withColumn(
            "last",
            F.sum("hops").over(Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("first", F.col("last") - F.col("hops"))
    )
    stamped = (
        mk.stamp_runs(runs, ridden, key)
        .groupBy(*key)
        .agg(
            F.expr(
                "transform(array_sort(collect_list(struct(run, route_id, length, hops, priority, start_place, end_place))),"
                " e -> struct(e.route_id, e.length, e.hops, e.priority, e.start_place, e.end_place))"
            ).cast(RUNS_TYPE).alias("runs")
        )
    )
    c_min = se.point_distance(points, ready.net, ready.rail, crossroads_only).select("qid", "c_min")
    total = "aggregate(spans, 0L, (s, p) -> s + p.length)"
    record = (
        chains.join(stamped, key)
        .join(chain_lengths(chains, ready.net.degree, key, crossroads_only), key)
        .join(c_min, "qid", "left")
        .withColumn("length", F.expr(total))
        .withColumn(
            "hhi",
            F.expr(
                "if(length > 0, aggregate(spans, 0D, (s, p) -> s + p.length / length * p.hhi),"
                " aggregate(spans, 0D, (s, p) -> s + p.hhi) / size(spans))"
            ),
        )
    )
    record = record.withColumn("trimmed", F.lit(False)) if trimmed is None else record.join(trimmed, "qid")
    return record.select(
        *key,
        "stops",
        "runs",
        "length",
        "hhi",
        "trimmed",
        F.expr("array_sort(array_distinct(filter(transform(runs, r -> r.route_id), r -> r >= 0)))").alias("route_ids"),
        F.aggregate("runs", F.lit(BEST_PRIORITY), lambda s, r: F.greatest(s, r["priority"])).alias("priority"),
        "crossroad_hops",
        (F.size("stops") - 1).alias("total_hops"),
        F.expr("size(array_distinct(filter(transform(runs, r -> r.route_id), r -> r >= 0)))").alias("route_count"),
        F.coalesce("c_min", F.lit(0)).alias("c_min"),
        ranking_score(F.col("hhi"), F.coalesce("c_min", F.lit(0)), F.col("crossroad_hops")).alias("q"),
        path_edges(F.col("stops")).alias("edges"),
        F.expr(
            "transform(spans, (p, i) -> named_struct("
            "'start_index', aggregate(slice(spans, 1, i), 0, (s, x) -> s + x.hops),"
            "'end_index', aggregate(slice(spans, 1, i + 1), 0, (s, x) -> s + x.hops),"
            "'hhi', p.hhi,"
            "'priority', aggregate(slice(runs, cast(aggregate(slice(spans, 1, i), 0, (s, x) -> s + x.n) as int) + 1, p.n), 0, (s, r) -> greatest(s, r.priority)),"
            "'runs', slice(runs, cast(aggregate(slice(spans, 1, i), 0, (s, x) -> s + x.n) as int) + 1, p.n)))"
        ).alias("legs"),
    )


def one_leg(pool: DataFrame) -> DataFrame:
    """A plain trip's single leg: the whole chain."""
    return pool.withColumn(
        "legs",
        F.array(
            F.struct(
                F.lit(0).alias("start_index"),
                F.col("total_hops").alias("end_index"),
                "hhi",
                "priority",
                "runs",
            )
        ),
    )


def leg_candidates(
    trips: DataFrame, ready: Prepared, crossroads_only: bool = True, most_optimized: int | None = None, **search
) -> tuple[DataFrame, DataFrame]:
    """``points(qid, points)`` and the selected candidates of every leg; ``search`` goes to
    :func:`candidate_pool`."""
    points = cut(best_order(trips, ready, most_optimized).select("qid", "points"), "points")
    legs = cut(leg_trips(points), "legs")
    asked = legs.select(F.col("lid").alias("qid"), "start_place", "end_place", "banned")
    pool = candidate_pool(asked, ready, crossroads_only, **search)
    chosen = select_diverse(pool).withColumnRenamed("qid", "lid")
    return points, cut(
        chosen.join(legs.select("lid", "qid", "leg"), "lid").select(
            "qid", "leg", "slot", "stops", "runs", "hhi", "length"
        ),
        "leg_pool",
    )


def via_pool(
    trips: DataFrame,
    ready: Prepared,
    crossroads_only: bool = True,
    most_optimized: int | None = None,
    most_combinations: int | None = None,
    **search,
) -> DataFrame:
    """The pool of trips ``(qid, start_place, end_place, via)`` with at least one stop."""
    known = ready.net.degree.select("place")
    cleaned = normalise_via(trips)
    every = cleaned.select("qid", F.explode(F.concat(F.array("start_place", "end_place"), "via")).alias("place"))
    missing = every.join(known, "place", "left_anti").select("qid").distinct()
    asked = cut(cleaned.join(missing, "qid", "left_anti").where(F.size("via") > 0), "via")
    points, pool = leg_candidates(asked, ready, crossroads_only, most_optimized, **search)
    return cut(combine(pool, points, ready, crossroads_only, most_combinations), "via_pool")


def find_routes(
    trips: DataFrame, ready: Prepared, k: int | None = 3, crossroads_only: bool = True,
    hard_tier: bool = True, closed: DataFrame | None = None,
    most_optimized: int | None = None, most_combinations: int | None = None, **search,
) -> DataFrame:
    """Up to ``k`` diverse routes for every trip ``(qid, start_place, end_place, via)``.

    Bounds on the work are the caller's: ``most_optimized`` stops to reorder, ``most_combinations``
    of leg candidates, and what :func:`candidate_pool` takes.
    """
    trips = cut(normalise_via(trips.select("qid", "start_place", "end_place", "via")), "trips")
    plain, via = together(
        lambda: candidate_pool(trips.where(F.size("via") == 0).drop("via"), ready, crossroads_only, **search),
        lambda: via_pool(
            trips.where(F.size("via") > 0), ready, crossroads_only, most_optimized, most_combinations, **search
        ),
    )
    direct = select_diverse(one_leg(plain), k, hard_tier=hard_tier, closed=closed)
    through = select_diverse(via, k, WAYPOINT_MAX_STRETCH, hard_tier=hard_tier, closed=closed)
    return _together(direct, through)


def _together(direct: DataFrame, through: DataFrame) -> DataFrame:
    names = [
        "qid", "slot", "cid", "stops", "runs", "hhi", "q", "priority", "length", "route_ids",
        "route_count", "crossroad_hops", "total_hops", "legs",
    ]
    return direct.select(*names).unionByName(through.select(*names))


def chains_only(routes: DataFrame) -> DataFrame:
    """Just the stop chains."""
    return routes.select("qid", "slot", "stops")

