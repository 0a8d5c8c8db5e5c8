"""Candidate chains for many trips at once (H2-H12) and their ranking.

A *profile* is one way of charging edges: plain, riding one artery, riding two, keeping
to a rating, avoiding edges already used. Every profile of every trip in both
directions is one row of the search table, so a wave of profiles is one search job.

The number of artery profiles is cut exactly. Let ``D`` be the cost when every edge is
charged (the *generic* profile). Favouring artery ``r`` changes the answer only if some
way uses an edge of ``r``, and such a way costs at least ``D(s, a) + D(b, t)`` less one
transfer for places ``a, b`` of ``r``. Arteries above ``D(s, t)`` share the generic answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import (
    BEST_PRIORITY,
    DIVERSITY_ROUNDS,
    PAIR_SEED_ARTERIES,
    TRANSFER_WEIGHT,
    canonical,
    is_crossroad_expr,
    path_edges,
)
from waymesh.operators import marks as mk
from waymesh.operators import search as se
from waymesh.operators import within as wi
from waymesh.operators.insights import place_components
from waymesh.operators.score import RUNS_TYPE, Network, ranking_score, score
from waymesh.session import cut, retire, together

T = TRANSFER_WEIGHT


@dataclass(frozen=True)
class Prepared:
    """A network made ready for search, shared by every wave and every query batch."""

    net: Network
    rail: DataFrame
    route_edges: DataFrame  # route_id, a, b
    priorities: DataFrame  # a, b, priority, only rated edges
    floors: DataFrame  # route_id, floor
    ban: int
    worst: int
    routes: int
    totals: dict[int, int]  # floor -> routes


@dataclass(frozen=True)
class Whole:
    """Counts of a network of which :func:`prepare` is given whole components."""

    places: int
    worst: int
    totals: dict[int, int]  # floor -> routes with an edge


def prepare(net: Network, section: int = se.SECTION, comp: DataFrame | None = None, whole: Whole | None = None) -> Prepared:
    """The search view of a network, with landmarks. Only counts reach the driver.

    ``net`` may be some components of a network, all of whose places, edges and marks are there; ``whole`` then
    counts the whole network. ``comp(place, component)`` are its components, if they are known.
    """
    prio = cut(mk.edge_priority(net.edges, mk.marked_edges(net.stops, net.marks)), "ratings")
    if comp is None:
        comp = place_components(net.edges, net.degree.where("degree = 0"))  # the others are ends of edges
    rail = cut(se.with_areas(se.rails(net, section, prio=prio), comp), "rail")
    large = rail.where("area is null")
    # Landmarks lead the rounds; a search that one task settles needs none.
    busy = net.degree.join(large.select("place").distinct(), "place", "left_semi")
    if not busy.where("degree > 0").isEmpty():
        bare = rail
        rail = cut(se.with_landmarks(bare, se.landmarks(large, busy)), "rail")
        retire(bare)
    floors = (
        net.edges.select("route_id").distinct()
        .join(mk.route_priority(net.marks), "route_id", "left")
        .select("route_id", F.coalesce("priority", F.lit(0)).alias("floor"))
    )
    floors = cut(floors, "floors")
    if whole is None:
        counted = floors.groupBy("floor").agg(F.count("*").alias("n")).collect()
        whole = Whole(net.degree.count(), mk.worst_priority(net.marks).first()["worst"], {r.floor: r.n for r in counted})
    return Prepared(
        net,
        rail,
        net.edges,
        cut(prio.where("priority > 0"), "prio"),
        floors,
        T * (whole.places + 1),
        whole.worst,
        sum(whole.totals.values()),
        whole.totals,
    )


def both_ways(trips: DataFrame) -> DataFrame:
    """H9: each trip forwards and backwards: ``(qid, dir, src, dst, banned)``."""
    fore = trips.select(
        "qid", F.lit(0).alias("dir"), F.col("start_place").alias("src"), F.col("end_place").alias("dst"), "banned"
    )
    back = trips.select(
        "qid", F.lit(1).alias("dir"), F.col("end_place").alias("src"), F.col("start_place").alias("dst"), "banned"
    )
    return fore.unionByName(back)


def _profile(ends: DataFrame, ready: Prepared, kind: str, name: Column | None = None, tier=None, **cost) -> DataFrame:
    parts = [F.col("qid"), F.col("dir").cast("string"), F.lit(kind)]
    if name is not None:
        parts.append(name)
    return se.plain_searches(
        ends.withColumn("kind", F.lit(kind)),
        F.concat_ws("|", *parts),
        ban=ready.ban,
        banned=F.col("banned"),
        tier=tier,
        **cost,
    )


KEEP = ["qid", "dir", "kind", "sid", *se.PARAMS]


def _run(profiles: list[DataFrame], ready: Prepared, deltas: DataFrame | None = None):
    """One wave: all profiles as one search. Returns searches, labels and chains."""
    wave = profiles[0].select(*KEEP)
    for more in profiles[1:]:
        wave = wave.unionByName(more.select(*KEEP))
    wave = cut(wave, "wave")
    if deltas is not None:
        deltas = cut(deltas, "deltas")
    labels = se.search(wave, ready.rail, deltas)
    chains = se.chains_of(se.found(labels, wave), ready.net.stops, wave)
    return wave, labels, cut(
        chains.join(wave.select("sid", "qid", "dir", "kind"), "sid").select("qid", "dir", "kind", "sid", "cost", "stops"),
        "chains",
    )


def relevant_arteries(wave: DataFrame, labels: DataFrame, ready: Prepared, kind: str) -> DataFrame:
    """Arteries that can change the answer of the generic profile ``kind``, per trip and
    direction: ``(qid, dir, route_id)``."""
    own = labels.where("through is null").join(
        wave.where(F.col("kind") == kind).select("sid", "qid", "dir", "src", "dst"), "sid"
    )
    hop = ready.net.degree.select("place", is_crossroad_expr("degree").alias("hop"))
    own = own.join(hop, "place", "left").select("qid", "dir", "src", "dst", "place", "cost", F.coalesce("hop", F.lit(0)).alias("hop"))
    target = own.where("place = dst").select("qid", "dir", F.col("cost").alias("d"), F.col("hop").alias("hop_t"))
    leave = own.select(
        "qid", "dir", "place", (F.col("cost") + F.when(F.col("place") == F.col("src"), T).otherwise(0)).alias("f")
    )
    # The search from the other end measures the way on from here: entering costs sit on
    # the far end instead of the near one.
    arrive = own.select(
        "qid", (1 - F.col("dir")).alias("dir"), "place", "cost", "hop", F.col("src").alias("goal")
    ).join(target, ["qid", "dir"]).select(
        "qid",
        "dir",
        "place",
        "d",
        F.when(F.col("place") == F.col("goal"), 0)
        .otherwise(F.col("cost") + F.col("hop_t") - F.col("hop") - T)
        .alias("g"),
    )
    on = ready.net.stops.select("route_id", "place")
    first = leave.join(on, "place").groupBy("qid", "dir", "route_id").agg(F.min("f").alias("f"))
    last = arrive.join(on, "place").groupBy("qid", "dir", "route_id", "d").agg(F.min("g").alias("g"))
    return first.join(last, ["qid", "dir", "route_id"]).where("f + g <= d").select("qid", "dir", "route_id")


def _exempt(profiles: DataFrame, ready: Prepared, *columns: str) -> DataFrame:
    """H2: the edges of the favoured arteries are not charged."""
    rows = None
    for column in columns:
        part = profiles.select("sid", F.col(column).alias("route_id")).join(ready.route_edges, "route_id").select("sid", "a", "b")
        rows = part if rows is None else rows.unionByName(part)
    return se.edge_deltas(rows, -T)


def _used(chains: DataFrame) -> DataFrame:
    """The edges of chains per trip and direction."""
    return chains.select("qid", "dir", F.explode(path_edges(F.col("stops"))).alias("e")).select("qid", "dir", "e.a", "e.b")


def crossing(chains: DataFrame, ready: Prepared, key: list[str]) -> DataFrame:
    """The worst edge rating on each chain: ``(key..., forced)``."""
    return (
        mk.chain_hops(chains, key)
        .join(ready.priorities, ["a", "b"])
        .groupBy(*key)
        .agg(F.max("priority").alias("forced"))
    )


def generate(trips: DataFrame, ready: Prepared, diversity: int = DIVERSITY_ROUNDS) -> DataFrame:
    """Candidate chains of ``trips(qid, start_place, end_place, banned)``:
    ``(qid, cid, stops)``, each corridor once, read from start to end."""
    ends = cut(both_ways(trips), "ends")
    tiers = range(ready.worst)

    first = [_profile(ends, ready, "plain"), _profile(ends, ready, "generic", step=T, slack=T)]
    first += [_profile(ends, ready, f"tier{t}", tier=F.lit(t)) for t in tiers]
    wave, labels, pool = _run(first, ready)
    kept = cut(relevant_arteries(wave, labels, ready, "generic"), "kept")
    pools = [pool.where("kind <> 'generic'")]
    generic = pool.where("kind = 'generic'")
    # The generic answer stands for every artery that was not searched for.
    asked = kept.groupBy("qid", "dir").agg(F.count("*").alias("n"))
    pools.append(
        generic.join(asked, ["qid", "dir"], "left").where(F.coalesce("n", F.lit(0)) < ready.routes).drop("n")
    )

    plain = pool.where("kind = 'plain'")
    used = [_used(plain)]
    found_so_far = [plain]

    def diverse(number: int) -> tuple[DataFrame, DataFrame]:
        alive = ends.join(found_so_far[-1].select("qid", "dir"), ["qid", "dir"], "left_semi")
        again = _profile(alive, ready, f"again{number}")
        spent = used[0]
        for more in used[1:]:
            spent = spent.unionByName(more)
        costs = se.edge_deltas(
            spent.join(again.select("qid", "dir", "sid"), ["qid", "dir"]).select("sid", "a", "b"), T
        )
        return again, costs

    def note(pool_rows: DataFrame, number: int) -> None:
        rows = pool_rows.where(F.col("kind") == f"again{number}")
        found_so_far.append(rows)
        used.append(_used(rows))

    def by_artery() -> list[DataFrame]:
        got: list[DataFrame] = []
        favoured = cut(
            _profile(ends.join(kept, ["qid", "dir"]), ready, "ride", F.col("route_id").cast("string"), step=T),
            "favoured",
        )
        second = [favoured]
        second += [_profile(ends, ready, f"generic{t}", step=T, slack=T, tier=F.lit(t)) for t in tiers]
        wave2, labels2, pool2 = _run(second, ready, _exempt(favoured, ready, "route_id"))
        got.append(pool2.where("kind = 'ride'"))
        if ready.worst:
            searches, exempt = _floored(ends, kept, favoured, generic, wave2, labels2, pool2, got, ready)
            got.append(_run([searches], ready, exempt)[2])
        return got

    def by_detour() -> list[DataFrame]:
        got: list[DataFrame] = []
        for number in range(2, diversity + 1):
            again, costs = diverse(number)
            rows = _run([again], ready, costs)[2]
            note(rows, number)
            got.append(rows)
        return got

    for rows in together(by_artery, by_detour):
        pools += rows

    out = None
    for rows in pools:
        part = rows.select("qid", "dir", "sid", "stops")
        out = part if out is None else out.unionByName(part)
    return dedup(out)


def _floored(ends, kept, favoured, generic, wave2, labels2, pool2, pools, ready):
    """H7: an artery again, now avoiding edges that can only be driven as something worse
    than it, where its first chain crosses such an edge."""
    rode = (
        pool2.where("kind = 'ride'")
        .join(favoured.select("sid", "route_id"), "sid")
        .select("qid", "dir", "route_id", "stops")
    )
    forced = crossing(rode, ready, ["qid", "dir", "route_id"])
    again = rode.drop("stops").join(forced, ["qid", "dir", "route_id"]).join(ready.floors, "route_id").where("forced > floor")
    generic_forced = crossing(generic, ready, ["qid", "dir"])
    near = None
    for t in range(ready.worst):
        part = relevant_arteries(wave2, labels2, ready, f"generic{t}").withColumn("floor", F.lit(t))
        near = part if near is None else near.unionByName(part)
    near = cut(near.join(ready.floors, ["route_id", "floor"], "left_semi"), "near")
    # Searched arteries whose own chain crosses, and unsearched ones (they stand behind
    # the generic chain) near enough for the floor to matter.
    behind = (
        near.join(kept, ["qid", "dir", "route_id"], "left_anti")
        .join(generic_forced, ["qid", "dir"])
        .where("forced > floor")
    )
    chosen = cut(
        again.select("qid", "dir", "route_id", "floor")
        .join(near.select("qid", "dir", "route_id"), ["qid", "dir", "route_id"], "left_semi")
        .unionByName(behind.select("qid", "dir", "route_id", "floor")),
        "chosen",
    )
    # Everyone else who would be searched again shares the floored generic answer.
    far_again = again.join(near, ["qid", "dir", "route_id"], "left_anti").select("qid", "dir", "floor").distinct()
    per_floor = ready.floors.sparkSession.createDataFrame(list(ready.totals.items()), "floor int, total long")
    close = (
        near.select("qid", "dir", "route_id", "floor")
        .unionByName(kept.join(ready.floors, "route_id").select("qid", "dir", "route_id", "floor"))
        .distinct()
        .groupBy("qid", "dir", "floor")
        .agg(F.count("*").alias("n"))
    )
    levels = generic_forced.select("qid", "dir", F.explode(F.sequence(F.lit(0), F.col("forced") - 1)).alias("floor"))
    far_behind = (
        levels.join(per_floor, "floor")
        .join(close, ["qid", "dir", "floor"], "left")
        .where("total > coalesce(n, 0)")
        .select("qid", "dir", "floor")
    )
    shared = far_again.unionByName(far_behind).distinct().withColumn("kind", F.concat(F.lit("generic"), F.col("floor")))
    pools.append(pool2.join(shared.select("qid", "dir", "kind"), ["qid", "dir", "kind"], "left_semi"))
    searches = cut(
        _profile(
            ends.join(chosen, ["qid", "dir"]).withColumnRenamed("floor", "keep"),
            ready,
            "floor",
            F.col("route_id").cast("string"),
            tier=F.col("keep"),
            step=T,
        ),
        "floored",
    )
    return searches, _exempt(searches, ready, "route_id")


def dedup(rows: DataFrame) -> DataFrame:
    """Chains read from start to end, each edge set once. A chain found by search
    repeats no place, so equal edge sets between the same ends are equal chains."""
    facing = rows.withColumn("stops", F.when(F.col("dir") == 1, F.reverse("stops")).otherwise(F.col("stops")))
    return (
        facing.where(F.size("stops") >= 2)
        .groupBy("qid", "stops")
        .agg(F.min(F.struct("dir", "sid")).alias("first"))
        .select("qid", F.col("first.sid").alias("cid"), "stops")
    )


def rank_struct(*front: Column) -> Column:
    """The order of a pool as one comparable value, smallest first."""
    return F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate(front)],
        (-F.col("q")).alias("neg_q"),
        F.col("route_count"),
        F.col("crossroad_hops"),
        F.col("total_hops"),
        canonical(F.col("stops")).alias("canon"),
    )


def with_rank(scored: DataFrame, c_min: DataFrame) -> DataFrame:
    """Scored candidates with ``c_min``, ``q`` and ``edges``."""
    return scored.join(c_min, "qid", "left").select(
        "*",
        ranking_score(F.col("hhi"), F.coalesce("c_min", F.lit(0)), F.col("crossroad_hops")).alias("q"),
        path_edges(F.col("stops")).alias("edges"),
    )


def standing(still: DataFrame, ready: Prepared, crossroads_only: bool) -> DataFrame:
    """:func:`score` of chains of one stop ``(qid, cid, stops)``."""
    at = ready.net.degree.select(F.col("place").alias("at"), is_crossroad_expr("degree").cast("long").alias("x"))
    return still.join(at, still["stops"][0] == at["at"]).select(
        "qid",
        "cid",
        "stops",
        F.expr(f"cast(array() as {RUNS_TYPE})").alias("runs"),
        F.lit(0).cast("long").alias("length"),
        F.lit(1.0).alias("hhi"),
        F.expr("cast(array() as array<bigint>)").alias("route_ids"),
        F.lit(BEST_PRIORITY).alias("priority"),
        (F.col("x") if crossroads_only else F.lit(0).cast("long")).alias("crossroad_hops"),
        F.lit(0).alias("total_hops"),
        F.lit(0).alias("route_count"),
    )


def leading_arteries(pool: DataFrame, limit: int = PAIR_SEED_ARTERIES) -> DataFrame:
    """The arteries of the longest runs of the best candidates, the first ``limit``
    different ones: ``(qid, place_in_line, artery)``."""
    longest = F.array_max(
        F.transform("runs", lambda r, i: F.struct(r["length"].alias("l"), (-i).alias("i"), r["route_id"].alias("r")))
    )["r"]
    best = (
        pool.where(F.size("runs") > 0)
        .select("qid", longest.alias("artery"), rank_struct().alias("k"))
        .groupBy("qid", "artery")
        .agg(F.min("k").alias("k"))
    )
    line = Window.partitionBy("qid").orderBy("k", "artery")
    return best.withColumn("place_in_line", F.row_number().over(line)).where(
        F.col("place_in_line") <= limit
    ).select("qid", "place_in_line", "artery")


def seed_pairs(pool: DataFrame, seed_arteries: int = PAIR_SEED_ARTERIES) -> DataFrame:
    """The first ``seed_arteries`` arteries two by two: ``(qid, r1, r2)``."""
    seeds = cut(leading_arteries(pool, seed_arteries), "seeds")
    return seeds.alias("x").join(seeds.alias("y"), "qid").where("x.place_in_line < y.place_in_line").select(
        "qid", F.col("x.artery").alias("r1"), F.col("y.artery").alias("r2")
    )


def pair_chains(trips: DataFrame, pairs: DataFrame, ready: Prepared) -> DataFrame:
    """Chains favouring the two arteries of a pair together."""
    profiles = cut(
        _profile(
            both_ways(trips).join(pairs, "qid"), ready, "pair", F.concat_ws("+", "r1", "r2"), step=2 * T
        ),
        "pairs",
    )
    _, _, rows = _run([profiles], ready, _exempt(profiles, ready, "r1", "r2"))
    return dedup(rows)


def candidate_pool(
    trips: DataFrame,
    ready: Prepared,
    crossroads_only: bool = True,
    diversity: int = DIVERSITY_ROUNDS,
    seed_arteries: int = PAIR_SEED_ARTERIES,
) -> DataFrame:
    """The scored pool of every trip ``(qid, start_place, end_place[, banned])``.

    ``diversity`` rounds look for detours, and pairs of the first ``seed_arteries`` arteries
    are tried together: parameters of the search, not bounds on what is kept.

    A trip from a place to itself is the place alone; a trip with an end the network does
    not know, or with no way between its ends, has no rows (I8).
    """
    if "banned" not in trips.columns:
        trips = trips.withColumn("banned", F.expr("cast(array() as array<bigint>)"))
    trips = cut(trips.select("qid", "start_place", "end_place", "banned"), "trips")
    moving = trips.where("start_place <> end_place")
    still = trips.where("start_place = end_place").join(
        ready.net.degree.select(F.col("place").alias("start_place")), "start_place", "left_semi"
    ).select("qid", F.lit("still").alias("cid"), F.array("start_place").alias("stops"))
    at = ready.rail.join(moving.select(F.col("start_place").alias("place")).distinct(), "place", "left_semi")
    at = at.groupBy(F.col("place").alias("start_place")).agg(F.first("area").alias("area"))
    placed = cut(moving.join(at, "start_place"), "placed")
    inside, outside = placed.where("area is not null"), placed.where("area is null").drop("area")
    rounds = not outside.isEmpty()
    settled = cut(
        wi.generate_within(
            inside, ready.rail, ready.net.marks, ready.ban, ready.worst, ready.routes, ready.totals, diversity, crossroads_only
        ),
        "candidates",
    )
    scored = settled.where("cid is not null").select(*wi.SCORED).unionByName(standing(still, ready, crossroads_only))
    c_min = settled.where("cid is null").select("qid", "c_min")
    if rounds:
        ends = outside.select("qid", F.array("start_place", "end_place").alias("points"))
        measured, chains = together(
            lambda: cut(
                se.point_distance(ends, ready.net, ready.rail, crossroads_only).select("qid", "c_min"), "c_min"
            ),
            lambda: cut(generate(outside, ready, diversity), "candidates"),
        )
        scored = scored.unionByName(score(chains, ready.net, ["qid", "cid"], crossroads_only))
        c_min = c_min.unionByName(measured)
    pool = cut(with_rank(scored, c_min), "pool")
    pairs = cut(seed_pairs(pool, seed_arteries), "pairs")
    listed = pairs.groupBy("qid").agg(F.collect_list(F.struct("r1", "r2")).alias("pairs"))
    known = pool.select("qid", "stops")
    paired = wi.pairs_within(inside.join(listed, "qid"), ready.rail, ready.net.marks, ready.ban, crossroads_only)
    extra = paired.join(known, ["qid", "stops"], "left_anti")
    if rounds:
        fresh = cut(pair_chains(outside, pairs, ready).join(known, ["qid", "stops"], "left_anti"), "extra")
        extra = extra.unionByName(score(fresh, ready.net, ["qid", "cid"], crossroads_only))
    return cut(pool.unionByName(with_rank(extra, c_min)), "pool")


def ranked(pool: DataFrame) -> DataFrame:
    """The pool with its rank per trip."""
    line = Window.partitionBy("qid").orderBy(rank_struct(), "cid")
    return pool.withColumn("rank", F.row_number().over(line))


