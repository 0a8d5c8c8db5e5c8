"""Batch cheapest-way search by rides.

A search asks for the cheapest chain from one place to another, where every change of
route costs ``transfer``, entering a crossroad costs ``hop_weight`` and every edge may
carry additive costs. All costs are whole numbers of at least 0, so the cheapest walk
never revisits a place: cutting a loop out of it saves at least what it adds. Labels are
therefore kept per place, and one round extends every improved label by one *ride*: any
stretch of one route, in either direction. Along a route the best place to board is a
running minimum, so a round is linear in the stops of the routes it touches, and the
number of rounds is the number of rides in the answer, not its number of hops.

A round writes its *frontier* alone: the labels it improved, each once. What is settled is read
from the frontiers so far and never written again. Landmarks (:func:`landmarks`) keep the frontier
near the answer: rides are counted alike from either end, so places that differ in rides to a
landmark are at least so many rides apart, and a way past a landmark is a first bound on the cost
before any way is found. Ends that a landmark tells apart have no way at all.

``searches`` columns:

=============  ==================================================================
``sid``        name of the search
``src, dst``   ends; ``dst`` null explores everything reachable
``transfer``   cost of boarding a route
``hop_weight`` cost of entering a crossroad
``step``       cost of every edge
``tier``       edges whose best rating is worse than this cost ``ban``; null: none
``banned``     edges at these places cost ``ban``
``ban``        the cost above
``slack``      how far beyond the cost at ``dst`` labels are still wanted
=============  ==================================================================

``deltas(sid, a, b, delta)`` adds to single edges.

A round is ten shuffles, however little it moves. Where :func:`with_areas` named the small components of the
network, a search inside one is settled by one task (:func:`settled_within`) with the same rounds; its rows are
bounded by ``SMALL``. All other searches go by the rounds above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import TRANSFER_WEIGHT, is_crossroad_expr
from waymesh.operators import marks as mk
from waymesh.operators.network import in_blocks
from waymesh.operators.score import Network
from waymesh.session import NotConverged, cut, retire, written

# Routes longer than this are ridden section by section; a rider stays on board where
# two sections meet. It bounds the rows one task sorts, not what is found.
SECTION = 2048
#: Busiest places that every place's rides are counted from.
LANDMARKS = 4
MARKS = "array<struct<r:bigint,h:bigint>>"
#: Stops of a component, each time a route passes one, up to which its searches are settled by one task.
SMALL = 4096
#: Weight of a ride against hops when landmarks are measured: no way has so many hops.
RIDE_WEIGHT = 1 << 40
PARAMS = ["src", "dst", "transfer", "hop_weight", "step", "tier", "banned", "ban", "slack"]


def rails(net: Network, section: int = SECTION, bare: DataFrame | None = None, prio: DataFrame | None = None) -> DataFrame:
    """The stops as the search reads them: ``(route_id, sec, pos, place, hop, a, b, prio,
    joint)`` where ``a, b, prio`` describe the edge from the stop before in the section.

    H6: ``bare(a, b)`` are edges no route carries; each becomes a route of its own. ``prio`` are the
    edge ratings, if they are there already.
    """
    stops = net.stops.select("route_id", F.col("pos").cast("int").alias("pos"), "place")
    if bare is not None:
        own = bare.select("a", "b", (-F.monotonically_increasing_id() - 1).alias("route_id"))
        own = cut(own, "bare")
        stops = stops.unionByName(
            own.select("route_id", F.posexplode(F.array("a", "b")).alias("pos", "place"))
        )
    if prio is None:
        prio = mk.edge_priority(net.edges, mk.marked_edges(net.stops, net.marks))
    along = Window.partitionBy("route_id", "block").orderBy("pos")
    before = F.lag("place").over(along)
    cutup = (
        in_blocks(stops, 1, section)
        .withColumn("before", before)
        .select(
            "route_id",
            F.col("block").cast("int").alias("sec"),
            "pos",
            "place",
            F.least("before", "place").alias("a"),
            F.greatest("before", "place").alias("b"),
            ((F.col("pos") > 0) & (F.col("pos") % section == 0)).alias("joint"),
        )
    )
    return (
        cutup.join(net.degree, "place", "left")
        .join(prio.withColumnRenamed("priority", "prio"), ["a", "b"], "left")
        .select(
            "route_id",
            "sec",
            "pos",
            "place",
            F.coalesce(is_crossroad_expr("degree"), F.lit(0)).alias("hop"),
            "a",
            "b",
            F.coalesce("prio", F.lit(0)).alias("prio"),
            "joint",
            F.lit(None).cast(MARKS).alias("marks"),
            F.lit(None).cast("long").alias("area"),
        )
    )


def with_areas(rail: DataFrame, comp: DataFrame, small: int = SMALL) -> DataFrame:
    """``rail`` with ``area``, the component of a place if its routes have at most ``small`` stops in all and
    none goes on in another section; else null. ``comp(place, component)``."""
    known = rail.drop("area").join(comp, "place", "left")
    sizes = known.groupBy("component").agg(F.count("*").alias("n"), F.max("joint").alias("joined"))
    areas = sizes.where(F.col("n") <= small).where("not joined").select("component", F.col("component").alias("area"))
    return known.join(areas, "component", "left").select(rail.columns)


def landmarks(rail: DataFrame, degree: DataFrame, count: int = LANDMARKS) -> DataFrame:
    """``(place, marks)``: for each of the ``count`` busiest places, the fewest rides ``r`` to it and
    the fewest hops ``h`` of these; null where there is no way."""
    line = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "place")
    hubs = degree.where("degree > 0").orderBy(F.desc("degree"), "place").limit(count)
    hubs = hubs.select(F.col("place").alias("src"), F.lit(None).cast("long").alias("dst"), F.row_number().over(line).alias("i"))
    probes = cut(plain_searches(hubs, F.col("i").cast("string"), transfer=RIDE_WEIGHT, hop_weight=0, step=1), "hubs")
    labels = search(probes, rail).where("through is null")
    weight = F.lit(RIDE_WEIGHT)
    mark = F.struct(F.floor(F.col("cost") / weight).cast("long").alias("r"), F.pmod("cost", weight).alias("h"))
    gathered = labels.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sid").cast("int"), mark))).alias("m"))
    return gathered.select("place", F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.try_element_at("m", i)).cast(MARKS).alias("marks"))


def with_landmarks(rail: DataFrame, marks: DataFrame) -> DataFrame:
    """``rail`` with the marks of its places, which every search over it then uses."""
    known = rail.drop("marks").join(marks, "place", "left")
    nowhere = F.array_repeat(F.lit(None).cast("struct<r:bigint,h:bigint>"), LANDMARKS)
    return known.withColumn("marks", F.coalesce("marks", nowhere)).select(rail.columns)


def plain_searches(
    pairs: DataFrame,
    sid: Column,
    *,
    transfer: int = TRANSFER_WEIGHT,
    hop_weight: int = 1,
    step: int = 0,
    slack: int = 0,
    ban: int = 0,
    tier: Column | None = None,
    banned: Column | None = None,
) -> DataFrame:
    """``pairs(..., src, dst)`` as searches with the same parameters, extra columns kept."""
    none = F.lit(None)
    return pairs.select(
        *[c for c in pairs.columns if c not in PARAMS and c != "sid"],
        sid.alias("sid"),
        F.col("src").cast("long").alias("src"),
        F.col("dst").cast("long").alias("dst"),
        F.lit(transfer).cast("long").alias("transfer"),
        F.lit(hop_weight).cast("long").alias("hop_weight"),
        F.lit(step).cast("long").alias("step"),
        (none if tier is None else tier).cast("int").alias("tier"),
        (F.array() if banned is None else banned).cast("array<bigint>").alias("banned"),
        F.lit(ban).cast("long").alias("ban"),
        F.lit(slack).cast("long").alias("slack"),
    )


RIDE = "struct<route_id:bigint,p:int,q:int>"

# At least so many rides lie between places with these marks, however many landmarks know both.
_APART = "coalesce(array_max(zip_with({x}, {y}, (x, y) -> abs(x.r - y.r))), 0)"

# What is left to pay at a place, at least: a rider on board (joint) pays one ride less, and answers
# may end `slack` above the best.
def _rest(joint: str, place: str, marks: str) -> str:
    apart = _APART.format(x=marks, y="dmarks")
    return f"greatest(if({joint} OR {place} <=> dst, 0, transfer), transfer * ({apart} - int({joint})) - slack)"


# Where this round's riders board: labels the round before improved that can still
# lead to a wanted answer, at every position of their place on any route.
_BOARDS = f"""
WITH bound AS (
  SELECT s.sid, least(min(l.cost), any_value(s.first)) + any_value(s.slack) AS bound
  FROM {{searches}} s LEFT JOIN {{hits}} l ON l.sid = s.sid
  GROUP BY s.sid),
ahead AS (
  SELECT l.sid, r.route_id, r.sec, r.pos, r.hop * s.hop_weight AS own, l.place, l.through, r.marks,
         s.dst, s.dmarks, s.transfer, s.hop_weight, s.step, s.tier, s.banned, s.ban, s.slack, b.bound,
         l.cost, l.cost + if(l.through IS NULL, s.transfer, 0) AS board, l.rides
  FROM {{frontier}} l
  JOIN {{searches}} s ON l.sid = s.sid
  JOIN bound b ON l.sid = b.sid
  JOIN {{rail}} r ON l.place = r.place
  WHERE l.through IS NULL OR l.through = r.route_id)
SELECT sid, route_id, sec, pos, own, dst, dmarks, transfer, hop_weight, step, tier, banned, ban, slack, bound, board, rides
FROM ahead
WHERE bound IS NULL OR (board <= bound AND cost + {_rest("(through IS NOT NULL)", "place", "marks")} <= bound)
"""

# One round. `f` is the cost of riding from the section's first stop up to and into a
# stop, `g` the same without entering it, so a ride from p on to q costs f(q) - f(p) and
# a ride from p back to q costs g(p) - g(q).
_ROUND = """
WITH scope AS (
  SELECT sid, route_id, sec, any_value(dst) AS dst, any_value(dmarks) AS dmarks, any_value(transfer) AS transfer,
         any_value(hop_weight) AS hop_weight, any_value(step) AS step, any_value(tier) AS tier,
         any_value(banned) AS banned, any_value(ban) AS ban, any_value(slack) AS slack, any_value(bound) AS bound
  FROM {boards} GROUP BY sid, route_id, sec),
line AS (
  SELECT c.sid, c.route_id, c.sec, r.pos, 0 AS kind, r.place, r.joint, c.dst, c.transfer, c.bound,
         """ + _rest("r.joint", "r.place", "r.marks") + """ AS rest,
         r.hop * c.hop_weight AS hop, r.hop * c.hop_weight AS own,
         if(r.a IS NULL, 0, c.step + {extra}
            + if(c.tier IS NOT NULL AND r.prio > c.tier, c.ban, 0)
            + if(array_contains(c.banned, r.a) OR array_contains(c.banned, r.b), c.ban, 0)) AS toll,
         CAST(NULL AS BIGINT) AS board, CAST(NULL AS array<""" + RIDE + """>) AS rides
  FROM scope c JOIN {rail} r ON c.route_id = r.route_id AND c.sec = r.sec {delta_join}
  UNION ALL
  SELECT sid, route_id, sec, pos, 1, NULL, false, dst, transfer, bound, 0, 0, own, 0, board, rides
  FROM {boards}),
ridden AS (
  SELECT *, sum(hop + toll) OVER onward AS f FROM line
  WINDOW onward AS (PARTITION BY sid, route_id, sec ORDER BY pos, kind
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (
  SELECT *,
         min(if(kind = 1, struct(board - f AS c, rides, pos AS p), NULL)) OVER onward AS fore,
         min(if(kind = 1, struct(board + f - own AS c, rides, pos AS p), NULL)) OVER back AS aft
  FROM ridden
  WINDOW onward AS (PARTITION BY sid, route_id, sec ORDER BY pos, kind
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         back AS (PARTITION BY sid, route_id, sec ORDER BY pos DESC, kind
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
reached AS (
  SELECT sid, place, place <=> dst AS at_end, route_id, joint, pos, rest, bound,
         explode(array(struct(f + fore.c AS cost, fore.rides AS rides, fore.p AS p),
                       struct(aft.c - f + own AS cost, aft.rides AS rides, aft.p AS p))) AS way
  FROM best WHERE kind = 0),
arrived AS (
  SELECT sid, place, at_end,
         explode(if(joint, array(CAST(NULL AS BIGINT), route_id), array(CAST(NULL AS BIGINT)))) AS through,
         way.cost AS cost,
         concat(way.rides, array(struct(route_id, way.p AS p, pos AS q))) AS rides
  FROM reached
  WHERE way.cost IS NOT NULL AND (bound IS NULL OR way.cost + rest <= bound)),
least AS (
  SELECT sid, place, through, any_value(at_end) AND through IS NULL AS at_end, min(struct(cost, rides)) AS l
  FROM arrived GROUP BY sid, place, through)
SELECT n.sid, n.place, n.through, n.l.cost, n.at_end, n.l.rides
FROM least n LEFT ANTI JOIN {settled} o
  ON o.sid = n.sid AND o.place = n.place AND o.through <=> n.through AND o.cost <= n.l.cost
"""

LABEL = f"sid string, place bigint, through bigint, cost bigint, at_end boolean, rides array<{RIDE}>"


def _with_ends(searches: DataFrame, rail: DataFrame, charged: bool) -> DataFrame:
    """Searches whose ends the network knows and no landmark tells apart, with ``dmarks``, the marks of
    their target, and ``first``, what a way past a landmark costs at most (null: none, or edges are charged)."""
    asked = searches.select(F.col("src").alias("place")).unionByName(searches.select(F.col("dst").alias("place"))).where("place is not null").distinct()
    ends = rail.join(asked, "place", "left_semi").groupBy("place").agg(F.first("marks").alias("marks"), F.first("area").alias("area"))
    known = (
        searches.join(ends.select(F.col("place").alias("src"), F.col("marks").alias("smarks"), "area"), "src")
        .join(ends.select(F.col("place").alias("dst"), F.col("marks").alias("dmarks")), "dst", "left")
    )
    split = F.expr("coalesce(exists(zip_with(smarks, dmarks, (x, y) -> (x.r is null) <> (y.r is null)), e -> e), false)")
    bans = "if(tier is null, 0, ban) + if(size(banned) = 0, 0, ban)"
    each = f"transfer * (x.r + y.r) + (hop_weight + step + {bans}) * (x.h + y.h)"
    first = F.lit(None).cast("long") if charged else F.expr(f"array_min(zip_with(smarks, dmarks, (x, y) -> {each}))")
    return known.where(~split).withColumn("first", first).select(*searches.columns, "dmarks", "first", "area")


_STOP = "struct<route_id:bigint,pos:int,place:bigint,hop:int,a:bigint,b:bigint,prio:int,marks:" + MARKS + ">"
_WAY = f"sid string, place bigint, through bigint, cost bigint, rides array<{RIDE}>"


def _rounds_within(s: dict, routes: dict, at: dict, marks: dict, deltas: dict) -> dict[int, tuple]:
    """The labels ``place -> (cost, rides)`` of one search over routes of few stops: the rounds of ``_ROUND``."""
    dst, transfer, slack, tier = s["dst"], s["transfer"], s["slack"], s["tier"]
    banned, goal = set(s["banned"] or ()), s["dmarks"] or ()

    def rest(place: int) -> int:
        near = [abs(x["r"] - y["r"]) for x, y in zip(marks[place] or (), goal) if x and y and None not in (x["r"], y["r"])]
        return max(0 if place == dst else transfer, transfer * max(near, default=0) - slack)

    def toll(stop: dict) -> int:
        a, b = stop["a"], stop["b"]
        if a is None:
            return 0
        ban = (tier is not None and stop["prio"] > tier) + (a in banned or b in banned)
        return s["step"] + deltas.get((a, b), 0) + ban * s["ban"]

    best = {s["src"]: (0, ())}
    front, lines, left = dict(best), {}, {}
    while front:
        ends = [c for c in (best[dst][0] if dst in best else None, s["first"]) if c is not None]
        bound = min(ends) + slack if ends else None
        boards: dict[int, dict[int, tuple]] = {}
        for place, (cost, rides) in front.items():
            left.setdefault(place, rest(place))
            if bound is None or cost + transfer <= bound and cost + left[place] <= bound:
                for route, i in at[place]:
                    boards.setdefault(route, {})[i] = (cost + transfer, rides)
        arrived: dict[int, tuple] = {}
        for route, on in boards.items():
            if route not in lines:
                line, paid = [], 0
                for stop in routes[route]:
                    hop = stop["hop"] * s["hop_weight"]
                    paid += hop + toll(stop)
                    line.append((stop["place"], stop["pos"], hop, paid))
                lines[route] = line
            line = lines[route]
            for seats, back in ((range(len(line)), False), (range(len(line) - 1, -1, -1), True)):
                ride = None  # the best boarding so far: (cost at the route's first stop, rides, pos)
                for i in seats:
                    place, pos, hop, paid = line[i]
                    if ride is not None:
                        cost = ride[0] - paid + hop if back else ride[0] + paid
                        if place not in left:
                            left[place] = rest(place)
                        if (bound is None or cost + left[place] <= bound) and (place not in best or cost < best[place][0]):
                            way = (cost, (*ride[1], (route, ride[2], pos)))
                            if place not in arrived or way < arrived[place]:
                                arrived[place] = way
                    if i in on:
                        cost, rides = on[i]
                        mine = (cost + paid - hop if back else cost - paid, rides, pos)
                        ride = mine if ride is None or mine < ride else ride
        best.update(arrived)
        front = arrived
    return best


def _settle(batches: Iterator[pa.RecordBatch], ends_alone: bool = False) -> Iterator[pa.RecordBatch]:
    known = None
    for batch in batches:
        out: dict[str, list] = {"sid": [], "place": [], "through": [], "cost": [], "rides": []}
        areas, rails = batch.column("area").to_pylist(), batch.column("rail")
        for i, s in enumerate(batch.drop_columns(["area", "rail"]).to_pylist()):
            if areas[i] != known:  # searches of one area lie together
                known, routes, at, marks = areas[i], {}, {}, {}
                for stop in sorted(rails[i].as_py(), key=lambda r: (r["route_id"], r["pos"])):
                    line = routes.setdefault(stop["route_id"], [])
                    at.setdefault(stop["place"], []).append((stop["route_id"], len(line)))
                    marks[stop["place"]] = stop["marks"]
                    line.append(stop)
            deltas = {(d["a"], d["b"]): d["delta"] for d in s["deltas"] or ()}
            for place, (cost, rides) in _rounds_within(s, routes, at, marks, deltas).items():
                if ends_alone and place != s["dst"]:
                    continue
                out["sid"].append(s["sid"])
                out["place"].append(place)
                out["through"].append(None)
                out["cost"].append(cost)
                out["rides"].append([{"route_id": r, "p": p, "q": q} for r, p, q in rides])
        ride = pa.struct([("route_id", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(ride)]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def settled_within(asked: DataFrame, rail: DataFrame, deltas: DataFrame | None, ends_alone: bool = False) -> DataFrame:
    """Labels of the searches ``asked`` whose ``area`` is known: each area's few stops go to its searches."""
    stop = F.struct("route_id", F.col("pos").cast("int").alias("pos"), "place", F.col("hop").cast("int").alias("hop"), "a", "b", F.col("prio").cast("int").alias("prio"), "marks")
    own = rail.join(asked.select("area").distinct(), "area", "left_semi")
    packed = own.groupBy("area").agg(F.collect_list(stop.cast(_STOP)).alias("rail"))
    if deltas is None:
        costed = asked.withColumn("deltas", F.expr("cast(array() as array<struct<a:bigint,b:bigint,delta:bigint>>)"))
    else:
        more = deltas.groupBy("sid").agg(F.collect_list(F.struct("a", "b", "delta")).alias("deltas"))
        costed = asked.join(more, "sid", "left")
    wanted = costed.withColumn("sid", F.col("sid").cast("string")).select("sid", "area", *PARAMS, "dmarks", "first", "deltas")
    # Few bytes, much work: spread over as many tasks as a shuffle has, not by size.
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(tasks, "area").join(packed.repartition(tasks, "area"), "area").mapInArrow(
        lambda batches: _settle(batches, ends_alone), _WAY
    )


def search(
    searches: DataFrame,
    rail: DataFrame,
    deltas: DataFrame | None = None,
    max_rounds: int = 100_000,
    watch: Callable[[DataFrame], None] = lambda frontier: None,
    ends_alone: bool = False,
) -> DataFrame:
    """Labels ``(sid, place, through, cost, rides)`` of all searches, settled.

    ``through`` is null for the label of the place itself. ``watch`` is shown every frontier as it
    was written. No literal changes from round to round, so compiled code is reused. With ``ends_alone``
    a search that one task settles leaves the label of its target alone: all that :func:`found` reads.
    """
    spark = searches.sparkSession
    every = cut(_with_ends(searches, rail, deltas is not None), "searches")
    inside = cut(settled_within(every.where("area is not null"), rail.where("area is not null"), deltas, ends_alone), "inside")
    asked = every.where("area is null")
    if asked.isEmpty():
        retire(every)
        return inside
    rail = rail.where("area is null")
    start = asked.select(
        F.col("sid").cast("string").alias("sid"),
        F.col("src").alias("place"),
        F.lit(None).cast("long").alias("through"),
        F.lit(0).cast("long").alias("cost"),
        F.col("src").eqNullSafe(F.col("dst")).alias("at_end"),
        F.expr(f"cast(array() as array<{RIDE}>)").alias("rides"),
    )
    fronts = [cut(start, "frontier")]
    costly = {} if deltas is None else {"deltas": deltas}
    joined = "" if deltas is None else (
        "LEFT JOIN {deltas} d ON c.sid = d.sid AND r.a = d.a AND r.b = d.b"
    )
    step = _ROUND.replace("{delta_join}", joined).replace(
        "{extra}", "0" if deltas is None else "coalesce(d.delta, 0)"
    )
    for _ in range(max_rounds):
        settled = written(fronts, LABEL)
        boards = cut(
            spark.sql(_BOARDS, frontier=fronts[-1], hits=settled.where("at_end"), searches=asked, rail=rail), "boards"
        )
        if boards.isEmpty():
            best = settled.groupBy("sid", "place", "through").agg(F.min(F.struct("cost", "rides")).alias("l"))
            labels = best.select("sid", "place", "through", "l.cost", "l.rides")
            labels = cut(labels.unionByName(inside), "labels")
            retire(boards, every, inside, *fronts)
            return labels
        fronts.append(cut(spark.sql(step, boards=boards, settled=settled, rail=rail, **costly), "frontier"))
        watch(fronts[-1])
        retire(boards)
    raise NotConverged(f"search still improving after {max_rounds} rounds")


def found(labels: DataFrame, searches: DataFrame) -> DataFrame:
    """``(sid, cost, rides)`` for every search that reached its target."""
    return (
        labels.where("through is null")
        .join(searches.select("sid", F.col("dst").alias("place")), ["sid", "place"])
        .select("sid", "cost", "rides")
    )


def chains_of(answers: DataFrame, stops: DataFrame, searches: DataFrame) -> DataFrame:
    """``(sid, cost, stops)``: the rides spelled out stop by stop."""
    spelled = answers.select("sid", F.posexplode("rides").alias("i", "r")).select(
        "sid",
        "i",
        F.col("r.route_id").alias("route_id"),
        F.posexplode(F.sequence("r.p", "r.q")).alias("o", "pos"),
    ).where("o > 0 or i = 0")
    gathered = (
        spelled.join(stops.select("route_id", F.col("pos").cast("int").alias("pos"), "place"), ["route_id", "pos"])
        .groupBy("sid")
        .agg(
            F.expr(
                "transform(array_sort(collect_list(struct(i, o, place))), e -> e.place)"
            ).alias("stops")
        )
    )
    return (
        answers.select("sid", "cost")
        .join(gathered, "sid", "left")
        .join(searches.select("sid", "src"), "sid")
        .select("sid", "cost", F.coalesce("stops", F.array("src")).alias("stops"))
    )


def edge_deltas(sid_edges: DataFrame, delta: int) -> DataFrame:
    """``sid_edges(sid, a, b)`` as cost changes, summed where an edge is named twice."""
    return sid_edges.groupBy("sid", "a", "b").agg(
        (F.count("*") * F.lit(delta)).cast("long").alias("delta")
    )


def crossroad_distance(pairs: DataFrame, net: Network, rail: DataFrame, crossroads_only: bool = True) -> DataFrame:
    """``pairs(src, dst)`` with ``distance``: the fewest crossroads on any way, both
    ends counted (or the fewest hops); null where there is none."""
    asked = pairs.select("src", "dst").distinct()
    sid = F.concat_ws("|", "src", "dst")
    probes = plain_searches(
        asked, sid, transfer=0, hop_weight=1 if crossroads_only else 0, step=0 if crossroads_only else 1
    )
    got = found(search(probes, rail, ends_alone=True), probes)
    return _with_source(pairs, got, probes, net, crossroads_only)


def _with_source(pairs, got, probes, net, crossroads_only):
    reached = got.join(probes.select("sid", "src", "dst"), "sid").join(
        net.degree.withColumnRenamed("place", "src"), "src", "left"
    )
    own = F.coalesce(is_crossroad_expr("degree"), F.lit(0)) if crossroads_only else F.lit(0)
    reached = reached.select("src", "dst", (F.col("cost") + own).alias("distance"))
    return pairs.join(reached, ["src", "dst"], "left")


def hop_distances(sources: DataFrame, rail: DataFrame) -> DataFrame:
    """``(src, place, cost)``: hops from each source to every place it reaches."""
    probes = plain_searches(
        sources.select("src").distinct().withColumn("dst", F.lit(None).cast("long")),
        F.col("src").cast("string"),
        transfer=0,
        hop_weight=0,
        step=1,
    )
    labels = search(probes, rail)
    return labels.where("through is null").select(
        F.col("sid").cast("long").alias("src"), "place", "cost"
    )


def point_distance(points: DataFrame, net: Network, rail: DataFrame, crossroads_only: bool = True) -> DataFrame:
    """``points(qid, points)`` with ``c_min``: the shortest a way through the points
    could be, shared crossroads counted once; 0 where a leg is unreachable."""
    legs = points.select(
        "qid",
        F.explode(
            F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] as src, points[i] as dst))")
        ).alias("l"),
    ).select("qid", "l.src", "l.dst")
    measured = crossroad_distance(legs.select("src", "dst").distinct(), net, rail, crossroads_only)
    total = (
        legs.join(measured, ["src", "dst"], "left")
        .groupBy("qid")
        .agg(
            F.sum("distance").alias("total"),
            F.max(F.col("distance").isNull()).alias("broken"),
        )
    )
    inner = points.select("qid", F.explode(F.expr("slice(points, 2, greatest(size(points) - 2, 0))")).alias("place"))
    shared = (
        inner.join(net.degree, "place")
        .groupBy("qid")
        .agg(F.sum(is_crossroad_expr("degree")).alias("shared"))
    )
    fix = F.coalesce("shared", F.lit(0)) if crossroads_only else F.lit(0)
    return (
        points.join(total, "qid", "left")
        .join(shared, "qid", "left")
        .select(
            "qid",
            "points",
            F.when(F.col("broken"), 0).otherwise(F.greatest(F.col("total") - fix, F.lit(0))).cast("long").alias("c_min"),
        )
    )


