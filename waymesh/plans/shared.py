"""Tables several queries read, written once per session and input folder."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions import text as tx
from waymesh.functions.chains import edge_ends
from waymesh.operators import insights, legs, pool, select
from waymesh.operators.score import Network
from waymesh.plans import tables as tb
from waymesh.session import cut

_made: dict[tuple[str, str, str], object] = {}
_lock = threading.RLock()


def once(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    """The result of ``make`` for this session and folder, made on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _lock:
        if key not in _made:
            _made[key] = make()
        return _made[key]


def forget(name: str) -> None:
    """Make the table ``name`` anew when it is next asked for."""
    with _lock:
        for key in [k for k in _made if k[2] == name]:
            del _made[key]


def walks(spark, sf_dir) -> DataFrame:
    return once("walks", spark, sf_dir, lambda: cut(tb.walks(spark, sf_dir), "stops"))


def stops(spark, sf_dir) -> DataFrame:
    return walks(spark, sf_dir).select("route_id", "pos", "place")


def net(spark, sf_dir):
    return once("net", spark, sf_dir, lambda: tb.network(spark, sf_dir, stops(spark, sf_dir)))


def trip_components(spark, sf_dir) -> DataFrame:
    """``(place, component)`` of every component that a trip starts in, ends in or leads through."""

    def make():
        ends = trips(spark, sf_dir).select(F.explode(F.concat(F.array("start_place", "end_place"), "via")).alias("place"))
        comp = components(spark, sf_dir)
        touched = comp.join(ends.distinct(), "place", "left_semi").select("component").distinct()
        return cut(comp.join(touched, "component", "left_semi").select("place", "component"), "touched")

    return once("trip_comp", spark, sf_dir, make)


def trip_net(spark, sf_dir) -> Network:
    """The network as far as trips can reach: the components they touch, each whole."""

    def make():
        rows = walks(spark, sf_dir)
        kept = rows.join(trip_components(spark, sf_dir), "place", "left_semi").unionByName(rows.where("place is null"))
        kept = cut(kept.select("route_id", "pos", "place", "onward"), "stops")
        return tb.network(spark, sf_dir, kept.drop("onward"), tb.walk_edges(kept))

    return once("trip_net", spark, sf_dir, make)


def ready(spark, sf_dir) -> pool.Prepared:
    """What trips can reach, ready for search, with the counts of the whole network."""

    def make():
        arteries, worst = tb.arteries(spark, sf_dir, walks(spark, sf_dir))
        whole = pool.Whole(components(spark, sf_dir).count(), worst, arteries)
        return pool.prepare(trip_net(spark, sf_dir), comp=trip_components(spark, sf_dir), whole=whole)

    return once("ready", spark, sf_dir, make)


def trips(spark, sf_dir) -> DataFrame:
    return once("trips", spark, sf_dir, lambda: cut(tb.od_queries(spark, sf_dir, stops(spark, sf_dir)), "od"))


def starts(spark, sf_dir) -> DataFrame:
    """The places where trips start, without the rest of the trips."""
    return once("starts", spark, sf_dir, lambda: cut(tb.trip_starts(spark, sf_dir, stops(spark, sf_dir)), "starts"))


def plain_pool(spark, sf_dir) -> DataFrame:
    def make():
        return pool.candidate_pool(trips(spark, sf_dir).drop("via"), ready(spark, sf_dir))

    return once("pool", spark, sf_dir, make)


def plain_top(spark, sf_dir) -> DataFrame:
    return once("top", spark, sf_dir, lambda: cut(legs.one_leg(select.select_diverse(plain_pool(spark, sf_dir), 3)), "top"))


def leg_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    def make():
        asked = legs.normalise_via(trips(spark, sf_dir)).where(F.size("via") > 0)
        return legs.leg_candidates(cut(asked, "via"), ready(spark, sf_dir))

    return once("legs", spark, sf_dir, make)


def via_pool(spark, sf_dir) -> DataFrame:
    def make():
        points, parts = leg_parts(spark, sf_dir)
        return cut(legs.combine(parts, points, ready(spark, sf_dir)), "via_pool")

    return once("via_pool", spark, sf_dir, make)


def via_top(spark, sf_dir) -> DataFrame:
    return once("via_top", spark, sf_dir, lambda: cut(select.select_diverse(via_pool(spark, sf_dir), 3, 1.5), "via_top"))


def components(spark, sf_dir) -> DataFrame:
    """Components from the stops alone: a place is joined with the next one or is the last of its route."""

    def make():
        rows = walks(spark, sf_dir)
        last = rows.where("onward is null or place is null").select("place")
        return insights.place_components(links(spark, sf_dir), last)

    return once("comp", spark, sf_dir, make)


def links(spark, sf_dir) -> DataFrame:
    """``(a, b)``: both ends of every hop of every route, as often as routes take it."""
    rows = walks(spark, sf_dir).where("place <> onward")
    return rows.select(*edge_ends("place", "onward"))


def places(spark, sf_dir) -> DataFrame:
    """Every place of the network, without the rest of it."""
    return once("places", spark, sf_dir, lambda: cut(tb.places_table(spark, sf_dir), "places"))


def registry(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """``(place_id, name, group)``: every place of the network; the size picks the group. ``rows(place)`` are
    the places, if they are written."""
    size = F.pmod("place", F.lit(100))
    cust = F.floor(F.col("place") / 100)
    group = None
    for i, (key, *_rest) in enumerate(tx.PLACE_GROUPS):
        test = F.pmod(size, F.lit(len(tx.PLACE_GROUPS))) == i
        group = F.when(test, key) if group is None else group.when(test, key)
    return (places(spark, sf_dir) if rows is None else rows).select(
        F.col("place").alias("place_id"),
        F.concat(F.lit("Site "), cust.cast("string"), F.lit("/"), size.cast("string")).alias("name"),
        group.alias("group"),
    )


def _case(column: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN '{v}'" if v is not None else f"WHEN {i} THEN NULL" for i, v in enumerate(values)
    )
    return f"CASE {column} {arms} END"


REGISTRY_SQL = f"""
reg0 AS (SELECT place AS place_id, 'Site ' || (place // 100) || '/' || (place % 100) AS name, (place % 100) % 8 AS g FROM places),
registry AS (SELECT place_id, name, {_case('g', [k for k, *_ in tx.PLACE_GROUPS])} AS grp,
                    {_case('g', [label for _, label, *_ in tx.PLACE_GROUPS])} AS label,
                    coalesce({_case('g', [p for *_, p, _ in tx.PLACE_GROUPS])} || ' ', '') || name AS display FROM reg0)"""


def trees(spark, sf_dir) -> DataFrame:
    """Orders as trees: from three stops on, the first two are heads of the rest. Orders of
    rating 1 carry a mark along the shared tail, of rating 2 one from the first head to the
    end, of rating 3 the legacy whole-route rating."""

    def make():
        stops = net(spark, sf_dir).stops
        size = stops.groupBy("route_id").agg(F.count("*").cast("int").alias("n")).join(
            tb.order_priority(spark, sf_dir).withColumnRenamed("priority", "rating"), "route_id"
        )
        rows = stops.join(size, "route_id").withColumn(
            "node", F.when((F.col("n") >= 3) & (F.col("pos") < 2), F.col("pos")).otherwise(-1)
        )
        nodes = rows.groupBy("route_id", "node", "n", "rating").agg(
            F.expr("transform(array_sort(collect_list(struct(pos, place))), e -> cast(e.place as string))").alias("places")
        )
        own = F.size("places")
        mark = lambda to, pr: F.expr(f"array(named_struct('from', 0, 'to', cast({to} as int), 'priority', {pr}))")
        none = F.expr("cast(array() as array<struct<from:int,to:int,priority:int>>)")
        return cut(
            nodes.select(
                F.col("route_id").cast("int").alias("route_idx"),
                F.expr("if(node < 0, cast(array() as array<int>), array(cast(node as int)))").alias("node_path"),
                "places",
                F.when((F.col("rating") == 1) & (F.col("node") < 0) & (own >= 2), mark("size(places) - 1", 1))
                .when((F.col("rating") == 2) & (F.col("node") == 0), mark("n - 2", 2))
                .otherwise(none)
                .alias("marks"),
                F.when((F.col("rating") == 3) & (F.col("node") < 0), 3).cast("int").alias("priority"),
            ),
            "trees",
        )

    return once("trees", spark, sf_dir, make)


TREES_SQL = """
sizes AS (SELECT route_id, count(*) AS n FROM stops GROUP BY 1),
node_stops AS (SELECT s.route_id, n, priority AS rating, place, pos,
                      CASE WHEN n >= 3 AND pos < 2 THEN pos ELSE -1 END AS node
               FROM stops s JOIN sizes USING (route_id) JOIN prio USING (route_id)),
nodes AS (SELECT route_id, node, n, rating, count(*) AS own, string_agg(place, '>' ORDER BY pos) AS places
          FROM node_stops GROUP BY 1, 2, 3, 4),
leaf AS (SELECT * FROM nodes WHERE (n >= 3 AND node >= 0) OR n < 3),
leaf_stops AS (SELECT l.route_id, l.node, l.n, l.rating, s.place,
                      row_number() OVER (PARTITION BY l.route_id, l.node ORDER BY s.pos) - 1 AS seat
               FROM leaf l JOIN node_stops s ON s.route_id = l.route_id AND (s.node = l.node OR s.node = -1)),
corridors AS (SELECT route_id, node, n, rating, string_agg(place, '>' ORDER BY seat) AS places, count(*) AS len
              FROM leaf_stops GROUP BY 1, 2, 3, 4)"""


def splices(spark, sf_dir) -> DataFrame:
    """Chains to score: an order up to the first place it shares with the territory's next
    order, then that order onwards: ``(chain_id, stops)``."""

    def make():
        stops = net(spark, sf_dir).stops
        cust = F.floor(F.col("place") / 100)
        heads = stops.where("pos = 0").select("route_id", cust.alias("cust"))
        line = Window.partitionBy("cust").orderBy("route_id")
        after = heads.withColumn("next_id", F.lead("route_id").over(line)).where("next_id is not null")
        mine = stops.join(after.select("route_id", "next_id"), "route_id")
        theirs = stops.select(F.col("route_id").alias("next_id"), "place", F.col("pos").alias("at"))
        joint = (
            mine.join(theirs, ["next_id", "place"])
            .groupBy("route_id", "next_id")
            .agg(F.min(F.struct("pos", "at")).alias("j"))
            .select("route_id", "next_id", "j.pos", "j.at")
        )
        first = stops.join(joint.select("route_id", F.col("pos").alias("upto")), "route_id").where("pos <= upto").select(
            F.col("route_id").alias("chain_id"), F.col("pos").alias("k"), "place"
        )
        second = theirs.withColumnRenamed("at", "p").join(joint, "next_id").where("p > at").select(
            F.col("route_id").alias("chain_id"), (F.col("pos") + F.col("p") - F.col("at")).alias("k"), "place"
        )
        return cut(
            first.unionByName(second)
            .groupBy("chain_id")
            .agg(F.expr("transform(array_sort(collect_list(struct(k, place))), e -> e.place)").alias("stops")),
            "splices",
        )

    return once("splices", spark, sf_dir, make)


SPLICES_SQL = """
heads AS (SELECT route_id, place // 100 AS cust FROM stops WHERE pos = 0),
after AS (SELECT route_id, lead(route_id) OVER (PARTITION BY cust ORDER BY route_id) AS next_id FROM heads),
meet AS (SELECT a.route_id, a.next_id, s.pos, t.pos AS seat,
                row_number() OVER (PARTITION BY a.route_id ORDER BY s.pos) AS rn
         FROM after a JOIN stops s ON s.route_id = a.route_id JOIN stops t ON t.route_id = a.next_id AND t.place = s.place),
joint AS (SELECT route_id, next_id, pos, seat FROM meet WHERE rn = 1),
chain_stops AS (
  SELECT s.route_id AS chain_id, s.pos AS k, s.place FROM stops s JOIN joint j ON s.route_id = j.route_id AND s.pos <= j.pos
  UNION ALL
  SELECT j.route_id, j.pos + t.pos - j.seat, t.place FROM joint j JOIN stops t ON t.route_id = j.next_id AND t.pos > j.seat),
chain_hops AS (SELECT x.chain_id, x.k AS i, least(x.place, y.place) AS a, greatest(x.place, y.place) AS b
               FROM chain_stops x JOIN chain_stops y ON x.chain_id = y.chain_id AND y.k = x.k + 1),
member AS (SELECT h.chain_id, h.i, e.route_id FROM chain_hops h JOIN edges e USING (a, b)),
island AS (SELECT *, i - row_number() OVER (PARTITION BY chain_id, route_id ORDER BY i) AS g FROM member),
spans AS (SELECT chain_id, route_id, min(i) AS lo, max(i) + 1 AS hi FROM island GROUP BY chain_id, route_id, g),
units AS (SELECT h.chain_id, h.i, CAST(p.degree >= 3 AS INT) + CAST(q.degree >= 3 AS INT) AS unit
          FROM chain_hops h JOIN degree p ON p.place = h.a JOIN degree q ON q.place = h.b),
prefix AS (SELECT chain_id, i + 1 AS j, sum(unit) OVER (PARTITION BY chain_id ORDER BY i) AS len FROM units),
ridden AS (SELECT DISTINCT s.chain_id, least(x.k, y.k) AS lo, greatest(x.k, y.k) AS hi, m.priority
           FROM spans s JOIN marks m USING (route_id)
           JOIN chain_stops x ON x.chain_id = s.chain_id AND x.place = m.start_place AND x.k BETWEEN s.lo AND s.hi
           JOIN chain_stops y ON y.chain_id = s.chain_id AND y.place = m.end_place AND y.k BETWEEN s.lo AND s.hi
           WHERE x.k <> y.k)"""
