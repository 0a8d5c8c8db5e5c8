"""The registered queries: one per operator, over the whole provided tables, with the SQL
that must give the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions import chains as ch
from waymesh.functions import text as tx
from waymesh.operators import (
    edits,
    fill,
    insights,
    legs,
    marks as mk,
    names,
    network as nw,
    pool,
    registry as rg,
    report,
    score as sc,
    search as se,
    select,
    tree,
    trips,
    validate as va,
)
from waymesh.operators.articulation import articulation_points
from waymesh.plans import shared as sh
from waymesh.plans import tables as tb
from waymesh.session import cut, scratch_root
from waymesh.sources import documents as dc

QUERIES: dict = {}
SQL: dict[str, str] = {}

EDGES = "WITH RECURSIVE " + tb.EDGES_SQL
MARKS = EDGES + "," + tb.MARKS_SQL
CLOSED = EDGES + "," + tb.CLOSED_SQL
REG = CLOSED + "," + sh.REGISTRY_SQL
TREES = MARKS + "," + sh.TREES_SQL
SPLICES = MARKS + "," + sh.SPLICES_SQL
OD = EDGES + "," + tb.OD_SQL


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def txt(column) -> F.Column:
    """An array as text, so both engines spell it alike."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ">")


# --- network derivation ---------------------------------------------------


@query("a2_corridor_stops", "WITH " + tb.STOPS_SQL + " SELECT route_id, pos, place FROM stops")
def _(spark, sf):
    return tb.stops(spark, sf).select("route_id", F.col("pos").cast("int").alias("pos"), "place")


@query("a6_edge_records", EDGES + " SELECT a, b, string_agg(route_id, '>' ORDER BY route_id) AS route_ids FROM edges GROUP BY 1, 2 ORDER BY 1, 2")
def _(spark, sf):
    return nw.edge_records(nw.edges(tb.stops(spark, sf))).select("a", "b", txt("route_ids").alias("route_ids")).orderBy("a", "b")


@query("e3_edges", EDGES + " SELECT a, b, route_id FROM edges")
def _(spark, sf):
    return nw.edges(tb.stops(spark, sf))


@query("e2_path_edges", EDGES + " SELECT route_id, count(DISTINCT (least(p, q), greatest(p, q))) AS edges FROM hops GROUP BY 1")
def _(spark, sf):
    chains = tb.stops(spark, sf).groupBy("route_id").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, place))), e -> e.place)").alias("stops")
    )
    return chains.where(F.size("stops") > 1).select(
        "route_id", F.size(ch.path_edges(F.col("stops"))).cast("long").alias("edges")
    )


@query("e4_adjacency", EDGES + " SELECT p.place, coalesce(string_agg(n.neighbour, '>' ORDER BY n.neighbour), '') AS neighbours FROM places p LEFT JOIN near n USING (place) GROUP BY 1")
def _(spark, sf):
    stops = tb.stops(spark, sf)
    return nw.adjacency(nw.edges(stops), nw.places_of(stops)).select("place", txt("neighbours").alias("neighbours"))


@query("e5_places", EDGES + " SELECT place FROM places")
def _(spark, sf):
    return nw.places_of(tb.stops(spark, sf))


@query("e6_routes_on", EDGES + " SELECT h.route_id AS asked_by, p AS x, q AS y, e.route_id FROM hops h JOIN edges e ON e.a = least(p, q) AND e.b = greatest(p, q)")
def _(spark, sf):
    stops = tb.stops(spark, sf)
    asked = nw.hops(stops).select(F.col("route_id").alias("asked_by"), F.col("place").alias("x"), F.col("onward").alias("y"))
    return nw.routes_on(asked, nw.edges(stops))


@query("e7_route_ids", EDGES + " SELECT DISTINCT route_id FROM edges")
def _(spark, sf):
    return nw.route_ids(nw.edges(tb.stops(spark, sf)))


@query("e8_degree", EDGES + " SELECT place, CAST(degree AS BIGINT) AS degree FROM degree")
def _(spark, sf):
    stops = tb.stops(spark, sf)
    return nw.degrees(nw.edges(stops), nw.places_of(stops))


@query("e9_crossroads", EDGES + " SELECT place, CAST(degree AS BIGINT) AS degree FROM degree WHERE degree >= 3")
def _(spark, sf):
    return nw.crossroads(nw.degrees(nw.edges(tb.stops(spark, sf))))


@query("e10_known", EDGES + " SELECT o_custkey, o_custkey * 100 + o_custkey % 50 AS place FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey * 100 + o_custkey % 50 IN (SELECT place FROM places)")
def _(spark, sf):
    asked = tb.table(spark, sf, "orders").select("o_custkey").distinct().withColumn(
        "place", F.col("o_custkey") * 100 + F.pmod("o_custkey", F.lit(50))
    )
    return nw.known(asked, nw.places_of(tb.stops(spark, sf))).select("o_custkey", "place")


@query("e11_without_places", CLOSED + """, kept AS (SELECT * FROM links WHERE a NOT IN (SELECT place FROM closed) AND b NOT IN (SELECT place FROM closed)),
 knear AS (SELECT a AS place, b AS n FROM kept UNION ALL SELECT b, a FROM kept)
 SELECT p.place, count(n) AS degree FROM places p LEFT JOIN knear k ON k.place = p.place
 WHERE p.place NOT IN (SELECT place FROM closed) GROUP BY 1""")
def _(spark, sf):
    stops = tb.stops(spark, sf)
    edges = nw.edges(stops)
    return nw.without_places(edges, nw.degrees(edges, nw.places_of(stops)), tb.closed_places(spark, sf, stops))[1]


@query("e12_direct_takers", EDGES + " SELECT a, b, count(DISTINCT route_id) AS takers, CAST(CASE WHEN count(DISTINCT route_id) >= 2 THEN 2 ELSE 8 END AS INT) AS budget FROM edges GROUP BY 1, 2")
def _(spark, sf):
    return nw.direct_takers(tb.stops(spark, sf))


@query("e13_details", EDGES + """,
 takers AS (SELECT a, b, CASE WHEN count(*) >= 2 THEN 2 ELSE 8 END AS budget FROM edges GROUP BY 1, 2),
 lasts AS (SELECT route_id, max(pos) AS last FROM stops GROUP BY 1),
 stretch AS (SELECT x.route_id, x.pos, y.pos - x.pos AS k, x.place AS s, y.place AS e, last
             FROM stops x JOIN stops y ON x.route_id = y.route_id AND y.pos - x.pos BETWEEN 2 AND 9
             JOIN lasts ON lasts.route_id = x.route_id
             JOIN takers t ON t.a = least(x.place, y.place) AND t.b = greatest(x.place, y.place)
             WHERE y.pos - x.pos - 1 <= budget),
 both_ways AS (SELECT s AS u, e AS v, k, route_id, 0 AS dir, pos AS seat, pos FROM stretch
          UNION ALL SELECT e, s, k, route_id, 1, last - pos - k, pos FROM stretch),
 pick AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY k, route_id, dir, seat) AS rn FROM both_ways)
 SELECT u, v, string_agg(s.place, '>' ORDER BY CASE WHEN dir = 0 THEN s.pos ELSE -s.pos END) AS way
 FROM pick JOIN stops s ON s.route_id = pick.route_id AND s.pos > pick.pos AND s.pos < pick.pos + k
 WHERE rn = 1 GROUP BY u, v""")
def _(spark, sf):
    stops = sh.net(spark, sf).stops
    return fill.details(stops, nw.direct_takers(stops)).select("u", "v", txt("way").alias("way"))


@query("e14_bypasses")
def _(spark, sf):
    stops = sh.net(spark, sf).stops
    takers = cut(nw.direct_takers(stops), "takers")
    detail = cut(fill.details(stops, takers), "details")
    once = fill._fix_point(
        stops.select("route_id", "pos", F.array(F.lit(0)).alias("sub"), "place"), detail, nw.BLOCK, 1000
    )
    return fill.bypasses(once, takers, detail, ch.LAZY_GAP, nw.BLOCK).select("u", "v", txt("way").alias("way"))


def _filled(spark, sf) -> DataFrame:
    return sh.once("filled", spark, sf, lambda: cut(fill.fill_missing(sh.stops(spark, sf)), "filled"))


@query("e16_filled_chains")
def _(spark, sf):
    return _filled(spark, sf)


@query("e15_inserted_stops")
def _(spark, sf):
    had = sh.net(spark, sf).stops.groupBy("route_id").agg(F.count("*").alias("before"))
    return (
        _filled(spark, sf).groupBy("route_id").agg(F.count("*").alias("after")).join(had, "route_id").where("after > before")
    )


@query("a5_rebuilt_edges")
def _(spark, sf):
    return nw.edge_records(nw.edges(_filled(spark, sf))).select("a", "b", txt("route_ids").alias("route_ids"))


@query("a7_fingerprint")
def _(spark, sf):
    return dc.fingerprint(sh.trees(spark, sf))


# --- sources --------------------------------------------------------------


@query("a8_registry", REG + ' SELECT place_id, name, grp AS "group" FROM registry')
def _(spark, sf):
    return sh.registry(spark, sf)


@query("a9_closed_places", CLOSED + " SELECT DISTINCT place FROM closed")
def _(spark, sf):
    return tb.closed_places(spark, sf, tb.stops(spark, sf)).select("place").distinct()


@query("a10_closures_resolved", REG + " SELECT group_id AS group_idx, place_id AS place FROM closed JOIN registry ON place_id = place")
def _(spark, sf):
    reg = rg.with_display(sh.registry(spark, sf))
    typed = tb.closed_places(spark, sf, sh.net(spark, sf).stops).join(reg, F.col("place") == F.col("place_id")).select(
        F.col("group_id").alias("group_idx"), "display"
    )
    return rg.resolve(typed, sh.registry(spark, sf), "display").select("group_idx", F.col("place_id").alias("place"))


@query("a11_network_nodes", REG + ' SELECT display AS id, place_id IN (SELECT place FROM closed) AS compromised, grp AS "group" FROM registry')
def _(spark, sf):
    n = sh.net(spark, sf)
    return nw.to_network(n.edges, n.degree, rg.with_display(sh.registry(spark, sf)), tb.closed_places(spark, sf, n.stops))[0]


@query("a11_network_links", REG + " SELECT x.display AS source, y.display AS target FROM links JOIN registry x ON x.place_id = a JOIN registry y ON y.place_id = b")
def _(spark, sf):
    n = sh.net(spark, sf)
    return nw.to_network(n.edges, n.degree, rg.with_display(sh.registry(spark, sf)), tb.closed_places(spark, sf, n.stops))[1]


@query("a12_place_list", REG + " SELECT display FROM registry WHERE place_id NOT IN (SELECT place FROM closed)")
def _(spark, sf):
    n = sh.net(spark, sf)
    return dc.place_list(n.edges, n.degree, sh.registry(spark, sf), tb.closed_places(spark, sf, n.stops))


@query("a14_place_universe", EDGES + " SELECT DISTINCT CAST(place AS VARCHAR) AS text FROM stops")
def _(spark, sf):
    return dc.place_universe(sh.trees(spark, sf))


def _documents(spark, sf) -> DataFrame:
    """The trees as documents, heads nested under their tail."""
    t = sh.trees(spark, sf)
    head = t.where("size(node_path) = 1").groupBy("route_idx").agg(
        F.expr("transform(array_sort(collect_list(struct(node_path[0] as i, places, marks))), e -> struct(e.places, e.marks))").alias("branches")
    )
    return t.where("size(node_path) = 0").join(head, "route_idx", "left").select(
        "route_idx", F.to_json(F.struct("places", "marks", "priority", "branches")).alias("doc")
    )


@query("a1_parsed_documents", TREES + " SELECT CAST(route_id AS INT) AS route_idx, CASE WHEN node < 0 THEN '' ELSE CAST(node AS VARCHAR) END AS node_path, places FROM nodes")
def _(spark, sf):
    return dc.parse_documents(_documents(spark, sf)).select("route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"))


# --- trees ----------------------------------------------------------------

NODE = "CAST(route_id AS INT) AS route_idx, CASE WHEN node < 0 THEN '' ELSE CAST(node AS VARCHAR) END AS node_path"


def _mark_text(column="marks"):
    return F.array_join(F.expr(f"transform({column}, m -> concat_ws('-', m.from, m.to, m.priority))"), ",")


@query("b1_upgraded_marks", TREES + f""" SELECT {NODE},
 CASE WHEN rating = 1 AND node < 0 AND own >= 2 THEN '0-' || (own - 1) || '-1'
      WHEN rating = 2 AND node = 0 THEN '0-' || (n - 2) || '-2'
      WHEN rating = 3 AND n >= 3 AND node >= 0 THEN '0-' || (n - 2) || '-3'
      WHEN rating = 3 AND n = 2 THEN '0-1-3' ELSE '' END AS marks FROM nodes""")
def _(spark, sf):
    return tree.upgrade(sh.trees(spark, sf)).select("route_idx", txt("node_path").alias("node_path"), _mark_text().alias("marks"))


@query("a3_saved_routes", TREES + f""" SELECT {NODE}, places,
 CASE WHEN rating = 1 AND node < 0 AND own >= 2 THEN '0-' || (own - 1) || '-1'
      WHEN rating = 2 AND node = 0 THEN '0-' || (n - 2) || '-2'
      WHEN rating = 3 AND n >= 3 AND node >= 0 THEN '0-' || (n - 2) || '-3'
      WHEN rating = 3 AND n = 2 THEN '0-1-3' ELSE '' END AS marks FROM nodes WHERE n >= 2""")
def _(spark, sf):
    # All routes that the rules allow, saved into a new store and read back by name.
    trees = sh.trees(spark, sf)
    short = trees.groupBy("route_idx").agg(F.sum(F.size("places")).alias("n")).where("n < 2").select("route_idx")
    store = dc.Store(spark, f"{scratch_root(spark)}/waymesh/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}")
    if not store.save_routes(trees.join(short, "route_idx", "left_anti"), derive=False).isEmpty():
        raise ValueError("a tree breaks the rules")
    return store.load_routes().select("route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"), _mark_text().alias("marks"))


@query("b3_leaves", TREES + f" SELECT CAST(row_number() OVER (ORDER BY route_id, node) - 1 AS BIGINT) AS route_id, {NODE}, places FROM corridors")
def _(spark, sf):
    return tree.leaves(sh.trees(spark, sf)).select("route_id", "route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"))


@query("b4_frame_length", TREES + f" SELECT {NODE}, CAST(CASE WHEN node < 0 THEN own ELSE n - 1 END AS INT) AS frame FROM nodes")
def _(spark, sf):
    return tree.with_frame(sh.trees(spark, sf)).select("route_idx", txt("node_path").alias("node_path"), F.size("frame").alias("frame"))


@query("b5_resolved_marks", TREES + """,
 num AS (SELECT route_id, node, n, rating, row_number() OVER (ORDER BY route_id, node) - 1 AS rid FROM corridors),
 tail AS (SELECT route_id, arg_min(place, pos) AS head, arg_max(place, pos) AS last, count(*) AS own FROM node_stops WHERE node = -1 GROUP BY 1),
 lead AS (SELECT route_id, node, arg_min(place, seat) AS head FROM leaf_stops GROUP BY 1, 2)
 SELECT rid AS route_id, CAST(CASE WHEN rating = 1 THEN t.head ELSE l.head END AS VARCHAR) AS start_place,
        CAST(t.last AS VARCHAR) AS end_place, rating AS priority
 FROM num JOIN tail t USING (route_id) JOIN lead l USING (route_id, node)
 WHERE (rating = 1 AND own >= 2) OR (rating = 2 AND node = 0) OR (rating = 3 AND n >= 2)""")
def _(spark, sf):
    t = tree.upgrade(sh.trees(spark, sf))
    return tree.resolved_marks(t, tree.leaves(t))


@query("b6_route_priorities", TREES + """,
 each AS (SELECT route_id, CASE WHEN rating = 1 AND (SELECT true) AND n - CASE WHEN n >= 3 THEN 2 ELSE 0 END >= 2 THEN 1
                                WHEN rating = 2 AND node = 0 THEN 2 WHEN rating = 3 AND n >= 2 THEN 3 ELSE 0 END AS p FROM corridors)
 SELECT CAST(route_id AS INT) AS route_idx, string_agg(DISTINCT CAST(p AS VARCHAR), '>' ORDER BY CAST(p AS VARCHAR)) AS priorities FROM each GROUP BY 1""")
def _(spark, sf):
    t = tree.upgrade(sh.trees(spark, sf))
    c = cut(tree.leaves(t), "leaves")
    return tree.route_priorities(c, tree.resolved_marks(t, c)).select("route_idx", txt("priorities").alias("priorities"))


@query("b7_route_stops", TREES + " SELECT CAST(route_id AS INT) AS route_idx, CAST(place AS VARCHAR) AS place FROM node_stops")
def _(spark, sf):
    return tree.route_stops(sh.trees(spark, sf)).select("route_idx", "place")


@query("b8_leaf_count", TREES + " SELECT CAST(route_id AS INT) AS route_idx, count(*) AS leaves FROM leaf GROUP BY 1")
def _(spark, sf):
    return tree.leaf_count(sh.trees(spark, sf))


@query("b9_mark_pieces", TREES + """,
 m AS (SELECT route_id, node, n, own, CASE WHEN rating = 1 AND node < 0 AND own >= 2 THEN own - 1
        WHEN rating = 2 AND node = 0 THEN n - 2 END AS t, rating AS priority FROM nodes),
 mm AS (SELECT * FROM m WHERE t IS NOT NULL)
 SELECT CAST(route_id AS INT) AS route_idx, CASE WHEN node < 0 THEN '' ELSE CAST(node AS VARCHAR) END AS up_path, CAST(0 AS INT) AS "from",
        CAST(least(t, own - 1) AS INT) AS "to", priority, true AS head, node >= 0 AS continues FROM mm
 UNION ALL SELECT CAST(route_id AS INT), '', CAST(0 AS INT), CAST(n - 3 AS INT), priority, false, false FROM mm WHERE node >= 0""")
def _(spark, sf):
    return tree.mark_pieces(sh.trees(spark, sf)).select(
        "route_idx", txt("up_path").alias("up_path"), "from", "to", "priority", "head", "continues"
    )


@query("b10_frame_range", TREES + """ SELECT CAST(route_id AS INT) AS route_idx, string_agg(place, '>' ORDER BY seat) AS places
 FROM leaf_stops WHERE node = 1 AND seat <= 2 GROUP BY 1""")
def _(spark, sf):
    t = sh.trees(spark, sf)
    ranges = t.where("size(node_path) = 1 and node_path[0] = 1").select(
        F.col("route_idx").alias("range_id"), "route_idx", "node_path", F.lit(0).alias("from"), F.lit(2).alias("to")
    )
    return tree.frame_range_stops(t, ranges).select(F.col("range_id").alias("route_idx"), txt("places").alias("places"))


def _renames(spark, sf):
    size = F.pmod("place", F.lit(100))
    return tb.places_table(spark, sf).where(size == 13).select(
        F.col("place").cast("string").alias("old"), (F.col("place") + 87).cast("string").alias("new")
    )


@query("b11_rename_stops", TREES + f" SELECT {NODE}, string_agg(CASE WHEN place % 100 = 13 THEN place + 87 ELSE place END, '>' ORDER BY pos) AS places FROM node_stops GROUP BY route_id, node")
def _(spark, sf):
    return edits.rename_stops(sh.trees(spark, sf), _renames(spark, sf)).select(
        "route_idx", txt("node_path").alias("node_path"), txt("places").alias("places")
    )


@query("b11_rename_counts", TREES + " SELECT CAST(place AS VARCHAR) AS old, CAST(place + 87 AS VARCHAR) AS new, count(*) AS occurrences FROM node_stops WHERE place % 100 = 13 GROUP BY place")
def _(spark, sf):
    return edits.rename_counts(sh.trees(spark, sf), _renames(spark, sf))


@query("b12_reversed", TREES + f""" SELECT {NODE}, string_agg(place, '>' ORDER BY -pos) AS places,
 CASE WHEN any_value(rating) = 1 AND count(*) >= 2 THEN '0-' || (count(*) - 1) || '-1' ELSE '' END AS marks FROM node_stops WHERE n < 3 GROUP BY route_id, node""")
def _(spark, sf):
    t = sh.trees(spark, sf)
    branched = t.where("size(node_path) > 0").select("route_idx").distinct()
    return edits.reverse_routes(t.join(branched, "route_idx", "left_anti")).select(
        "route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"), _mark_text().alias("marks")
    )


@query("b13_set_marks", TREES + f""" SELECT {NODE}, CASE WHEN rating = 1 AND own >= 4 THEN '0-1-1,1-2-2,2-' || (own - 1) || '-1'
  WHEN rating = 1 THEN '0-1-1,1-2-2' ELSE '1-2-2' END AS marks FROM nodes WHERE node < 0 AND own >= 3""")
def _(spark, sf):
    t = sh.trees(spark, sf).where("size(node_path) = 0 and size(places) >= 3")
    laid = t.select("route_idx", "node_path", F.lit(2).alias("from"), F.lit(1).alias("to"), F.lit(2).alias("priority"))
    return edits.set_marks(t, laid).select("route_idx", txt("node_path").alias("node_path"), _mark_text().alias("marks"))


@query("b14_remove_marks", TREES + f" SELECT {NODE}, '' AS marks FROM nodes")
def _(spark, sf):
    t = sh.trees(spark, sf)
    return edits.remove_marks(t, t.select("route_idx", "node_path", F.lit(0).alias("mark_index"))).select(
        "route_idx", txt("node_path").alias("node_path"), _mark_text().alias("marks")
    )


@query("b15_patch_places", TREES + f""" SELECT {NODE}, CASE WHEN node < 0 THEN 'new>' || places ELSE places END AS places,
  CASE WHEN rating = 1 AND node < 0 AND own >= 2 THEN '1-' || own || '-1' WHEN rating = 2 AND node = 0 THEN '0-' || (n - 1) || '-2' ELSE '' END AS marks FROM nodes""")
def _(spark, sf):
    t = sh.trees(spark, sf)
    front = t.where("size(node_path) = 0").select("route_idx", "node_path", F.concat(F.array(F.lit("new")), "places").alias("next"))
    return edits.patch_places(t, front).select(
        "route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"), _mark_text().alias("marks")
    )


@query("b16_remove_range", TREES + f""", cutrow AS (SELECT * FROM node_stops WHERE NOT (n >= 4 AND ((node = 0) OR (node = -1 AND pos = 2))))
 SELECT {NODE}, string_agg(place, '>' ORDER BY pos) AS places FROM cutrow GROUP BY route_id, node
 UNION ALL SELECT CAST(route_id AS INT), '0', '' FROM nodes WHERE node = 0 AND n >= 4""")
def _(spark, sf):
    t = sh.trees(spark, sf)
    tails = t.where("size(node_path) = 0 and size(places) >= 2").select("route_idx")
    ranges = t.where("size(node_path) = 1 and node_path[0] = 0").join(tails, "route_idx", "left_semi").select(
        "route_idx", "node_path", F.lit(0).alias("from"), F.lit(1).alias("to")
    )
    return edits.remove_range(t, ranges).select("route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"))


@query("b17_duplicated", TREES + """,
 idx AS (SELECT DISTINCT route_id, rating FROM nodes),
 twice AS (SELECT route_id, unnest(CASE WHEN rating = 1 THEN [0, 1] ELSE [0] END) AS copy FROM idx),
 placed AS (SELECT route_id, row_number() OVER (ORDER BY route_id, copy) - 1 AS new_idx FROM twice)
 SELECT CAST(new_idx AS INT) AS route_idx, CASE WHEN node < 0 THEN '' ELSE CAST(node AS VARCHAR) END AS node_path, places FROM placed JOIN nodes USING (route_id)""")
def _(spark, sf):
    t = sh.trees(spark, sf)
    rated = tb.order_priority(spark, sf).where("priority = 1").select(F.col("route_id").cast("int").alias("route_idx"))
    return edits.duplicate_routes(t, rated).select("route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"))


@query("b18_split_stops", r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), '|') AS stops FROM conversations""")
def _(spark, sf):
    return tb.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(edits.split_stops(F.col("text")), "|").alias("stops")
    )


@query("b19_row_flags", TREES + """,
 pr AS (SELECT route_id, max(CASE WHEN rating = 1 AND n - CASE WHEN n >= 3 THEN 2 ELSE 0 END >= 2 THEN 1
            WHEN rating = 2 AND node = 0 THEN 2 WHEN rating = 3 AND n >= 2 THEN 3 ELSE 0 END) AS worst FROM corridors GROUP BY 1)
 SELECT CAST(s.route_id AS INT) AS route_idx, bool_or(place % 100 = 13) AS compromised, CAST(any_value(worst) AS INT) AS worst,
        any_value(n) >= 3 AS branched, any_value(n) < 2 AS too_short FROM node_stops s JOIN pr USING (route_id) GROUP BY 1""")
def _(spark, sf):
    t = cut(tree.upgrade(sh.trees(spark, sf)), "upgraded")
    c = cut(tree.leaves(t), "leaves")
    closed = tb.closed_places(spark, sf, sh.net(spark, sf).stops).select(F.col("place").cast("string").alias("place"))
    return edits.row_flags(t, tree.route_priorities(c, tree.resolved_marks(t, c)), closed)


@query("b20_filtered_routes", TREES + """,
 pr AS (SELECT route_id, bool_or(rating = 3 AND n >= 2) AS bad FROM corridors GROUP BY 1)
 SELECT CAST(route_id AS INT) AS route_idx FROM node_stops JOIN pr USING (route_id) GROUP BY route_id
 HAVING bool_or(contains(CAST(place AS VARCHAR), '13')) AND bool_or(contains(CAST(place AS VARCHAR), '2')) AND any_value(bad)""")
def _(spark, sf):
    t = cut(tree.upgrade(sh.trees(spark, sf)), "upgraded")
    c = cut(tree.leaves(t), "leaves")
    return edits.filter_routes(t, tree.route_priorities(c, tree.resolved_marks(t, c)), ["13"], "2", [3])


# --- validation -----------------------------------------------------------


def _raw_trees(spark, sf) -> DataFrame:
    """The trees with faults: urgent orders carry a mark beyond their end, high ones two
    that overlap, and the last stop of an order of rating 3 repeats its first."""
    t = sh.trees(spark, sf)
    o = tb.table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("route_idx"), "o_orderpriority")
    root = F.size("node_path") == 0
    return t.join(o, "route_idx").select(
        "route_idx",
        "node_path",
        F.when(root & (F.col("o_orderpriority") == "5-LOW"), F.expr("concat(places, slice(places, 1, 1))")).otherwise(F.col("places")).alias("places"),
        F.when(root & (F.col("o_orderpriority") == "1-URGENT"), F.expr("array(named_struct('from', 0, 'to', size(places), 'priority', 1))"))
        .when(
            root & (F.col("o_orderpriority") == "2-HIGH") & (F.size("places") >= 3),
            F.expr("array(named_struct('from', 0, 'to', 2, 'priority', 1), named_struct('from', 1, 'to', 2, 'priority', 0))"),
        )
        .otherwise(F.col("marks"))
        .alias("marks"),
        F.when(root & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), 9).otherwise(F.col("priority")).cast("int").alias("priority"),
    )


_ROOTS = """, roots AS (SELECT route_id, node, n, own, o_orderpriority AS op FROM nodes JOIN orders ON o_orderkey = route_id WHERE node < 0)"""


@query("c1_place_violations", TREES + _ROOTS + " SELECT CAST(route_id AS INT) AS route_idx, 'too few places' AS rule, CAST(1 AS VARCHAR) AS detail FROM roots WHERE n = 1 AND op <> '5-LOW'")
def _(spark, sf):
    return va.place_violations(_raw_trees(spark, sf)).select("route_idx", "rule", "detail")


@query("c2_priority_violations", TREES + _ROOTS + " SELECT CAST(route_id AS INT) AS route_idx, 'priority out of range' AS rule, '9' AS detail FROM roots WHERE op = '4-NOT SPECIFIED'")
def _(spark, sf):
    return va.priority_violations(_raw_trees(spark, sf)).select("route_idx", "rule", "detail")


@query("c3_mark_violations", TREES + _ROOTS + """
 SELECT CAST(route_id AS INT) AS route_idx, 'mark outside the route' AS rule, '0' AS detail FROM roots WHERE op = '1-URGENT'
 UNION ALL SELECT CAST(route_id AS INT), 'marks overlap', '0' FROM roots WHERE op = '2-HIGH' AND own >= 3
 UNION ALL SELECT CAST(route_id AS INT), 'mark states the best priority', '1' FROM roots WHERE op = '2-HIGH' AND own >= 3""")
def _(spark, sf):
    return va.mark_violations(_raw_trees(spark, sf)).select("route_idx", "rule", "detail")


@query("c4_repeat_violations", TREES + _ROOTS + """ SELECT CAST(r.route_id AS INT) AS route_idx, 'place visited twice' AS rule, CAST(s.place AS VARCHAR) AS detail
 FROM roots r JOIN (SELECT route_id, arg_min(place, pos) AS place FROM node_stops WHERE node = -1 GROUP BY 1) s USING (route_id) WHERE op = '5-LOW'""")
def _(spark, sf):
    return va.repeat_violations(_raw_trees(spark, sf)).select("route_idx", "rule", "detail")


@query("c5_valid_routes", TREES + _ROOTS + """ SELECT CAST(route_id AS INT) AS route_idx FROM roots
 WHERE n > 1 AND (op = '3-MEDIUM' OR (op = '2-HIGH' AND own < 3))""")
def _(spark, sf):
    return va.valid_routes(_raw_trees(spark, sf))


def _typed_groups(spark, sf) -> DataFrame:
    """A closure group per order: its stops of sizes 13 and 14, the latter misspelt."""
    stops = sh.net(spark, sf).stops
    size = F.pmod("place", F.lit(100))
    name = F.when(size == 13, F.col("place").cast("string")).when(size == 14, F.concat(F.lit("x"), F.col("place").cast("string")))
    return stops.groupBy(F.col("route_id").alias("group_idx")).agg(F.collect_list(name).alias("places"))


@query("c6_closure_violations", EDGES + """
 SELECT route_id AS group_idx, 'empty group' AS rule, CAST(NULL AS VARCHAR) AS place FROM stops GROUP BY 1 HAVING NOT bool_or(place % 100 IN (13, 14))
 UNION ALL SELECT route_id, 'unknown place', 'x' || place FROM stops WHERE place % 100 = 14""")
def _(spark, sf):
    known = nw.places_of(sh.net(spark, sf).stops).select(F.col("place").cast("string").alias("text"))
    return va.closure_violations(_typed_groups(spark, sf), known)


@query("c7_unclaimed", EDGES + " SELECT CAST(place AS VARCHAR) AS text, place || ' אחר' AS keywords FROM places WHERE place % 100 <> 13")
def _(spark, sf):
    known = nw.places_of(sh.net(spark, sf).stops).select(F.col("place").cast("string").alias("text"))
    return va.unclaimed(known, _typed_groups(spark, sf))


@query("c8_corridor_places", TREES + f""" SELECT {NODE}, count(DISTINCT place) AS places FROM (
  SELECT a.route_id, a.node, b.place FROM nodes a JOIN node_stops b ON a.route_id = b.route_id AND (a.node = -1 OR b.node = -1 OR a.node = b.node)) GROUP BY 1, 2""")
def _(spark, sf):
    return va.corridor_places(sh.trees(spark, sf)).groupBy("route_idx", txt("node_path").alias("node_path")).agg(F.count("*").alias("places"))


@query("c9_unknown_places", EDGES + """ SELECT route_id AS qid, 'x' || place AS text, min(pos) AS pos FROM stops WHERE place % 2 = 1 GROUP BY 1, 2""")
def _(spark, sf):
    stops = sh.net(spark, sf).stops
    asked = stops.select(
        F.col("route_id").alias("qid"), "pos",
        F.when(F.pmod("place", F.lit(2)) == 1, F.concat(F.lit("x"), F.col("place").cast("string"))).otherwise(F.col("place").cast("string")).alias("text"),
    )
    return va.unknown_places(asked, nw.places_of(stops).select(F.col("place").cast("string").alias("text")))


@query("c10_admission", REG + """, ends AS (SELECT route_id, arg_min(place, pos) AS h, arg_max(place, pos) AS t, max(pos) AS last FROM stops GROUP BY 1)
 SELECT route_id AS qid, h AS start_place, CASE WHEN last > 0 AND t % 100 <> 13 THEN t END AS end_place,
  CASE WHEN last = 0 THEN 'error' WHEN t % 100 = 13 THEN 'empty' ELSE 'ok' END AS status FROM ends""")
def _(spark, sf):
    names_ = rg.with_display(sh.registry(spark, sf)).select(F.col("place_id").alias("place"), "display")
    ends = sh.net(spark, sf).stops.groupBy("route_id").agg(
        F.min_by("place", "pos").alias("h"), F.max_by("place", "pos").alias("t"), F.max("pos").alias("last")
    )
    typed = (
        ends.join(names_.select(F.col("place").alias("h"), F.col("display").alias("start")), "h")
        .join(names_.select(F.col("place").alias("t"), F.col("display").alias("d")), "t")
        .select(
            F.col("route_id").alias("qid"), "start",
            F.when(F.col("last") == 0, "  ").when(F.pmod("t", F.lit(100)) == 13, F.concat(F.lit("no "), "d")).otherwise(F.concat(F.lit(" "), "d")).alias("end"),
        )
    )
    return va.admit(typed, sh.registry(spark, sf))


# --- place dimension ------------------------------------------------------


@query("d1_parsed_names", REG + ' SELECT place_id, CASE WHEN grp <> \'other\' THEN grp END AS "group", CASE WHEN grp <> \'other\' THEN name END AS base FROM registry')
def _(spark, sf):
    return rg.with_display(sh.registry(spark, sf)).select(
        "place_id", tx.parsed_group(F.col("display")).alias("group"), tx.parsed_base(F.col("display")).alias("base")
    )


@query("d2_display_names", REG + " SELECT place_id, display FROM registry")
def _(spark, sf):
    return rg.with_display(sh.registry(spark, sf)).select("place_id", "display")


@query("d3_classified", REG + ' SELECT place_id, grp AS "group", label FROM registry')
def _(spark, sf):
    shown = rg.with_display(sh.registry(spark, sf)).select("place_id", tx.classify(F.col("display")).alias("group"))
    return shown.withColumn("label", tx.group_label(F.col("group")))


@query("d4_minted", TREES + """,
 seen AS (SELECT place, min((route_id, node, pos)) AS first FROM node_stops GROUP BY 1)
 SELECT CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS place_id, CAST(place AS VARCHAR) AS name, 'other' AS "group" FROM seen""")
def _(spark, sf):
    empty = spark.createDataFrame([], "place_id bigint, name string, `group` string")
    return rg.mint(sh.trees(spark, sf), empty)


@query("d5_resolved", REG + " SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, place_id FROM supplier LEFT JOIN registry ON display = 'מ. Site ' || s_suppkey || '/8'")
def _(spark, sf):
    typed = tb.table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit(" מ.Site "), F.col("s_suppkey").cast("string"), F.lit("/8 ")).alias("text")
    )
    return rg.resolve(typed, sh.registry(spark, sf)).select("s_suppkey", "place_id")


@query("d6_translated", REG + " SELECT route_id, string_agg(display, '|' ORDER BY pos) AS names FROM stops JOIN registry ON place_id = place GROUP BY 1")
def _(spark, sf):
    chains = sh.net(spark, sf).stops.groupBy("route_id").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, place))), e -> e.place)").alias("names")
    )
    return rg.translate(chains, sh.registry(spark, sf), ["route_id"], "names").select("route_id", F.array_join("names", "|").alias("names"))


@query("d7_trees_to_ids", TREES + f""",
 seen AS (SELECT place, min((route_id, node, pos)) AS first FROM node_stops GROUP BY 1),
 ids AS (SELECT place, row_number() OVER (ORDER BY first) AS id FROM seen)
 SELECT {NODE}, string_agg(id, '>' ORDER BY pos) AS places FROM node_stops JOIN ids USING (place) GROUP BY route_id, node""")
def _(spark, sf):
    empty = spark.createDataFrame([], "place_id bigint, name string, `group` string")
    t = sh.trees(spark, sf)
    reg = cut(rg.mint(t, empty), "minted")
    return rg.to_ids(t, reg).select("route_idx", txt("node_path").alias("node_path"), txt("places").alias("places"))


@query("d8_duplicates", "SELECT p_name AS name, 'other' AS \"group\", count(*) AS ids FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    reg = tb.table(spark, sf, "part").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), F.lit("other").alias("group"))
    return rg.duplicates(reg)


@query("d9_migration_counts", REG + ' SELECT grp AS "group", count(*) AS places FROM registry GROUP BY 1')
def _(spark, sf):
    return rg.migration_counts(rg.with_display(sh.registry(spark, sf)).select(F.col("display").alias("text")))


@query("d10_reclassified", REG + ' SELECT place_id, name, grp AS "group" FROM registry')
def _(spark, sf):
    # Every place as registered before any prefix was known.
    old = rg.with_display(sh.registry(spark, sf)).select("place_id", F.col("display").alias("name"), F.lit("other").alias("group"))
    return rg.reclassify(old)[0]


@query("d11_group_counts", REG + " SELECT CAST(any_value(g) AS INT) AS ord, grp AS key, label, count(*) AS places FROM registry JOIN reg0 USING (place_id) GROUP BY grp, label")
def _(spark, sf):
    return rg.group_counts(rg.with_display(sh.registry(spark, sf)).select(F.col("display").alias("text")))


@query("d12_keywords", REG + " SELECT display AS text, display || ' ' || label AS keywords FROM registry")
def _(spark, sf):
    return rg.filter_options(rg.with_display(sh.registry(spark, sf)).select(F.col("display").alias("text")))


# --- marks ----------------------------------------------------------------


@query("f1_rated_marks", MARKS + " SELECT route_id, start_place, end_place, priority FROM marks")
def _(spark, sf):
    stops = tb.stops(spark, sf)
    return mk.rated(tb.marks(spark, sf, stops))


@query("f2_route_priority", MARKS + " SELECT route_id, max(priority) AS priority FROM marks GROUP BY 1")
def _(spark, sf):
    return mk.route_priority(tb.marks(spark, sf, tb.stops(spark, sf)))


@query("f2_worst_priority", MARKS + " SELECT CAST(coalesce(max(priority), 0) AS INT) AS worst, count(*) > 0 AS has_priorities FROM marks")
def _(spark, sf):
    return mk.worst_priority(tb.marks(spark, sf, tb.stops(spark, sf)))


@query("f3_run_priority", MARKS + """ SELECT l.route_id AS span_id, CAST(coalesce(max(m.priority), 0) AS INT) AS priority
 FROM lasts l LEFT JOIN marks m ON m.route_id = l.route_id AND last - 1 >= 2 GROUP BY 1""")
def _(spark, sf):
    # The span is the route without its last stop.
    spans = sh.net(spark, sf).stops.groupBy("route_id").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, place))), e -> e.place)").alias("p")
    ).select(F.col("route_id").alias("span_id"), "route_id", F.expr("slice(p, 1, size(p) - 1)").alias("places"))
    return mk.run_priority(spans, sh.net(spark, sf).marks).select("span_id", "priority")


@query("c5_raw_document_violations", EDGES + """,
 odd AS (SELECT DISTINCT route_id, route_id % 9 AS k FROM stops)
 SELECT CAST(route_id AS INT) AS route_idx, CASE k WHEN 7 THEN '0' ELSE '' END AS node, CASE k WHEN 1 THEN 'places is not a list' WHEN 2 THEN 'priority is not a whole number'
   WHEN 3 THEN 'not a route' WHEN 4 THEN 'branches is not a list' WHEN 5 THEN 'marks is not a list' WHEN 6 THEN 'a place is not text'
   WHEN 7 THEN 'priority is not a whole number' WHEN 8 THEN 'a mark is not three whole numbers' END AS rule FROM odd WHERE k > 0
 UNION ALL SELECT CAST(route_id AS INT), '', 'places is not a list' FROM odd WHERE k = 3""")
def _(spark, sf):
    # Every order as a document, eight of nine spoilt in one of eight ways.
    n = sh.net(spark, sf)
    docs = n.stops.groupBy("route_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, place))), e -> cast(e.place as string))").alias("p"))
    places, numbers = F.to_json("p"), F.concat(F.lit("["), F.array_join("p", ","), F.lit("]"))
    spoilt = {
        0: F.concat(F.lit('{"places": '), places, F.lit(', "priority": 1}')),
        1: F.concat(F.lit('{"places": "'), F.col("p")[0], F.lit('"}')),
        2: F.concat(F.lit('{"places": '), places, F.lit(', "priority": "high"}')),
        3: F.concat(F.lit('"'), F.col("p")[0], F.lit('"')),
        4: F.concat(F.lit('{"places": '), places, F.lit(', "branches": {}}')),
        5: F.concat(F.lit('{"places": '), places, F.lit(', "marks": "abc"}')),
        6: numbers,
        7: F.concat(F.lit('{"places": '), places, F.lit(', "branches": [{"places": ["x"], "priority": true}]}')),
        8: F.concat(F.lit('{"places": '), places, F.lit(', "marks": [{"from": 0, "to": 1.5, "priority": 1}]}')),
    }
    doc = F.lit(None).cast("string")
    for k, text in spoilt.items():
        doc = F.when(F.col("route_id") % 9 == k, text).otherwise(doc)
    raw = dc.unfold(docs.select(F.col("route_id").cast("int").alias("route_idx"), doc.alias("doc")))
    return dc.shape_violations(raw).select("route_idx", F.array_join(F.transform("node_path", lambda x: x.cast("string")), ">").alias("node"), "rule")


@query("f4_simple_routes", EDGES + """ SELECT e.route_id, true AS simple, least(h.place, t.place) AS first_end, greatest(h.place, t.place) AS last_end, any_value(n) AS places
 FROM (SELECT route_id, max(pos) AS last, count(*) AS n FROM stops GROUP BY 1) e JOIN stops h ON h.route_id = e.route_id AND h.pos = 0
 JOIN stops t ON t.route_id = e.route_id AND t.pos = last WHERE last > 0 GROUP BY ALL""")
def _(spark, sf):
    return mk.simple_routes(sh.net(spark, sf).edges)


_SIMPLE = """ near_of AS (SELECT route_id, place, count(*) AS near FROM (SELECT route_id, a AS place FROM cut_edges UNION ALL SELECT route_id, b FROM cut_edges) GROUP BY 1, 2)
 SELECT route_id, sum(CASE WHEN near = 1 THEN 1 ELSE 0 END) = 2 AND max(near) <= 2 AND sum(near) = 2 * (count(*) - 1) AS simple,
        min(CASE WHEN near = 1 THEN place END) AS first_end, max(CASE WHEN near = 1 THEN place END) AS last_end, count(*) AS places
 FROM near_of GROUP BY 1"""


@query("f4_simple_after_closures", EDGES + "," + tb.CLOSED_SQL + """,
 cut_edges AS (SELECT * FROM edges WHERE a NOT IN (SELECT place FROM closed) AND b NOT IN (SELECT place FROM closed)),""" + _SIMPLE)
def _(spark, sf):
    n = sh.net(spark, sf)
    kept, _deg = nw.without_places(n.edges, n.degree, tb.closed_places(spark, sf, n.stops))
    return mk.simple_routes(kept)


@query("f4_simple_beside_rings", EDGES + """,
 three AS (SELECT route_id FROM stops GROUP BY 1 HAVING count(*) >= 3),
 ring AS (SELECT x.route_id - 1 AS route_id, -x.place AS p, -y.place AS q FROM stops x JOIN stops y ON x.route_id = y.route_id AND x.pos < y.pos
          WHERE y.pos < 3 AND x.route_id IN (SELECT route_id FROM three)),
 cut_edges AS (SELECT route_id, a, b FROM edges UNION SELECT route_id, least(p, q), greatest(p, q) FROM ring),""" + _SIMPLE)
def _(spark, sf):
    # Beside its own path each route gets a ring of three places that no route knows.
    n = sh.net(spark, sf)
    first = n.stops.where("pos < 3").groupBy("route_id").agg(F.sort_array(F.collect_list("place")).alias("p")).where("size(p) = 3")
    ring = first.select(
        (F.col("route_id") - 1).alias("route_id"), F.explode(F.expr("array(struct(-p[1] as a, -p[0] as b), struct(-p[2] as a, -p[1] as b), struct(-p[2] as a, -p[0] as b))")).alias("e")
    ).select("route_id", "e.a", "e.b")
    return mk.simple_routes(n.edges.select("route_id", "a", "b").unionByName(ring).distinct())


@query("f5_marked_edges_of_returns", MARKS + """,
 back AS (SELECT s.route_id, 2 * last - s.pos AS pos, s.place FROM stops s JOIN lasts USING (route_id) WHERE s.pos < last AND last >= 2 AND s.pos > 0
          UNION ALL SELECT route_id, pos, place FROM stops),
 ends2 AS (SELECT route_id, 2 * last AS pos, s.place FROM stops s JOIN lasts USING (route_id) WHERE s.pos = 1 AND last >= 2),
 walked AS (SELECT * FROM back UNION ALL SELECT route_id, pos, place + 50 FROM ends2),
 cut_edges AS (SELECT DISTINCT x.route_id, least(x.place, y.place) AS a, greatest(x.place, y.place) AS b
   FROM walked x JOIN walked y ON x.route_id = y.route_id AND y.pos = x.pos + 1),
 near_of AS (SELECT route_id, place, count(*) AS near FROM (SELECT route_id, a AS place FROM cut_edges UNION ALL SELECT route_id, b FROM cut_edges) GROUP BY 1, 2),
 shape AS (SELECT route_id, sum(CASE WHEN near = 1 THEN 1 ELSE 0 END) = 2 AND max(near) <= 2 AND sum(near) = 2 * (count(*) - 1) AS simple FROM near_of GROUP BY 1)
 SELECT c.route_id, c.a, c.b, m.priority FROM cut_edges c JOIN shape USING (route_id) JOIN marks m USING (route_id) WHERE NOT simple""")
def _(spark, sf):
    # Every route of three stops or more goes back the way it came and ends beside its second
    # stop: it forks there, so it is no simple path and counts as marked throughout.
    n = sh.net(spark, sf)
    last = n.stops.groupBy("route_id").agg(F.max("pos").alias("last")).where("last >= 2")
    own = n.stops.join(last, "route_id")
    # One pass, not a union of three reads of the same partitions: those may be dealt anew in only some of its branches.
    walked = own.select("route_id", F.explode(F.expr("""flatten(array(
        array(struct(pos, place)),
        if(pos > 0 and pos < last, array(struct(cast(2 * last - pos as int) as pos, place)), array()),
        if(pos = 1, array(struct(cast(2 * last as int) as pos, place + 50 as place)), array())))""")).alias("s")).select("route_id", "s.pos", "s.place")
    return mk.marked_edges(walked, n.marks.join(last.select("route_id"), "route_id", "left_semi"))


@query("f5_marked_edges", MARKS + """ SELECT h.route_id, least(p, q) AS a, greatest(p, q) AS b, m.priority
 FROM hops h JOIN marks m USING (route_id) WHERE h.pos < 2""")
def _(spark, sf):
    n = sh.net(spark, sf)
    return mk.marked_edges(n.stops, n.marks)


@query("f5_marked_edges_closed", MARKS + "," + tb.CLOSED_SQL + """,
 left_hops AS (SELECT h.route_id, pos, least(p, q) AS a, greatest(p, q) AS b FROM hops h
   WHERE p NOT IN (SELECT place FROM closed) AND q NOT IN (SELECT place FROM closed) AND route_id IN (SELECT route_id FROM marks)),
 shape AS (SELECT route_id, max(pos) - min(pos) + 1 = count(*) AS simple, min(pos) AS f, max(pos) + 1 AS l FROM left_hops GROUP BY 1)
 SELECT h.route_id, a, b, m.priority FROM left_hops h JOIN shape s USING (route_id) JOIN marks m USING (route_id) JOIN lasts USING (route_id)
 WHERE NOT simple OR (f = 0 AND l >= least(last, 2) AND h.pos < 2)""")
def _(spark, sf):
    n = sh.net(spark, sf)
    kept, _deg = nw.without_places(n.edges, n.degree, tb.closed_places(spark, sf, n.stops))
    return mk.marked_edges(n.stops, n.marks, kept)


@query("f6_edge_priority", MARKS + """,
 marked AS (SELECT h.route_id, least(p, q) AS a, greatest(p, q) AS b, m.priority FROM hops h JOIN marks m USING (route_id) WHERE h.pos < 2)
 SELECT a, b, CAST(min(coalesce(priority, 0)) AS INT) AS priority FROM edges LEFT JOIN marked USING (route_id, a, b) GROUP BY 1, 2""")
def _(spark, sf):
    n = sh.net(spark, sf)
    return mk.edge_priority(n.edges, mk.marked_edges(n.stops, n.marks))


def _splice_spans(spark, sf) -> DataFrame:
    n = sh.net(spark, sf)

    def make():
        member = sc.memberships(sh.splices(spark, sf), n.edges, ["chain_id"])
        return cut(mk.on_route_spans(member, ["chain_id"]), "spans")

    return sh.once("splice_spans", spark, sf, make)


def _scored(spark, sf) -> DataFrame:
    return sh.once(
        "scored", spark, sf, lambda: cut(sc.score(sh.splices(spark, sf), sh.net(spark, sf), ["chain_id"]), "scored")
    )


@query("h6_routeless_returns", EDGES + """,
 there AS (SELECT route_id AS chain_id, pos AS i, place FROM stops),
 sizes2 AS (SELECT route_id AS chain_id, max(pos) AS last FROM stops GROUP BY 1),
 walk AS (SELECT * FROM there UNION ALL SELECT chain_id, 2 * last - i, place FROM there JOIN sizes2 USING (chain_id) WHERE i < last),
 walk_hops AS (SELECT x.chain_id, x.i, least(x.place, y.place) AS a, greatest(x.place, y.place) AS b FROM walk x JOIN walk y ON x.chain_id = y.chain_id AND y.i = x.i + 1)
 SELECT chain_id, CAST(i AS INT) AS i, -min(i) OVER (PARTITION BY chain_id, a, b) - 1 AS route_id FROM walk_hops""")
def _(spark, sf):
    # There and back over edges no route carries: every edge is one route, ridden twice.
    n = sh.net(spark, sf)
    chains = n.stops.groupBy("route_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, place))), e -> e.place)").alias("p")).select(
        F.col("route_id").alias("chain_id"), F.expr("concat(p, slice(reverse(p), 2, size(p) - 1))").alias("stops")
    )
    return sc.memberships(chains, n.edges.where("false"), ["chain_id"])


@query("f7_on_route_spans", SPLICES + " SELECT chain_id, route_id, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi FROM spans")
def _(spark, sf):
    return _splice_spans(spark, sf)


@query("f8_ridden_marks", SPLICES + " SELECT chain_id, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, priority FROM ridden")
def _(spark, sf):
    return mk.ridden_marks(sh.splices(spark, sf), _splice_spans(spark, sf), sh.net(spark, sf).marks, ["chain_id"])


@query("f9_stamped_hops", SPLICES + """ SELECT h.chain_id, CAST(h.i AS INT) AS i, CAST(coalesce(max(r.priority), 0) AS INT) AS priority
 FROM chain_hops h LEFT JOIN ridden r ON r.chain_id = h.chain_id AND r.lo < h.i + 1 AND h.i < r.hi GROUP BY 1, 2""")
def _(spark, sf):
    # Every hop as a run of its own: the finest tiling.
    ch_ = sh.splices(spark, sf)
    runs = mk.chain_hops(ch_, ["chain_id"]).select("chain_id", F.col("i").alias("run"), F.col("i").alias("first"), (F.col("i") + 1).alias("last"))
    ridden = mk.ridden_marks(ch_, _splice_spans(spark, sf), sh.net(spark, sf).marks, ["chain_id"])
    return mk.stamp_runs(runs, ridden, ["chain_id"]).select("chain_id", F.col("run").alias("i"), "priority")


@query("f10_tiers", SPLICES + """ SELECT c.chain_id, CAST(coalesce(max(r.priority), 0) AS INT) AS tier
 FROM (SELECT DISTINCT chain_id FROM chain_stops) c LEFT JOIN ridden r USING (chain_id) GROUP BY 1""")
def _(spark, sf):
    ch_ = sh.splices(spark, sf)
    return mk.tiers(ch_, mk.ridden_marks(ch_, _splice_spans(spark, sf), sh.net(spark, sf).marks, ["chain_id"]), ["chain_id"])


# --- scoring --------------------------------------------------------------


@query("g1_edge_units", EDGES + """ SELECT a, b, CAST(p.degree >= 3 AS INT) + CAST(q.degree >= 3 AS INT) AS unit
 FROM links JOIN degree p ON p.place = a JOIN degree q ON q.place = b""")
def _(spark, sf):
    n = sh.net(spark, sf)
    return sc.edge_units(n.edges, n.degree)


@query("g2_prefix_lengths", SPLICES + " SELECT chain_id, CAST(j - 1 AS INT) AS i, CAST(len AS BIGINT) AS length FROM prefix")
def _(spark, sf):
    n = sh.net(spark, sf)
    units = mk.chain_hops(sh.splices(spark, sf), ["chain_id"]).join(sc.edge_units(n.edges, n.degree), ["a", "b"])
    return sc.prefix_lengths(units, ["chain_id"]).select("chain_id", "i", "length")


# The optimum by growing a list of best values hop by hop.
_DP = """,
 reach0 AS (SELECT m.chain_id, m.i, min(s.lo) AS lo FROM member m JOIN spans s ON s.chain_id = m.chain_id AND s.route_id = m.route_id AND m.i >= s.lo AND m.i < s.hi GROUP BY 1, 2),
 lists AS (SELECT chain_id, list(lo ORDER BY i) AS reach, list(len ORDER BY i) AS lens FROM reach0 JOIN (SELECT chain_id, j - 1 AS i, CAST(len AS BIGINT) AS len FROM prefix) USING (chain_id, i) GROUP BY 1),
 dp AS (SELECT chain_id, reach, list_prepend(CAST(0 AS BIGINT), lens) AS p, [CAST(0 AS BIGINT)] AS best FROM lists
   UNION ALL
   SELECT chain_id, reach, p, list_append(best, list_max(list_transform(range(reach[len(best)], len(best)), lambda i: best[i + 1] + (p[len(best) + 1] - p[i + 1]) * (p[len(best) + 1] - p[i + 1]))))
   FROM dp WHERE len(best) <= len(reach)),
 done AS (SELECT chain_id, p[-1] AS length, best[-1] AS squares FROM dp WHERE len(best) = len(reach) + 1)"""


@query("g3_best_assignment", SPLICES + _DP + " SELECT chain_id, length, squares FROM done")
def _(spark, sf):
    return _scored(spark, sf).where("total_hops > 0").select(
        "chain_id", "length", F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["length"] * r["length"]).alias("squares")
    )


# The same optimum with its way back: value, transfers and start of the last run in one number.
_BACK = """,
 reach0 AS (SELECT m.chain_id, m.i, min(s.lo) AS lo FROM member m JOIN spans s ON s.chain_id = m.chain_id AND s.route_id = m.route_id AND m.i >= s.lo AND m.i < s.hi GROUP BY 1, 2),
 lists AS (SELECT chain_id, list(lo ORDER BY i) AS reach, list(len ORDER BY i) AS lens FROM reach0 JOIN (SELECT chain_id, j - 1 AS i, CAST(len AS BIGINT) AS len FROM prefix) USING (chain_id, i) GROUP BY 1),
 dp AS (SELECT chain_id, reach, list_prepend(CAST(0 AS BIGINT), lens) AS p, [CAST(1000999 AS BIGINT)] AS best FROM lists
   UNION ALL
   SELECT chain_id, reach, p, list_append(best, list_max(list_transform(range(reach[len(best)], len(best)), lambda i:
     ((best[i + 1] // 1000000000) + (p[len(best) + 1] - p[i + 1]) * (p[len(best) + 1] - p[i + 1])) * 1000000000
     + ((best[i + 1] % 1000000000) // 1000 - 1) * 1000 + 999 - i)))
   FROM dp WHERE len(best) <= len(reach)),
 whole AS (SELECT chain_id, p, best, len(reach) AS n FROM dp WHERE len(best) = len(reach) + 1),
 trace AS (SELECT chain_id, CAST(n AS BIGINT) AS last, 999 - best[n + 1] % 1000 AS first FROM whole
   UNION ALL SELECT t.chain_id, t.first, 999 - w.best[t.first + 1] % 1000 FROM trace t JOIN whole w USING (chain_id) WHERE t.first > 0),
 cut_runs AS (SELECT t.chain_id, row_number() OVER (PARTITION BY t.chain_id ORDER BY t.last) - 1 AS run, t.first, t.last, w.p[t.last + 1] - w.p[t.first + 1] AS length
   FROM trace t JOIN whole w USING (chain_id))"""


@query("g4_runs", SPLICES + _BACK + """ SELECT c.chain_id, CAST(c.run AS INT) AS run,
 (SELECT min(s.route_id) FROM spans s WHERE s.chain_id = c.chain_id AND s.lo <= c.first AND c.last <= s.hi) AS route_id, c.length, CAST(c.last - c.first AS INT) AS hops,
 CAST(coalesce((SELECT max(r.priority) FROM ridden r WHERE r.chain_id = c.chain_id AND r.lo < c.last AND c.first < r.hi), 0) AS INT) AS priority,
 f.place AS start_place, t.place AS end_place
 FROM cut_runs c JOIN chain_stops f ON f.chain_id = c.chain_id AND f.k = c.first JOIN chain_stops t ON t.chain_id = c.chain_id AND t.k = c.last""")
def _(spark, sf):
    return _scored(spark, sf).select("chain_id", F.posexplode("runs").alias("run", "r")).select("chain_id", "run", "r.*")


@query("g5_concentration", SPLICES + _DP + " SELECT chain_id, round(squares / (CAST(length AS DOUBLE) * length), 6) AS hhi FROM done WHERE length > 0")
def _(spark, sf):
    return _scored(spark, sf).where("length > 0").select("chain_id", F.round("hhi", 6).alias("hhi"))


@query("g6_chain_lengths", SPLICES + " SELECT chain_id, CAST(sum(CAST(degree >= 3 AS INT)) AS BIGINT) AS crossroad_hops FROM chain_stops JOIN degree USING (place) GROUP BY 1")
def _(spark, sf):
    return sc.chain_lengths(sh.splices(spark, sf), sh.net(spark, sf).degree, ["chain_id"])


@query("g6_chain_hops", SPLICES + " SELECT chain_id, count(*) - 1 AS crossroad_hops FROM chain_stops GROUP BY 1")
def _(spark, sf):
    return sc.chain_lengths(sh.splices(spark, sf), sh.net(spark, sf).degree, ["chain_id"], crossroads_only=False)


@query("g11_records", SPLICES + """ SELECT chain_id, count(*) - 1 AS total_hops,
 coalesce((SELECT max(priority) FROM ridden r WHERE r.chain_id = c.chain_id), 0) AS priority FROM chain_stops c GROUP BY 1""")
def _(spark, sf):
    return _scored(spark, sf).select("chain_id", F.col("total_hops").cast("long").alias("total_hops"), "priority")


_FLAGS = """,
 flag AS (SELECT place, CAST(degree >= 3 AS INT) AS x FROM degree)"""

def _walk(name: str, seeds: str, step: str) -> str:
    """A label-correcting walk over neighbours, keyed by source and place."""
    return f"""{name}(src, place, cost) USING KEY (src, place) AS (
   {seeds}
   UNION
   SELECT w.src, n.neighbour, min(w.cost + {step}) AS cost
   FROM {name} w JOIN near n ON n.place = w.place JOIN flag f ON f.place = n.neighbour
   LEFT JOIN recurring.{name} r ON r.src = w.src AND r.place = n.neighbour
   WHERE r.cost IS NULL OR w.cost + {step} < r.cost
   GROUP BY 1, 2)"""


@query("g7_crossroad_distance", OD + _FLAGS + "," + _walk("w", "SELECT DISTINCT start_place AS src, start_place AS place, CAST(x AS BIGINT) AS cost FROM od JOIN flag ON place = start_place", "f.x") + """
 SELECT od.qid, start_place AS src, end_place AS dst, w.cost AS distance FROM od LEFT JOIN w ON w.src = start_place AND w.place = end_place""")
def _(spark, sf):
    pairs = sh.trips(spark, sf).select("qid", F.col("start_place").alias("src"), F.col("end_place").alias("dst"))
    return se.crossroad_distance(pairs, sh.trip_net(spark, sf), sh.ready(spark, sf).rail).select("qid", "src", "dst", "distance")


@query("g8_point_distance", OD + _FLAGS + "," + _walk("w", "SELECT src, src AS place, CAST(x AS BIGINT) AS cost FROM (SELECT start_place AS src FROM od UNION SELECT via_place FROM od) JOIN flag ON place = src", "f.x") + """
 SELECT od.qid, CAST(CASE WHEN u.cost IS NULL OR v.cost IS NULL THEN 0 ELSE greatest(u.cost + v.cost - x, 0) END AS BIGINT) AS c_min
 FROM od JOIN flag ON flag.place = via_place LEFT JOIN w u ON u.src = start_place AND u.place = via_place LEFT JOIN w v ON v.src = via_place AND v.place = end_place""")
def _(spark, sf):
    points = sh.trips(spark, sf).select("qid", F.concat(F.array("start_place"), "via", F.array("end_place")).alias("points"))
    return se.point_distance(points, sh.trip_net(spark, sf), sh.ready(spark, sf).rail).select("qid", "c_min")


@query("g12_hop_distances", OD + _FLAGS + "," + _walk("w", "SELECT DISTINCT start_place AS src, start_place AS place, CAST(0 AS BIGINT) AS cost FROM od", "1") + " SELECT src, place, cost FROM w")
def _(spark, sf):
    return se.hop_distances(sh.trips(spark, sf).select(F.col("start_place").alias("src")), sh.ready(spark, sf).rail)


# --- search ---------------------------------------------------------------

_COMP = """comp(place, component) USING KEY (place) AS (
   SELECT place, place AS component FROM places
   UNION
   SELECT n.neighbour, min(c.component) FROM comp c JOIN near n ON n.place = c.place
   JOIN recurring.comp r ON r.place = n.neighbour WHERE c.component < r.component GROUP BY 1)"""

_H1 = OD + _FLAGS + """, st(qid, place, route, cost) USING KEY (qid, place, route) AS (
   SELECT qid, start_place AS place, CAST(-1 AS BIGINT) AS route, CAST(0 AS BIGINT) AS cost FROM od
   UNION
   SELECT s.qid, CASE WHEN e.a = s.place THEN e.b ELSE e.a END AS place, e.route_id, min(s.cost + f.x + CASE WHEN e.route_id = s.route THEN 0 ELSE 1000000 END + {toll}) AS cost
   FROM st s JOIN both_edges e ON e.here = s.place JOIN flag f ON f.place = e.there
   LEFT JOIN recurring.st r ON r.qid = s.qid AND r.place = e.there AND r.route = e.route_id
   WHERE r.cost IS NULL OR s.cost + f.x + CASE WHEN e.route_id = s.route THEN 0 ELSE 1000000 END + {toll} < r.cost
   GROUP BY ALL)
 SELECT od.qid, min(cost) AS cost FROM od JOIN st ON st.qid = od.qid AND st.place = od.end_place GROUP BY 1"""
_H1 = _H1.replace(", st(qid", """,
 both_edges AS (SELECT a, b, a AS here, b AS there, route_id FROM edges UNION ALL SELECT a, b, b, a, route_id FROM edges), st(qid""")


def _cheapest(spark, sf, **cost) -> DataFrame:
    ends = sh.trips(spark, sf).withColumnRenamed("start_place", "src").withColumnRenamed("end_place", "dst")
    probes = cut(se.plain_searches(ends, F.col("qid"), **cost), "probes")
    return se.found(se.search(probes, sh.ready(spark, sf).rail, ends_alone=True), probes).select(F.col("sid").alias("qid"), "cost")


@query("h1_cheapest_cost", _H1.format(toll="0"))
def _(spark, sf):
    return _cheapest(spark, sf)


@query("h2_every_edge_charged_cost", _H1.format(toll="1000000"))
def _(spark, sf):
    return _cheapest(spark, sf, step=ch.TRANSFER_WEIGHT)


@query("h3_tier_zero_cost", _H1.replace("both_edges AS (SELECT a, b, a AS here, b AS there, route_id FROM edges UNION ALL SELECT a, b, b, a, route_id FROM edges)", tb.MARKS_SQL.strip().lstrip(",") + """,
 marked AS (SELECT h.route_id, least(p, q) AS a, greatest(p, q) AS b, m.priority FROM hops h JOIN marks m USING (route_id) WHERE h.pos < 2),
 eprio AS (SELECT a, b, min(coalesce(priority, 0)) AS worst FROM edges LEFT JOIN marked USING (route_id, a, b) GROUP BY 1, 2),
 both_edges AS (SELECT a, b, a AS here, b AS there, route_id, worst FROM edges JOIN eprio USING (a, b) UNION ALL SELECT a, b, b, a, route_id, worst FROM edges JOIN eprio USING (a, b))""").format(
    toll="CASE WHEN e.worst > 0 THEN 1000000 * (SELECT count(*) + 1 FROM places) ELSE 0 END"))
def _(spark, sf):
    return _cheapest(spark, sf, tier=F.lit(0), ban=sh.ready(spark, sf).ban)


_TIERS = """both_edges AS (SELECT a, b, a AS here, b AS there, route_id, worst FROM edges JOIN eprio USING (a, b) UNION ALL SELECT a, b, b, a, route_id, worst FROM edges JOIN eprio USING (a, b))"""
_MARKED = tb.MARKS_SQL.strip().lstrip(",") + """,
 marked AS (SELECT h.route_id, least(p, q) AS a, greatest(p, q) AS b, m.priority FROM hops h JOIN marks m USING (route_id) WHERE h.pos < 2),
 eprio AS (SELECT a, b, min(coalesce(priority, 0)) AS worst FROM edges LEFT JOIN marked USING (route_id, a, b) GROUP BY 1, 2),
 """
_PLAIN_EDGES = "both_edges AS (SELECT a, b, a AS here, b AS there, route_id FROM edges UNION ALL SELECT a, b, b, a, route_id FROM edges)"


def _tier_cost(name: str, tier: int) -> None:
    @query(name, _H1.replace(_PLAIN_EDGES, _MARKED + _TIERS).format(
        toll=f"CASE WHEN e.worst > {tier} THEN 1000000 * (SELECT count(*) + 1 FROM places) ELSE 0 END"))
    def _(spark, sf):
        return _cheapest(spark, sf, tier=F.lit(tier), ban=sh.ready(spark, sf).ban)


_tier_cost("h3_tier_one_cost", 1)
_tier_cost("h3_tier_two_cost", 2)


@query("h4_avoiding_via_cost", _H1.replace("FROM st s JOIN both_edges", "FROM st s JOIN od o ON o.qid = s.qid JOIN both_edges").format(
    toll="CASE WHEN o.via_place IN (e.a, e.b) THEN 1000000 * (SELECT count(*) + 1 FROM places) ELSE 0 END"))
def _(spark, sf):
    return _cheapest(spark, sf, banned=F.col("via"), ban=sh.ready(spark, sf).ban)


@query("h5_stacked_cost", _H1.replace("FROM st s JOIN both_edges", "FROM st s JOIN od o ON o.qid = s.qid JOIN both_edges").format(
    toll="(1000000 + CASE WHEN o.via_place IN (e.a, e.b) THEN 1000000 * (SELECT count(*) + 1 FROM places) ELSE 0 END)"))
def _(spark, sf):
    return _cheapest(spark, sf, step=ch.TRANSFER_WEIGHT, banned=F.col("via"), ban=sh.ready(spark, sf).ban)


@query("h6_routeless_edges", OD + _FLAGS + "," + _walk("w", "SELECT DISTINCT start_place AS src, start_place AS place, CAST(0 AS BIGINT) AS cost FROM od", "f.x + 1000000") + " SELECT qid, w.cost FROM od JOIN w ON w.src = start_place AND w.place = end_place")
def _(spark, sf):
    # The network's edges without their routes: every edge is its own.
    n = sh.net(spark, sf)
    bare = nw.links(n.edges)
    none = sc.Network(n.stops.where("false"), n.edges.where("false"), n.degree, n.marks.where("false"))
    rail = cut(se.rails(none, bare=bare), "rail")
    ends = sh.trips(spark, sf).withColumnRenamed("start_place", "src").withColumnRenamed("end_place", "dst")
    probes = cut(se.plain_searches(ends, F.col("qid")), "probes")
    return se.found(se.search(probes, rail, ends_alone=True), probes).select(F.col("sid").alias("qid"), "cost")


@query("h7_candidate_pool")
def _(spark, sf):
    return sh.plain_pool(spark, sf).select("qid", "cid", txt("stops").alias("stops"))


@query("h10_corridors_once")
def _(spark, sf):
    return sh.plain_pool(spark, sf).groupBy("qid", F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["a"], e["b"])), ",").alias("edges")).agg(F.count("*").alias("n"))


@query("h11_leading_arteries")
def _(spark, sf):
    return pool.leading_arteries(sh.plain_pool(spark, sf))


@query("h13_required_stops", OD + """ SELECT qid, CASE WHEN via_place IN (start_place, end_place) THEN '' ELSE CAST(via_place AS VARCHAR) END AS via FROM od""")
def _(spark, sf):
    doubled = sh.trips(spark, sf).withColumn("via", F.concat("via", F.array("start_place"), "via"))
    return legs.normalise_via(doubled).select("qid", txt("via").alias("via"))


@query("h14_best_order", OD + "," + _COMP + """ SELECT qid, start_place || '>' || via_place || '>' || end_place AS points FROM od
 JOIN comp x ON x.place = start_place JOIN comp y ON y.place = via_place JOIN comp z ON z.place = end_place
 WHERE via_place NOT IN (start_place, end_place) AND x.component = y.component AND y.component = z.component""")
def _(spark, sf):
    asked = legs.normalise_via(sh.trips(spark, sf)).where(F.size("via") > 0)
    return legs.best_order(cut(asked, "via"), sh.ready(spark, sf)).select("qid", txt("points").alias("points"))


@query("h15_leg_candidates")
def _(spark, sf):
    return sh.leg_parts(spark, sf)[1].select("qid", "leg", "slot", txt("stops").alias("stops"), F.round("hhi", 6).alias("hhi"))


@query("h16_leg_combinations")
def _(spark, sf):
    return sh.via_pool(spark, sf).select("qid", "cid", txt("stops").alias("stops"))


@query("g9_ranking_score")
def _(spark, sf):
    return sh.plain_pool(spark, sf).select("qid", "cid", F.round("q", 6).alias("q"), F.round("hhi", 6).alias("hhi"), "c_min", "crossroad_hops")


@query("g10_combined_legs")
def _(spark, sf):
    return sh.via_pool(spark, sf).select("qid", "cid", F.round("hhi", 6).alias("hhi"), "priority", F.size("legs").alias("legs"))


# --- ranking and selection ------------------------------------------------


@query("i1_ranked_pool")
def _(spark, sf):
    return pool.ranked(sh.plain_pool(spark, sf)).select("qid", "rank", "cid", F.round("q", 6).alias("q"))


@query("i2_diverse_routes")
def _(spark, sf):
    return select.select_diverse(sh.plain_pool(spark, sf)).select("qid", "slot", txt("stops").alias("stops"), "priority", F.round("q", 6).alias("q"))


@query("i4_length_baseline")
def _(spark, sf):
    return select.length_baseline(sh.plain_pool(spark, sf))


@query("i5_priority_blind")
def _(spark, sf):
    return select.select_diverse(sh.plain_pool(spark, sf), 3, hard_tier=False).select("qid", "slot", txt("stops").alias("stops"), "priority")


@query("i6_excluding_closed")
def _(spark, sf):
    closed = tb.closed_places(spark, sf, sh.trip_net(spark, sf).stops)
    return select.excluding(sh.plain_pool(spark, sf), closed).select("qid", "cid", txt("stops").alias("stops"))


@query("i7_find_routes")
def _(spark, sf):
    top = sh.plain_top(spark, sf)
    return legs.chains_only(top).select("qid", "slot", txt("stops").alias("stops"))


@query("i7_find_routes_via")
def _(spark, sf):
    return sh.via_top(spark, sf).select("qid", "slot", txt("stops").alias("stops"), "priority", F.round("q", 6).alias("q"))


@query("i9_closure_detour")
def _(spark, sf):
    closed = tb.closed_places(spark, sf, sh.trip_net(spark, sf).stops)
    return select.closure_report(sh.plain_pool(spark, sf), closed)[1]


@query("i9_clean_routes")
def _(spark, sf):
    closed = tb.closed_places(spark, sf, sh.trip_net(spark, sf).stops)
    return select.closure_report(sh.plain_pool(spark, sf), closed)[0].select("qid", "slot", txt("stops").alias("stops"))


# --- reports --------------------------------------------------------------


@query("j1_run_endpoints", EDGES + """, ends AS (SELECT route_id, arg_min(place, pos) AS h, arg_max(place, pos) AS t FROM stops GROUP BY 1)
 SELECT x.route_id, x.p AS start_place, x.q AS end_place, t AS origin, h AS destination
 FROM (SELECT route_id, q AS p, p AS q FROM hops) x JOIN ends USING (route_id)""")
def _(spark, sf):
    # Every hop of every route ridden backwards.
    stops = sh.net(spark, sf).stops
    runs = nw.hops(stops).select("route_id", F.col("onward").alias("start_place"), F.col("place").alias("end_place"))
    return report.run_endpoints(runs, stops).select("route_id", "start_place", "end_place", "origin", "destination")


@query("j2_run_chips")
def _(spark, sf):
    return report.labelled(
        report.run_chips(sh.plain_top(spark, sf), sh.trip_net(spark, sf).stops, ["qid", "slot"]),
        rg.with_display(sh.registry(spark, sf, sh.components(spark, sf))),
    )


@query("j3_leg_records")
def _(spark, sf):
    return report.leg_records(sh.via_top(spark, sf), ["qid", "slot"])


@query("j4_route_records")
def _(spark, sf):
    return report.route_records(sh.via_top(spark, sf), sh.trip_net(spark, sf).stops, ["qid", "slot"]).select(
        "qid", "slot", "route_count", "match", "priority", F.size("routes").alias("chips"), F.size("legs").alias("legs")
    )


@query("j4_display_records", SPLICES + "," + sh.REGISTRY_SQL + _BACK + """,
 chip_runs AS (SELECT *, (SELECT min(s.route_id) FROM spans s WHERE s.chain_id = c.chain_id AND s.lo <= c.first AND c.last <= s.hi) AS route_id,
   CAST(coalesce((SELECT max(r.priority) FROM ridden r WHERE r.chain_id = c.chain_id AND r.lo < c.last AND c.first < r.hi), 0) AS INT) AS priority FROM cut_runs c),
 legs AS (SELECT chain_id, sum(length) AS length, count(DISTINCT route_id) AS routes, max(priority) AS worst,
   CASE WHEN sum(length) = 0 THEN 1.0 / count(DISTINCT route_id) ELSE CAST(sum(length * length) AS DOUBLE) / sum(length) / sum(length) END AS hhi FROM chip_runs GROUP BY 1),
 authored AS (SELECT route_id, arg_min(place, pos) AS head, arg_max(place, pos) AS tail FROM stops GROUP BY 1),
 reach AS (SELECT chain_id, arg_min(place, k) AS s, arg_max(place, k) AS e, max(k) AS last FROM chain_stops GROUP BY 1)
 SELECT c.chain_id, c.route_id AS id, CASE WHEN i.pos > j.pos THEN t.display || ' - ' || h.display ELSE h.display || ' - ' || t.display END AS label,
   CAST(CASE WHEN g.length = 0 THEN 100 ELSE round_even(c.length / CAST(g.length AS DOUBLE) * 100, 0) END AS INT) AS share, c.priority,
   CAST(c.first AS INT) AS start_index, CAST(c.last AS INT) AS end_index, x.display AS leg_start, y.display AS leg_end, CAST(r.last AS INT) AS leg_end_index,
   CAST(round_even(g.hhi * 100, 0) AS INT) AS match, CAST(g.routes AS INT) AS route_count, g.worst AS route_priority
 FROM chip_runs c JOIN legs g USING (chain_id) JOIN authored a USING (route_id)
 JOIN chain_stops f ON f.chain_id = c.chain_id AND f.k = c.first JOIN chain_stops l ON l.chain_id = c.chain_id AND l.k = c.last
 JOIN stops i ON i.route_id = c.route_id AND i.place = f.place JOIN stops j ON j.route_id = c.route_id AND j.place = l.place
 JOIN reach r ON r.chain_id = c.chain_id JOIN registry h ON h.place_id = a.head JOIN registry t ON t.place_id = a.tail
 JOIN registry x ON x.place_id = r.s JOIN registry y ON y.place_id = r.e""")
def _(spark, sf):
    # Spliced chains as trips of one leg, ranked by concentration alone.
    routes = legs.one_leg(_scored(spark, sf).withColumn("q", F.col("hhi")))
    shown = report.display_records(routes, sh.net(spark, sf).stops, sh.registry(spark, sf), ["chain_id"])
    each = shown.select("chain_id", "meta", F.explode("meta.legs").alias("leg")).select("*", F.explode("leg.routes").alias("chip"))
    return each.select(
        "chain_id", "chip.id", "chip.label", "chip.share", "chip.priority",
        F.col("chip.startIndex").alias("start_index"), F.col("chip.endIndex").alias("end_index"),
        F.col("leg.start").alias("leg_start"), F.col("leg.end").alias("leg_end"), F.col("leg.endIndex").alias("leg_end_index"),
        F.col("meta.match").alias("match"), F.col("meta.routeCount").alias("route_count"), F.col("meta.priority").alias("route_priority"),
    )


def _requests(spark, sf, registry: DataFrame | None = None) -> DataFrame:
    """The trips as typed: names with blanks around, the required stop among them."""
    names = rg.with_display(sh.registry(spark, sf) if registry is None else registry).select("place_id", F.concat(F.lit(" "), "display", F.lit(" ")).alias("display"))
    at = lambda place, name: names.select(F.col("place_id").alias(place), F.col("display").alias(name))
    return (
        sh.trips(spark, sf).withColumn("via_place", F.col("via")[0])
        .join(at("start_place", "start"), "start_place").join(at("end_place", "end"), "end_place").join(at("via_place", "stop"), "via_place")
        .select("qid", "start", "end", F.array(F.lit(" "), "stop").alias("via"))
    )


@query("c10_admitted_trips", OD + " SELECT qid, 'ok' AS status, start_place, end_place, via_place FROM od")
def _(spark, sf):
    return trips.admitted(_requests(spark, sf), sh.registry(spark, sf)).select(
        "qid", "status", "start_place", "end_place", F.col("via")[0].alias("via_place")
    )


@query("a13_shown_results")
def _(spark, sf):
    # Typed names to display records: the pools are those of the same trips by id.
    registry = sh.registry(spark, sf, sh.components(spark, sf))
    asked = cut(trips.admitted(_requests(spark, sf, registry), registry), "asked")
    n = sh.trip_net(spark, sf)
    direct = sh.plain_pool(spark, sf).join(
        legs.normalise_via(asked).where("size(via) = 0").select("qid"), "qid", "left_semi"
    )
    closed = tb.closed_places(spark, sf, n.stops)
    found = trips.shown_results(asked, direct, sh.via_pool(spark, sf), n.stops, registry, closed)
    return found.select("qid", "status", F.to_json("paths").alias("paths"), F.to_json("meta").alias("meta"), F.array_join("compromisedDetour", "|").alias("detour"))


@query("j5_path_links", SPLICES + " SELECT DISTINCT chain_id, a, b FROM chain_hops")
def _(spark, sf):
    edged = sh.splices(spark, sf).select("chain_id", ch.path_edges(F.col("stops")).alias("edges"))
    return report.path_links(edged, ["chain_id"])


@query("j5_path_nodes", SPLICES + " SELECT DISTINCT chain_id, place FROM chain_stops")
def _(spark, sf):
    return report.path_nodes(sh.splices(spark, sf), ["chain_id"])


def _named_splices(spark, sf) -> DataFrame:
    return sh.once(
        "named_splices", spark, sf,
        lambda: cut(rg.translate(sh.splices(spark, sf), sh.registry(spark, sf), ["chain_id"], "stops"), "named"),
    )


_NAMED = SPLICES + "," + tb.CLOSED_SQL + "," + sh.REGISTRY_SQL + """,
 ends2 AS (SELECT chain_id, max(k) AS last FROM chain_stops GROUP BY 1),
 shown AS (SELECT c.chain_id, k, last, display, grp FROM chain_stops c JOIN ends2 USING (chain_id) JOIN registry ON place_id = place)"""


@query("j6_visible_paths", _NAMED + """ SELECT chain_id, string_agg(display, '|' ORDER BY k) AS stops FROM shown
 WHERE k = 0 OR k = last OR grp NOT IN ('camp', 'post', 'firing_zone') GROUP BY 1""")
def _(spark, sf):
    hidden = F.array(F.lit("camp"), F.lit("post"), F.lit("firing_zone"))
    rows = _named_splices(spark, sf).withColumn("groups", report.classes("stops")).withColumn("hidden", hidden)
    return rows.select("chain_id", F.array_join(report.visible_path("stops", "groups", "hidden"), "|").alias("stops"))


@query("j7_visible_segments", _NAMED + """, parts AS (SELECT *, last // 2 AS mid FROM shown WHERE last >= 2)
 SELECT chain_id, CASE WHEN k < mid THEN 0 WHEN k = mid THEN 1 ELSE 2 END AS part, CASE WHEN k = mid THEN 'waypoint' ELSE 'segment' END AS kind,
        string_agg(display, '|' ORDER BY k) AS stops
 FROM parts WHERE k = mid OR k IN (0, mid - 1, mid + 1, last) OR grp NOT IN ('camp', 'post', 'firing_zone') GROUP BY 1, 2, 3""")
def _(spark, sf):
    # Every chain of three stops or more, with its middle stop as a required one.
    hidden = F.array(F.lit("camp"), F.lit("post"), F.lit("firing_zone"))
    rows = _named_splices(spark, sf).where("size(stops) >= 3").withColumn("hidden", hidden).withColumn(
        "legs",
        F.expr(
            "array(struct(0 as start_index, cast((size(stops) - 1) div 2 as int) as end_index), "
            "struct(cast((size(stops) - 1) div 2 as int) as start_index, size(stops) - 1 as end_index))"
        ),
    )
    return report.visible_segments(rows, ["chain_id"]).select("chain_id", "part", "kind", F.array_join("stops", "|").alias("stops"))


@query("j8_present_groups", _NAMED + ' SELECT DISTINCT chain_id AS qid, grp AS "group" FROM shown WHERE k > 0 AND k < last AND grp <> \'other\'')
def _(spark, sf):
    return report.present_groups(_named_splices(spark, sf).withColumnRenamed("chain_id", "qid"))


# --- diagnostics ----------------------------------------------------------

COMP = EDGES + "," + _COMP


@query("k1_components", COMP + " SELECT place, component FROM comp")
def _(spark, sf):
    return sh.components(spark, sf)


PART_EDGES = "WITH RECURSIVE " + tb.PART_STOPS_SQL + tb.EDGES_SQL[len(tb.STOPS_SQL):]


@query("k1_components_of_parts", PART_EDGES + "," + _COMP + " SELECT place, component FROM comp")
def _(spark, sf):
    stops = cut(tb.part_stops(spark, sf), "parts")
    return insights.place_components(nw.edges(stops), nw.places_of(stops))


def _articulation(spark, sf) -> DataFrame:
    n = sh.net(spark, sf)
    return sh.once("cuts", spark, sf, lambda: cut(articulation_points(n.edges, n.degree, comp=sh.components(spark, sf)), "cuts"))


_CUT_PLACES = """,
 reach(v, x) AS (SELECT place, min(neighbour) FROM near GROUP BY 1 UNION SELECT r.v, n.neighbour FROM reach r JOIN near n ON n.place = r.x WHERE n.neighbour <> r.v),
 cut_places AS (SELECT DISTINCT n.place FROM near n LEFT JOIN reach r ON r.v = n.place AND r.x = n.neighbour WHERE r.v IS NULL)"""


@query("k2_articulation_points", EDGES + _CUT_PLACES + " SELECT place FROM cut_places")
def _(spark, sf):
    return _articulation(spark, sf)


@query("k3_top_hubs", EDGES + " SELECT place, CAST(degree AS BIGINT) AS degree FROM degree WHERE degree > 0 ORDER BY degree DESC, place LIMIT 5")
def _(spark, sf):
    return insights.top_hubs(nw.degrees(nw.edges(tb.stops(spark, sf))))


@query("k3_top_hubs_of_parts", PART_EDGES + " SELECT place, CAST(degree AS BIGINT) AS degree FROM degree WHERE degree > 0 ORDER BY degree DESC, place LIMIT 5")
def _(spark, sf):
    return insights.top_hubs(nw.degrees(nw.edges(tb.part_stops(spark, sf))))


@query("k4_dead_ends", EDGES + " SELECT place, CASE WHEN degree = 0 THEN 'isolated' ELSE 'leaf' END AS kind FROM degree WHERE degree <= 1")
def _(spark, sf):
    stops = tb.stops(spark, sf)
    return insights.dead_ends(nw.degrees(nw.edges(stops), nw.places_of(stops)))


@query("k5_summary", COMP + """ SELECT count(*) AS places, CAST(sum(degree) // 2 AS BIGINT) AS links, count(*) FILTER (place = component) AS clusters,
 count(*) FILTER (degree = 0) AS isolated, count(*) FILTER (degree = 1) AS leaves FROM degree JOIN comp USING (place)""")
def _(spark, sf):
    return insights.summary(sh.net(spark, sf).degree, sh.components(spark, sf))


@query("k5_node_metrics", COMP + _CUT_PLACES + """ SELECT d.place, CAST(d.degree AS BIGINT) AS degree, c.component, p.place IS NOT NULL AS is_articulation,
 CASE WHEN d.degree = 0 THEN 'isolated' WHEN d.degree = 1 THEN 'leaf' END AS dead_end FROM degree d JOIN comp c USING (place) LEFT JOIN cut_places p ON p.place = d.place""")
def _(spark, sf):
    return insights.node_metrics(sh.net(spark, sf).degree, sh.components(spark, sf), _articulation(spark, sf))


@query("k6_islands", COMP + """, main AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
 SELECT route_id, component FROM stops JOIN comp USING (place) WHERE pos = 0 AND component <> (SELECT component FROM main)""")
def _(spark, sf):
    return insights.islands(sh.net(spark, sf).stops, sh.components(spark, sf))


@query("k7_neighbours", OD + " SELECT place, string_agg(neighbour, '>' ORDER BY neighbour) AS neighbours, count(*) AS connections FROM near WHERE place IN (SELECT start_place FROM od) GROUP BY 1")
def _(spark, sf):
    asked = sh.trips(spark, sf).select(F.col("start_place").alias("place"))
    return insights.neighbours_of(asked, sh.net(spark, sf).edges).select("place", txt("neighbours").alias("neighbours"), "connections")


@query("k8_relations", OD + "," + _COMP + """, sel AS (SELECT DISTINCT start_place AS selected FROM od)
 SELECT selected, c.place, CASE WHEN c.place = selected THEN 'selected' WHEN n.place IS NOT NULL THEN 'neighbour' ELSE 'component' END AS relation
 FROM sel JOIN comp s ON s.place = selected JOIN comp c ON c.component = s.component LEFT JOIN near n ON n.place = selected AND n.neighbour = c.place""")
def _(spark, sf):
    return insights.relations(sh.starts(spark, sf), sh.components(spark, sf), sh.links(spark, sf))


@query("k8_on_path", SPLICES + " SELECT place, CASE WHEN place IN (SELECT place FROM chain_stops) THEN 'path' ELSE 'dim' END AS relation FROM places")
def _(spark, sf):
    return insights.on_path(sh.net(spark, sf).degree, sh.splices(spark, sf))


# --- name search ----------------------------------------------------------


def _options(spark, sf) -> DataFrame:
    """Every part by name, maker and key, in key order."""
    return tb.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("option")
    )


def _typed(spark, sf) -> DataFrame:
    """What is typed: every distinct part name with its third letter missing, and every
    distinct brand and type."""
    part = tb.table(spark, sf, "part")
    slip = part.select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("query"))
    return slip.unionByName(part.select(F.col("p_brand").alias("query"))).unionByName(
        part.select(F.col("p_type").alias("query"))
    ).distinct().select(F.col("query").alias("qid"), "query")


@query("l1_normalised", r"""SELECT page_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[֑-ׇ]', '', 'g'),
 '["“”„״´`]', '"', 'g'), '[''’‘׳]', '''', 'g'), '[-–—־]', '-', 'g'), '\s+', ' ', 'g'))) AS name FROM pages""")
def _(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", tx.normalize(F.col("url")).alias("name"))


@query("l2_without_punctuation", r"""SELECT page_id, trim(regexp_replace(regexp_replace(url, '["''\-./()]', '', 'g'), '\s+', ' ', 'g')) AS name FROM pages""")
def _(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", tx.strip_punct(F.col("url")).alias("name"))


@query("l3_substring_distance", """WITH pair AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS query, p_name || ' ' || p_type AS name FROM part)
 SELECT query, lower(name) AS name, least(len(query), min(levenshtein(lower(query), substr(lower(name), s, l)))) AS distance
 FROM pair, range(1, 30) r(s), range(1, 16) k(l) WHERE s + l - 1 <= len(name) GROUP BY 1, 2""")
def _(spark, sf):
    # Every part name typed with a letter missing, against the name it was meant for.
    pairs = tb.table(spark, sf, "part").select(
        F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("query"),
        F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name"),
    ).distinct().withColumn("typed", F.lower("query"))
    return pairs.select("query", "name", tx.substring_distance("typed", "name").cast("long").alias("distance"))


@query("l5_fuzzy_filter")
def _(spark, sf):
    return names.fuzzy_filter(_options(spark, sf), _typed(spark, sf))


@query("l6_words", REG + " SELECT place_id, 'site|' || (place_id // 100) || (place_id % 100) AS words FROM registry")
def _(spark, sf):
    return rg.with_display(sh.registry(spark, sf)).select("place_id", F.array_join(tx.words_of(F.col("display")), "|").alias("words"))


@query("l8_strict_filter")
def _(spark, sf):
    return names.strict_filter(_options(spark, sf), _typed(spark, sf))


# --- the flagship ---------------------------------------------------------


@query("least_concentrated", SPLICES + _DP + """ SELECT chain_id, round(squares / (CAST(length AS DOUBLE) * length), 6) AS hhi,
 CAST(coalesce((SELECT max(priority) FROM ridden r WHERE r.chain_id = d.chain_id), 0) AS INT) AS priority
 FROM done d WHERE length > 0 ORDER BY squares / (CAST(length AS DOUBLE) * length), chain_id LIMIT 10""")
def least_concentrated(spark, sf):
    """The ten least concentrated chains with their tier."""
    return (
        _scored(spark, sf)
        .where("length > 0")
        .orderBy("hhi", "chain_id")
        .limit(10)
        .select("chain_id", F.round("hhi", 6).alias("hhi"), "priority")
    )
