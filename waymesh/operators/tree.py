"""Authored routes as converging trees.

A tree is a table of nodes::

    route_idx   the route's place in the authored list
    node_path   branch indices from the root, [] for the root itself
    places      the node's own stops, towards the destination
    marks       array of (from, to, priority) over the node's frame
    priority    legacy rating of the whole corridor, null in current documents

A node's *frame* is its own stops followed by everything downstream: its parent's stops,
its grandparent's, down to the root's. The depth of a tree bounds every array here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import BEST_PRIORITY
from waymesh.operators.numbering import number_rows

KEY = ["route_idx", "node_path"]
MARK = "struct<from:int,to:int,priority:int>"
MARKS = f"array<{MARK}>"


def spines(nodes: DataFrame, with_self: bool = True) -> DataFrame:
    """Each node with each node on its way down: ``(route_idx, node_path, up_path, step)``,
    ``step`` 0 for itself, 1 for its parent. An equi-join key, not a prefix test."""
    first = 0 if with_self else 1
    return nodes.where(F.size("node_path") >= first).select(
        *KEY,
        F.explode(
            F.expr(
                f"transform(sequence({first}, size(node_path)), k -> struct("
                "k as step, slice(node_path, 1, size(node_path) - k) as up_path))"
            )
        ).alias("s"),
    ).select(*KEY, "s.up_path", "s.step")


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes no other node branches from."""
    parents = nodes.where(F.size("node_path") > 0).select(
        "route_idx", F.expr("slice(node_path, 1, size(node_path) - 1)").alias("node_path")
    ).distinct()
    return nodes.join(parents, KEY, "left_anti")


def with_frame(nodes: DataFrame) -> DataFrame:
    """Nodes with ``frame``, the chain their mark indices address."""
    below = nodes.select("route_idx", F.col("node_path").alias("up_path"), F.col("places").alias("up_places"))
    frames = (
        spines(nodes)
        .join(below, ["route_idx", "up_path"])
        .groupBy(*KEY)
        .agg(
            F.expr("flatten(transform(array_sort(collect_list(struct(step, up_places))), e -> e.up_places))").alias("frame")
        )
    )
    return nodes.join(frames, KEY)


def corridor_mark(frame_size: str, priority: str):
    """B2: one mark over a whole frame; none for the best rating or a frame without a hop."""
    return F.expr(
        f"if({priority} > {BEST_PRIORITY} and {frame_size} >= 2, "
        f"array(named_struct('from', 0, 'to', cast({frame_size} - 1 as int), 'priority', cast({priority} as int))), "
        f"cast(array() as {MARKS}))"
    )


def upgrade(nodes: DataFrame) -> DataFrame:
    """B1: legacy ratings as marks: the nearest rating on a leaf's spine becomes one mark
    over its whole frame, unless the leaf states marks itself."""
    stated = nodes.where("priority is not null").select(
        "route_idx", F.col("node_path").alias("up_path"), F.col("priority").alias("stated")
    )
    leaves = leaf_nodes(nodes).select(*KEY)
    ruled = (
        spines(leaves)
        .join(stated, ["route_idx", "up_path"])
        .groupBy(*KEY)
        .agg(F.min_by("stated", "step").alias("ruled"))
    )
    framed = with_frame(nodes)
    flagged = framed.join(ruled, KEY, "left").join(
        leaves.withColumn("leaf", F.lit(True)), KEY, "left"
    ).withColumn("ruled", F.coalesce("ruled", F.lit(BEST_PRIORITY))).withColumn("n", F.size("frame"))
    own = F.coalesce("marks", F.expr(f"cast(array() as {MARKS})"))
    return flagged.select(
        *KEY,
        "places",
        F.when(F.col("leaf") & (F.size(own) == 0), corridor_mark("n", "ruled")).otherwise(own).alias("marks"),
        F.lit(None).cast("int").alias("priority"),
    )


def leaves(nodes: DataFrame) -> DataFrame:
    """One corridor per leaf, numbered in authored order:
    ``(route_id, route_idx, node_path, places)``."""
    tips = leaf_nodes(with_frame(nodes)).select(*KEY, F.col("frame").alias("places"))
    return number_rows(tips, KEY, "route_id")


def corridor_stops(corridors: DataFrame) -> DataFrame:
    """Corridors as stops ``(route_id, pos, place)``."""
    return corridors.select("route_id", F.posexplode("places").alias("pos", "place"))


def resolved_marks(nodes: DataFrame, corridors: DataFrame) -> DataFrame:
    """Marks as place triples on every corridor they reach:
    ``(route_id, start_place, end_place, priority)``. A mark outside its frame is dropped."""
    triples = (
        with_frame(nodes)
        .select("route_idx", F.col("node_path").alias("up_path"), "frame", F.explode("marks").alias("m"))
        .where("m.from >= 0 and m.to >= 0 and m.from < size(frame) and m.to < size(frame)")
        .select(
            "route_idx",
            "up_path",
            F.expr("frame[m.from]").alias("start_place"),
            F.expr("frame[m.to]").alias("end_place"),
            F.col("m.priority").alias("priority"),
        )
    )
    return (
        spines(corridors.select(*KEY))
        .join(triples, ["route_idx", "up_path"])
        .join(corridors.select(*KEY, "route_id"), KEY)
        .select("route_id", "start_place", "end_place", "priority")
    )


def route_priorities(corridors: DataFrame, triples: DataFrame) -> DataFrame:
    """The distinct ratings of each route's corridors, best first; 0 for an unrated one."""
    return (
        corridors.select("route_idx", "route_id")
        .join(triples.select("route_id", "priority"), "route_id", "left")
        .groupBy("route_idx")
        .agg(F.sort_array(F.collect_set(F.coalesce("priority", F.lit(BEST_PRIORITY)))).alias("priorities"))
    )


def route_stops(nodes: DataFrame) -> DataFrame:
    """Every stop of every tree, a shared tail once: ``(route_idx, node_path, pos, place)``."""
    return nodes.select(*KEY, F.posexplode("places").alias("pos", "place"))


def leaf_count(nodes: DataFrame) -> DataFrame:
    """Corridors per route."""
    return leaf_nodes(nodes).groupBy("route_idx").agg(F.count("*").alias("leaves"))


def frame_pieces(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges over frames cut into per-node pieces.

    ``ranges(range_id, route_idx, node_path, from, to)`` gives
    ``(range_id, route_idx, up_path, step, from, to)``.
    """
    sizes = nodes.select("route_idx", F.col("node_path").alias("up_path"), F.size("places").alias("n"))
    walk = Window.partitionBy("range_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    on = (
        ranges.join(spines(ranges.select(*KEY).distinct()), KEY)
        .join(sizes, ["route_idx", "up_path"])
        .withColumn("offset", F.coalesce(F.sum("n").over(walk), F.lit(0)))
        .where("step = 0 or to >= offset")
    )
    return on.select(
        "range_id",
        "route_idx",
        "up_path",
        "step",
        F.expr("if(step = 0, from, greatest(from - offset, 0))").cast("int").alias("from"),
        F.expr("least(to - offset, n - 1)").cast("int").alias("to"),
    )


def mark_pieces(nodes: DataFrame) -> DataFrame:
    """Every mark cut into the pieces that show it:
    ``(route_idx, up_path, from, to, priority, owner, mark_index, head, continues)``."""
    stated = nodes.select(*KEY, F.posexplode("marks").alias("mark_index", "m")).select(
        F.struct("route_idx", "node_path", "mark_index").alias("range_id"),
        *KEY,
        F.col("m.from").alias("from"),
        F.col("m.to").alias("to"),
        F.col("m.priority").alias("priority"),
    )
    last = Window.partitionBy("range_id")
    return (
        frame_pieces(nodes, stated.drop("priority"))
        .join(stated.select("range_id", "priority"), "range_id")
        .withColumn("last", F.max("step").over(last))
        .select(
            "route_idx",
            "up_path",
            "from",
            "to",
            "priority",
            F.col("range_id.node_path").alias("owner"),
            F.col("range_id.mark_index").alias("mark_index"),
            (F.col("step") == 0).alias("head"),
            (F.col("step") < F.col("last")).alias("continues"),
        )
    )


def frame_range_stops(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The stops of ranges ``(range_id, route_idx, node_path, from, to)``."""
    return ranges.join(with_frame(nodes).select(*KEY, "frame"), KEY).select(
        "range_id", F.expr("slice(frame, from + 1, to - from + 1)").alias("places")
    )


def extract_routes(nodes: DataFrame, ranges: DataFrame, first_idx: int) -> DataFrame:
    """Ranges as new flat routes from ``first_idx`` on, added to the trees."""
    cutout = number_rows(frame_range_stops(nodes, ranges), ["range_id"], "route_idx", first_idx)
    fresh = cutout.select(
        F.col("route_idx").cast(nodes.schema["route_idx"].dataType),
        F.expr("cast(array() as array<int>)").alias("node_path"),
        "places",
        F.expr(f"cast(array() as {MARKS})").alias("marks"),
        F.lit(None).cast("int").alias("priority"),
    )
    return nodes.select(*KEY, "places", "marks", "priority").unionByName(fresh)
