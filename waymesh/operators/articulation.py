"""K2: articulation points in rounds that grow with the logarithm of the network, whatever its diameter.

1. A spanning forest by contraction: every part takes its smallest edge to another part, parts
   joined by such edges become one.
2. An Euler tour of every tree: the edge from u to v is followed by the edge from v to the neighbour
   after u. Places in the tour come from list ranking: every edge knows one further on, and three times
   as far in the next round. A place's subtree is the stretch from its entering edge to its leaving one.
3. ``low`` and ``high`` of a subtree, the first and last place any edge outside the tree leads to from
   it: minima over stretches, from tables over 2^k positions, each made from the one before.
4. Tree edges, named by their lower place, belong to one block if an edge outside the tree joins
   unrelated places below them, or leads from under the one past the other. Places in two blocks
   are the points. This holds for any spanning tree.

Components of at most ``SMALL`` edges need none of it: each is walked depth first by the task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators import network as nw
from waymesh.operators.insights import components
from waymesh.operators.numbering import number_rows
from waymesh.session import NotConverged, cut, retire

Watch = Callable[[str], None]
#: Before every place of a tour: when its root is entered.
BEGIN = -(1 << 62)
#: Edges of a component up to which one task walks it. A bound whatever the input.
SMALL = 4096


def quiet(step: str) -> None:
    """The watcher that nobody asked for."""


def followed(hooks: DataFrame, watch: Watch, max_rounds: int) -> DataFrame:
    """``hooks(x, up)`` as ``(x, root)``: where going up ends, a node that is its own ``up``."""
    known = cut(hooks.select("x", F.col("up").alias("root")), "hooks")
    for _ in range(max_rounds):
        watch("jump")
        above = known.select(F.col("x").alias("root"), F.col("root").alias("next"))
        higher = known.select(F.col("x").alias("next"), F.col("root").alias("top"))
        jumped = known.join(above, "root").join(higher, "next").select("x", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
        jumped = cut(jumped, "hooks")
        retire(known)
        known = jumped
        if known.where("moved").isEmpty():
            return known.drop("moved")
    raise NotConverged(f"pointers still moving after {max_rounds} rounds")


def spanning_forest(pairs: DataFrame, watch: Watch = quiet, max_rounds: int = 1000) -> DataFrame:
    """Tree edges ``(a, b)`` of ``pairs(a, b)``: no cycle, and all that the pairs join is joined."""
    live = cut(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b"), "live")
    taken = []
    for _ in range(max_rounds):
        if live.isEmpty():
            retire(live)
            return taken[0] if len(taken) == 1 else cut(_together(taken), "forest") if taken else pairs.where("false").select("a", "b")
        watch("hook")
        facing = live.unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y"), "a", "b"))
        best = cut(facing.groupBy("x").agg(F.min(F.struct("a", "b", "y")).alias("m")).select("x", "m.a", "m.b", "m.y"), "best")
        taken.append(cut(best.select("a", "b").distinct(), "taken"))
        # Two parts that take the same edge would point at each other: the smaller stays.
        other = best.select(F.col("x").alias("y"), F.col("y").alias("back"))
        hooks = best.join(other, "y").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("up"))
        roots = followed(hooks, watch, max_rounds)
        left = live.join(roots.select("x", F.col("root").alias("p")), "x").join(roots.select(F.col("x").alias("y"), F.col("root").alias("q")), "y")
        merged = left.where("p <> q").groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        after = cut(merged.agg(F.min(F.struct("a", "b")).alias("m")).select("x", "y", "m.a", "m.b"), "live")
        retire(live, best, roots)
        live = after
    raise NotConverged(f"forest still growing after {max_rounds} rounds")


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def tour(forest: DataFrame, comp: DataFrame, watch: Watch = quiet, max_rounds: int = 1000) -> DataFrame:
    """``(place, parent, component, enter, leave)`` of all places but the roots, which are the components' names.

    Times count along the tour of a component and end at 0.
    """
    arcs = forest.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    arcs = cut(number_rows(arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"], "id"), "arcs")
    ends = arcs.groupBy("src").agg(F.min("id").alias("first"), F.max("id").alias("last")).join(comp.withColumnRenamed("place", "src"), "src")
    back = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("id").alias("rev"))
    ahead = (
        arcs.join(back, ["src", "dst"])
        .join(ends.withColumnRenamed("src", "dst"), "dst")
        .withColumn("next", F.when(F.col("rev") != F.col("last"), F.col("rev") + 1).when(F.col("dst") != F.col("component"), F.col("first")))
    )
    line = cut(ahead.select("id", "rev", "src", "dst", "component", "next"), "line")
    ranks = cut(line.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("far")), "ranks")
    for _ in range(max_rounds):
        if ranks.where("next is not null").isEmpty():
            break
        watch("rank")
        beyond = ranks.select(F.col("id").alias("next"), F.col("far").alias("more"), F.col("next").alias("then"))
        last = ranks.select(F.col("id").alias("then"), F.col("far").alias("most"), F.col("next").alias("end"))
        far = F.col("far") + F.coalesce("more", F.lit(0)) + F.coalesce("most", F.lit(0))
        longer = cut(ranks.join(beyond, "next", "left").join(last, "then", "left").select("id", F.col("end").alias("next"), far.alias("far")), "ranks")
        retire(ranks)
        ranks = longer
    else:
        raise NotConverged(f"tour not ranked after {max_rounds} rounds")
    times = ranks.select("id", (-F.col("far")).alias("time"))
    known = line.join(times, "id").join(times.select(F.col("id").alias("rev"), F.col("time").alias("leave")), "rev").where("time < leave")
    places = cut(known.select(F.col("dst").alias("place"), F.col("src").alias("parent"), "component", F.col("time").alias("enter"), "leave"), "places")
    retire(arcs, line, ranks)
    return places


def stretch_ends(values: DataFrame, stretches: DataFrame, watch: Watch = quiet) -> DataFrame:
    """For ``stretches(place, component, enter, leave)`` the least ``lo`` and greatest ``hi`` of
    ``values(component, at, lo, hi)`` from ``enter`` to ``leave``: ``(place, low, high)``."""
    asked = cut(stretches.withColumn("k", F.floor(F.log2(F.col("leave") - F.col("enter") + 1)).cast("int")), "stretches")
    table, found = cut(values, "table"), []
    most = asked.agg(F.max("k")).first()[0]
    for k in range((-1 if most is None else most) + 1):
        watch("stretch")
        if k:
            half = F.lit(1 << (k - 1))
            both = table.unionByName(table.withColumn("at", F.col("at") - half))
            wider = cut(both.groupBy("component", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "table")
            retire(table)
            table = wider
        mine = asked.where(F.col("k") == k)
        starts = mine.select("place", "component", F.col("enter").alias("at"))
        starts = starts.unionByName(mine.select("place", "component", (F.col("leave") - F.lit((1 << k) - 1)).alias("at")))
        met = starts.join(table, ["component", "at"]).groupBy("place").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
        found.append(cut(met, "met"))
    retire(table)
    return _together(found) if found else asked.select("place", F.col("enter").alias("low"), F.col("leave").alias("high")).where("false")


def split_places(pairs: list[tuple[int, int]]) -> set[int]:
    """The articulation points of a few ``pairs``, each once: a place is one if a branch below it leads nowhere above it."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    enter: dict[int, int] = {}
    low: dict[int, int] = {}
    found: set[int] = set()
    for root in near:
        if root in enter:
            continue
        enter[root] = low[root] = len(enter)
        branches, way = 0, [(root, None, iter(near[root]))]
        while way:
            place, parent, rest = way[-1]
            for other in rest:
                if other not in enter:
                    enter[other] = low[other] = len(enter)
                    way.append((other, place, iter(near[other])))
                    break
                if other != parent:
                    low[place] = min(low[place], enter[other])
            else:
                way.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[place])
                    if parent == root:
                        branches += 1
                    elif low[place] >= enter[parent]:
                        found.add(parent)
        if branches > 1:
            found.add(root)
    return found


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[int] = []
        for pairs in batch.column("pairs"):
            found += split_places([(e["a"], e["b"]) for e in pairs.as_py()])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["place"])


def articulation_points(
    edge_rows: DataFrame, places: DataFrame, watch: Watch = quiet, max_rounds: int = 1000, small: int = SMALL, comp: DataFrame | None = None
) -> DataFrame:
    """K2: places whose removal splits their component: ``(place)``. ``watch`` is told of every round.

    ``comp(place, component)`` are the components, if they are there already.
    """
    pairs = nw.links(edge_rows).select("a", "b")
    if comp is None:
        pairs = cut(pairs, "pairs")
        comp = components(places.select(F.col("place").alias("node")), pairs, close=True).select(F.col("node").alias("place"), "component")
    named = cut(pairs.join(comp.withColumnRenamed("place", "a"), "a").select("component", "a", "b"), "named")
    large = cut(named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > small).select("component"), "large")
    own = named.join(large, "component", "left_anti").groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    found = cut(own.select("pairs").mapInArrow(_split, "place bigint"), "found")
    if not large.isEmpty():
        of_large = cut(named.join(large, "component", "left_semi").select("a", "b"), "pairs")
        found = found.unionByName(_points_by_rounds(of_large, comp, watch, max_rounds))
    return found


def _points_by_rounds(pairs: DataFrame, comp: DataFrame, watch: Watch, max_rounds: int) -> DataFrame:
    forest = spanning_forest(pairs, watch, max_rounds)
    below = tour(forest, comp, watch, max_rounds)
    # Roots are entered before and left after everything.
    roots = below.select("component").distinct().select(
        F.col("component").alias("place"), F.lit(None).cast("long").alias("parent"), "component", F.lit(BEGIN).alias("enter"), F.lit(1).cast("long").alias("leave")
    )
    times = cut(below.unionByName(roots).select("place", "component", "enter", "leave"), "times")
    outside = pairs.join(forest, ["a", "b"], "left_anti")
    side = lambda c: times.select(F.col("place").alias(c), F.col("enter").alias(f"{c}_in"), F.col("leave").alias(f"{c}_out"))
    outside = cut(outside.join(side("a"), "a").join(side("b"), "b"), "outside")
    met = outside.select(F.col("a").alias("place"), F.col("b_in").alias("t")).unionByName(outside.select(F.col("b").alias("place"), F.col("a_in").alias("t")))
    met = met.groupBy("place").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    values = below.join(met, "place").select("component", F.col("enter").alias("at"), "lo", "hi")
    reach = stretch_ends(values, below.select("place", "component", "enter", "leave"), watch)
    unrelated = outside.where("a_out < b_in or b_out < a_in").select("a", "b")
    above = times.select(F.col("place").alias("parent"), F.col("enter").alias("p_in"), F.col("leave").alias("p_out"))
    past = below.join(reach, "place").join(above, "parent").where("low < p_in or high > p_out").select(F.col("place").alias("a"), F.col("parent").alias("b"))
    blocks = components(below.select(F.col("place").alias("node")), unrelated.unionByName(past))
    ends = blocks.join(below.select(F.col("place").alias("node"), "parent"), "node")
    in_block = ends.select(F.col("node").alias("place"), "component").unionByName(ends.select(F.col("parent").alias("place"), "component"))
    return in_block.distinct().groupBy("place").agg(F.count("*").alias("blocks")).where("blocks > 1").select("place")
