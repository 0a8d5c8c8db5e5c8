"""Network diagnostics (K1, K3-K8); K2 is in ``articulation.py``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.chains import HUB_COUNT
from waymesh.operators import network as nw
from waymesh.session import NotConverged, cut, retire


#: Pairs so few that one task joins them at once, in place of the rounds that are left. A bound whatever the input.
FEW_PAIRS = 1 << 18


def _smallest_by_parts(batches: Iterator[pd.DataFrame], most: int = FEW_PAIRS) -> Iterator[pd.DataFrame]:
    """:func:`_smallest_reachable` of every ``most`` pairs or a batch more, each on its own."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= most:
            yield from _smallest_reachable(iter(held))
            held, size = [], 0
    yield from _smallest_reachable(iter(held))


def _smallest_reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``a, to``: every end of the pairs with the smallest node it reaches."""
    held = list(batches)
    if not held:
        return
    names, ends = np.unique(pd.concat(held)[["a", "b"]].to_numpy(), return_inverse=True)
    x, y = ends.reshape(-1, 2).T
    top = np.arange(len(names))
    while (top[x] != top[y]).any():
        np.minimum.at(top, np.maximum(top[x], top[y]), np.minimum(top[x], top[y]))
        while (top != top[top]).any():
            top = top[top]
    yield pd.DataFrame({"a": names, "to": names[top]})


def components(
    nodes: DataFrame, pairs: DataFrame, max_rounds: int = 1000, few: int = FEW_PAIRS, close: bool = False
) -> DataFrame:
    """K1: ``(node, component)``, the component named by its smallest node.

    ``nodes(node)``, ``pairs(a, b)``. Each round maps every node to the smallest node
    within two hops and contracts the edges, so chains and stars both shrink fast and
    later rounds read ever fewer edges. The smallest node of a component maps to itself
    throughout, so the last node left is that one. Minima are taken before the shuffle:
    a hub costs one row per task, not one per neighbour. Once at most ``few`` pairs are left, one
    task joins them: each round costs ten shuffles, however little they move.

    ``close`` says that nodes near in order tend to be joined. Pairs are then dealt by ranges, the pairs of a
    range are joined where they lie, and only what nodes in several ranges join is left for the rounds. Every end
    of a pair is a node there, so ``nodes`` need name no others than those without pairs; repeats do not matter.
    A node goes along as a pair with itself, which saves a join of all nodes.
    """
    if close:
        kind = pairs.schema["a"].dataType.simpleString()
        alone = nodes.where("node is not null").select(F.col("node").alias("a"), F.col("node").alias("b"))
        dealt = pairs.where("a <> b").select("a", "b").unionAll(alone).repartitionByRange("a").sortWithinPartitions("a")
        near = dealt.mapInPandas(_smallest_by_parts, f"a {kind}, to {kind}")
        # A node has one name for each part of a range it lies in.
        named = near.groupBy("a").agg(F.array_sort(F.collect_set("to")).alias("names"))
        nameless = nodes.where("node is null").distinct().select("node", F.array("node"))
        kept = cut(named.unionAll(nameless), "near")
        labels = kept.select(F.col("a").alias("node"), F.col("names")[0].alias("component"))
        again = kept.where("size(names) > 1").select(F.col("names")[0].alias("a"), F.explode("names").alias("b"))
        live = cut(again.where("a <> b").distinct(), "live")
    else:
        labels = kept = cut(nodes.select("node", F.col("node").alias("component")), "labels")
        live = cut(pairs.where("a <> b").select("a", "b").distinct(), "live")
    for _ in range(max_rounds):
        left_over = live.count()
        if not left_over:
            return labels
        if left_over <= few:
            kind = live.schema["a"].dataType.simpleString()
            step = cut(live.coalesce(1).mapInPandas(_smallest_reachable, f"a {kind}, to {kind}"), "step")
            grown = cut(_stepped(labels, step), "labels")
            retire(kept, live, step)
            return grown
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near")
        wide = (
            both.join(near.select(F.col("a").alias("b"), F.col("m").alias("via")), "b")
            .groupBy("a")
            .agg(F.min("via").alias("via"))
            .join(near, "a")
            .select("a", F.least("via", "m").alias("to"))
        )
        step = cut(wide, "step")
        grown = cut(_stepped(labels, step), "labels")
        left = step.select("a", F.col("to").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        shrunk = cut(
            live.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "live",
        )
        retire(kept, live, near, step)
        labels, kept, live = grown, grown, shrunk
    raise NotConverged(f"components still merging after {max_rounds} rounds")


def _stepped(labels: DataFrame, step: DataFrame) -> DataFrame:
    return labels.join(step, labels["component"] == step["a"], "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )


def place_components(edge_rows: DataFrame, places: DataFrame) -> DataFrame:
    """K1 on a network: ``(place, component)``."""
    return components(places.select(F.col("place").alias("node")), edge_rows, close=True).withColumnRenamed("node", "place")


def top_hubs(degree: DataFrame, n: int = HUB_COUNT) -> DataFrame:
    """K3: the busiest places, ties by place."""
    return degree.where("degree > 0").orderBy(F.desc("degree"), "place").limit(n)


def dead_ends(degree: DataFrame) -> DataFrame:
    """K4: isolated places and leaves: ``(place, kind)``."""
    return degree.where("degree <= 1").select(
        "place", F.when(F.col("degree") == 0, "isolated").otherwise("leaf").alias("kind")
    )


def node_metrics(degree: DataFrame, comp: DataFrame, cut_places: DataFrame) -> DataFrame:
    """K5: one row per place with everything known about it."""
    return (
        degree.join(comp, "place")
        .join(cut_places.withColumn("is_articulation", F.lit(True)), "place", "left")
        .join(dead_ends(degree).withColumnRenamed("kind", "dead_end"), "place", "left")
        .select(
            "place", "degree", "component", F.coalesce("is_articulation", F.lit(False)).alias("is_articulation"), "dead_end"
        )
    )


def summary(degree: DataFrame, comp: DataFrame) -> DataFrame:
    """K5: places, links, clusters and dead ends of a network in one row."""
    return degree.join(comp, "place").agg(
        F.count("*").alias("places"),
        (F.sum("degree") / 2).cast("long").alias("links"),
        F.count(F.when(F.col("place") == F.col("component"), 1)).alias("clusters"),
        F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"),
        F.count(F.when(F.col("degree") == 1, 1)).alias("leaves"),
    )


def islands(stops: DataFrame, comp: DataFrame) -> DataFrame:
    """K6: routes off the largest component, by their first stop: ``(route_id, component)``.
    Of equally large components the one with the smallest place is the main one."""
    main = comp.groupBy("component").agg(F.count("*").alias("n")).agg(
        F.min_by("component", F.struct((-F.col("n")).alias("n"), F.col("component"))).alias("main")
    )
    first = stops.where("pos = 0").join(comp, "place").select("route_id", "component")
    return first.join(F.broadcast(main), first["component"] != F.col("main")).select("route_id", "component")


def neighbours_of(asked: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """K7: neighbours of the asked places: ``(place, neighbours, connections)``."""
    near = nw.neighbour_rows(edge_rows).join(asked.select("place").distinct(), "place", "left_semi")
    return near.groupBy("place").agg(
        F.sort_array(F.collect_set("neighbour")).alias("neighbours"), F.count("*").alias("connections")
    )


def relations(selected: DataFrame, comp: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """K8: how the places of its component relate to each selected place:
    ``(selected, place, relation)``: selected, neighbour or component. Every other place
    is ``other`` and left out, since it would be a row per pair."""
    at = selected.select(F.col("place").alias("selected")).join(
        comp.withColumnRenamed("place", "selected"), "selected"
    )
    # Only what touches a selected place is shuffled, not every link of the network.
    way = lambda x, y: F.struct(F.col(x).alias("selected"), F.col(y).alias("place"))
    both = edge_rows.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    near = both.join(selected.select(F.col("place").alias("selected")), "selected", "left_semi").distinct().withColumn(
        "near", F.lit(True)
    )
    return (
        at.join(comp, "component")
        .join(near, ["selected", "place"], "left")
        .select(
            "selected",
            "place",
            F.when(F.col("place") == F.col("selected"), "selected")
            .when(F.col("near"), "neighbour")
            .otherwise("component")
            .alias("relation"),
        )
    )


def on_path(comp: DataFrame, path: DataFrame) -> DataFrame:
    """K8: while a path is shown its places are ``path`` and the others ``dim``."""
    shown = path.select(F.explode("stops").alias("place")).distinct().withColumn("on", F.lit(True))
    return comp.select("place").join(shown, "place", "left").select(
        "place", F.when(F.col("on"), "path").otherwise("dim").alias("relation")
    )
