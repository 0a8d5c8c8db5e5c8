"""Searches settled by one task, components joined by ranges: the same rows as by rounds."""

import random

import pandas as pd
from nets import Net
from test_search import random_routes

from pyspark.sql import functions as F

from waymesh.operators import insights
from waymesh.operators import search as se
from waymesh.session import cut


def labels_of(labels):
    return {(r.sid, r.place, r.through, r.cost, tuple(tuple(x) for x in r.rides)) for r in labels.collect()}


def test_a_search_of_a_small_component_takes_no_rounds_and_gives_the_same_labels(spark):
    rnd = random.Random(3)
    routes = [*random_routes(7, 12, 9), *[f"L{i} M{i} L{i + 1}" for i in range(6)], "X1 X2 X3", "X2 X4"]
    marks = [(i, r.split()[0], r.split()[-1], 1 + i % 3) for i, r in enumerate(routes) if i % 2]
    n = Net(spark, routes, marks)
    comp = insights.place_components(n.net.edges, n.net.degree)
    bare = cut(se.rails(n.net), "rail")
    bare = cut(se.with_landmarks(bare, se.landmarks(bare, n.net.degree)), "rail")
    names = sorted(n.ids.values())
    rows = [(f"s{i}", rnd.choice(names), rnd.choice([*names, None]), rnd.choice([None, 0, 1]), rnd.sample(names, rnd.randint(0, 2))) for i in range(25)]
    base = spark.createDataFrame(rows, "q string, src long, dst long, tier int, banned array<bigint>")
    edges = [(e.a, e.b) for e in n.net.edges.select("a", "b").distinct().collect()]
    deltas = spark.createDataFrame(
        [(f"s{i}", *e, -(10**6)) for i in range(25) for e in rnd.sample(edges, 4)], "sid string, a long, b long, delta long"
    )
    # Of three components the two smaller ones are small to the third rail.
    rails = [cut(se.with_areas(bare, comp, small), "rail") for small in (4096, 20)]
    assert rails[0].where("area is null").isEmpty()
    assert not rails[1].where("area is null").isEmpty() and not rails[1].where("area is not null").isEmpty()
    for step, slack, costs in ((0, 0, None), (10**6, 10**6, None), (10**6, 0, deltas)):
        s = cut(se.plain_searches(base, F.col("q"), step=step, slack=slack, ban=10**8, tier=F.col("tier"), banned=F.col("banned")), "s")
        want = labels_of(se.search(s, bare, costs))
        assert want
        seen = []
        assert labels_of(se.search(s, rails[0], costs, watch=seen.append)) == want
        assert not seen
        assert labels_of(se.search(s, rails[1], costs)) == want


def test_sections_are_left_to_the_rounds(spark):
    n = Net(spark, ["A B C D E F G", "X Y"])
    comp = insights.place_components(n.net.edges, n.net.degree)
    rail = se.with_areas(se.rails(n.net, section=3), comp)
    assert {r.place for r in rail.where("area is not null").collect()} == {n.ids["X"], n.ids["Y"]}


def test_ranges_join_what_lies_close_and_rounds_the_rest(spark):
    rnd = random.Random(8)
    # Short chains of near numbers, and a few pairs across all of them; chunks of the test hold few pairs.
    pairs = [(10 * k + i, 10 * k + i + 1) for k in range(200) for i in range(rnd.randint(1, 8))]
    pairs += [(10 * rnd.randrange(200), 10 * rnd.randrange(200)) for _ in range(60)]
    nodes = sorted({n for p in pairs for n in p} | {5000, 5001})
    root = {n: n for n in nodes}
    for _ in range(len(nodes)):
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    rows = spark.createDataFrame(pairs, "a long, b long")
    named = spark.createDataFrame([(n,) for n in nodes], "node long")
    for few in (1 << 18, 0):
        got = {r.node: r.component for r in insights.components(named, rows, few=few, close=True).collect()}
        assert got == root


def test_parts_of_a_range_are_bounded():
    frame = pd.DataFrame({"a": range(0, 40, 2), "b": range(1, 41, 2)})
    parts = list(insights._smallest_by_parts(iter([frame[i : i + 4] for i in range(0, 20, 4)]), most=8))
    assert [len(p) for p in parts] == [16, 16, 8]
