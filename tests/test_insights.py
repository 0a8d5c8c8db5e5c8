import random

from nets import Net

from pyspark.sql import functions as F

from waymesh.operators import fill, insights, network as nw
from waymesh.operators.articulation import articulation_points


def naive_components(nodes, pairs):
    comp = {n: n for n in nodes}
    while True:
        before = dict(comp)
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return comp


def random_net(spark, seed, size=24, routes=16):
    rnd = random.Random(seed)
    names = [f"p{i:02d}" for i in range(size)]
    return Net(spark, [" ".join(rnd.sample(names, rnd.randint(1, 4))) for _ in range(routes)])


def test_components_and_articulation_by_removal(spark):
    nets = [random_net(spark, 1), random_net(spark, 7, 12, 9), Net(spark, ["a b c a", "c d", "d e f d", "g h", "i"]),
            Net(spark, ["z1 b", "z1 c", "z1 d", "z1 e", "b c"])]
    for n in nets:
        pairs = [(r.a, r.b) for r in nw.links(n.net.edges).collect()]
        nodes = sorted(n.names)
        comp = {r.place: r.component for r in insights.place_components(n.net.edges, n.net.degree).collect()}
        want = naive_components(nodes, pairs)
        assert comp == want
        cuts = {r.place for r in articulation_points(n.net.edges, n.net.degree).collect()}
        brute = set()
        for v in nodes:
            left = [x for x in nodes if x != v]
            after = naive_components(left, [(a, b) for a, b in pairs if v not in (a, b)])
            if len(set(after.values())) > len(set(want.values())) - (want[v] == v and list(want.values()).count(v) == 1):
                brute.add(v)
        assert cuts == brute


def test_small_metrics(spark):
    n = Net(spark, ["a b c", "b d", "e f", "g"])
    name = lambda rows: [n.names[r.place] for r in rows]
    assert name(insights.top_hubs(n.net.degree).collect()) == ["b", "a", "c", "d", "e"]
    kinds = {n.names[r.place]: r.kind for r in insights.dead_ends(n.net.degree).collect()}
    assert kinds == {"a": "leaf", "c": "leaf", "d": "leaf", "e": "leaf", "f": "leaf", "g": "isolated"}
    comp = insights.place_components(n.net.edges, n.net.degree)
    row = insights.summary(n.net.degree, comp).first()
    assert (row.places, row.links, row.clusters, row.isolated, row.leaves) == (7, 4, 3, 1, 5)
    assert sorted(r.route_id for r in insights.islands(n.net.stops, comp).collect()) == [2, 3]
    sel = spark.createDataFrame([(n.ids["b"],), (n.ids["e"],)], "place long")
    near = {n.names[r.place]: [n.names[x] for x in r.neighbours] for r in insights.neighbours_of(sel, n.net.edges).collect()}
    assert near == {"b": ["a", "c", "d"], "e": ["f"]}
    rel = {(n.names[r.selected], n.names[r.place]): r.relation for r in insights.relations(sel, comp, n.net.edges).collect()}
    assert rel[("b", "b")] == "selected" and rel[("b", "a")] == "neighbour" and ("b", "e") not in rel


def filled(n, **kw):
    rows = fill.fill_missing(n.net.stops, **kw).orderBy("route_id", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r.route_id, []).append(n.names[r.place])
    return [" ".join(v) for _, v in sorted(out.items())]


def test_fill(spark):
    assert filled(Net(spark, ["D B", "D E F B"]))[0] == "D E F B"
    assert filled(Net(spark, ["B D", "D E F B"]))[0] == "B F E D"
    assert filled(Net(spark, ["D B", "D E F B"]), lazy_gap=0)[0] == "D B"
    # two routes take D B directly: at most two stops go in
    assert filled(Net(spark, ["D B", "D B", "D E F G B"]))[:2] == ["D B", "D B"]
    # a stop already on the route leaves the hop D B alone; the hop F D is filled
    assert filled(Net(spark, ["F D B", "D E F B"]))[0] == "F E D B"
    # an inserted stretch is filled again
    assert filled(Net(spark, ["D B", "D E B", "E F B"]))[0] == "D E F B"
    # two hops want the same stop: the earlier one gets it
    assert filled(Net(spark, ["A B C", "A q B", "B q C"]))[0] == "A q B C"
    # nothing longer than eight stops
    long = "A " + " ".join(f"m{i}" for i in range(9)) + " B"
    assert filled(Net(spark, ["A B", long]))[0] == "A B"


def test_fill_across_routes(spark):
    # m is thin once the hop s-m is spelled out through t; nobody writes h m t in one go
    n = Net(spark, ["s m h", "m t s", "h t", "s x", "s y", "h k", "h l"])
    out = filled(n)
    assert out[0] == "s t m h"
    assert out[2] == "h m t"
    for block in (1, 2, 3):
        assert filled(n, block=block) == out


def test_fill_counts_a_tree_once(spark):
    n = Net(spark, ["D B", "D B", "D E F G B"])
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "route_id long, group_id long")
    assert filled(n, groups=groups)[0] == "D E F G B"


def test_hops_in_blocks(spark):
    n = Net(spark, ["a b c d e f g", "g a"])
    whole = sorted(tuple(r) for r in nw.hops(n.net.stops).collect())
    for block in (1, 2, 3, 7):
        assert sorted(tuple(r) for r in nw.hops(n.net.stops, block).collect()) == whole
    assert n.net.degree.agg(F.sum("degree")).first()[0] == 14


def test_few_pairs_are_joined_in_one_step_and_many_in_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    pairs = [(i, i + 1) for i in range(20)] + [(rnd.randrange(30, 70), rnd.randrange(30, 70)) for _ in range(20)] + [(7, 7)]
    nodes = spark.range(80).withColumnRenamed("id", "node")
    rows = spark.createDataFrame(pairs, "a long, b long")
    want = naive_components(range(80), pairs)
    written = []
    plain = insights.cut
    monkeypatch.setattr(insights, "cut", lambda df, label="step": written.append(label) or plain(df, label))
    assert {r.node: r.component for r in insights.components(nodes, rows).collect()} == want
    assert written == ["labels", "live", "step", "labels"]
    assert {r.node: r.component for r in insights.components(nodes, rows, few=0).collect()} == want
    # The last rounds of many pairs are few pairs.
    assert {r.node: r.component for r in insights.components(nodes, rows, few=10).collect()} == want
