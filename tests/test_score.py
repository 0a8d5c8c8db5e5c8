import itertools

from nets import CONC, CONTAIN, ROAD, SPEC, TIER_RIDE, Net

from waymesh.operators import marks as mk
from waymesh.operators.score import score


def scored(n, *texts, crossroads_only=True):
    rows = score(n.chains(*texts), n.net, ["chain_id"], crossroads_only).collect()
    return {r.chain_id: r for r in rows}


def test_artery_and_blend(spark):
    n = Net(spark, CONC)
    out = scored(n, "S x a1 a2 a3 a4 a5 y T", "S b1 m b2 T", "T b2 m b1 S", "S")
    assert out[0].hhi == 1.0
    assert out[1].hhi == 0.5 and out[2].hhi == 0.5
    assert [(r.route_id, r.length) for r in out[1].runs] == [(6, 2), (7, 2)]
    assert [(n.names[r.start_place], n.names[r.end_place]) for r in out[1].runs] == [("S", "m"), ("m", "T")]
    assert out[3].hhi == 1.0 and out[3].runs == [] and out[3].total_hops == 0
    hops = scored(n, "S x a1 a2 a3 a4 a5 y T", crossroads_only=False)
    assert abs(hops[0].hhi - 38 / 64) < 1e-12


def test_spec_hops_mode(spark):
    n = Net(spark, SPEC)
    out = scored(n, "A L K J E R", "A B C M N G E R", crossroads_only=False)
    assert abs(out[0].hhi - 17 / 25) < 1e-12
    assert abs(out[1].hhi - 29 / 49) < 1e-12


def test_zero_length_falls_back_to_equal_shares(spark):
    n = Net(spark, ["X A B", "B C Y"])
    assert scored(n, "X A B C Y")[0].hhi == 0.5


def test_best_assignment_against_enumeration(spark):
    routes = ["A B C D E", "C D E F", "B C D", "E F G", "A B", "D X", "C Y", "F Z", "B W"]
    n = Net(spark, routes)
    chain = "A B C D E F G".split()
    on = [
        {i for i, r in enumerate(routes) if any({a, b} == {x, y} for x, y in zip(r.split(), r.split()[1:]))}
        for a, b in zip(chain, chain[1:])
    ]
    near = {}
    for r in routes:
        for a, b in zip(r.split(), r.split()[1:]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    flag = [int(len(near[p]) >= 3) for p in chain]
    unit = [flag[i] + flag[i + 1] for i in range(len(chain) - 1)]
    best = None
    for pick in itertools.product(*on):
        value = sum(
            sum(unit[i] for i, _ in g) ** 2
            for _, g in itertools.groupby(enumerate(pick), key=lambda e: e[1])
        )
        moves = sum(1 for a, b in zip(pick, pick[1:]) if a != b)
        best = max(best or (-1, 0), (value, -moves))
    row = scored(n, " ".join(chain))[0]
    assert sum(r.length**2 for r in row.runs) == best[0]
    assert len(row.runs) - 1 == -best[1]
    assert abs(row.hhi - best[0] / sum(unit) ** 2) < 1e-12


def test_tiers_need_the_whole_stretch(spark):
    n = Net(spark, CONTAIN, [(0, "C", "F", 2)])
    out = scored(n, "B C D E F G", "A B C D E", "D E F G")
    assert [out[i].priority for i in range(3)] == [2, 0, 0]


def test_tier_follows_the_road(spark):
    n = Net(spark, TIER_RIDE, [(0, "S", "T", 2)])
    row = scored(n, "S u1 u2 u3 T")[0]
    assert row.hhi == 1.0 and row.priority == 2 and row.runs[0].route_id == 0
    marked = mk.marked_edges(n.net.stops, n.net.marks)
    best = {(r.a, r.b): r.priority for r in mk.edge_priority(n.net.edges, marked).collect()}
    a, b = sorted(n.chain("u1 u2"))
    assert best[(a, b)] == 0


def test_mark_rates_the_road(spark):
    n = Net(spark, ROAD, [(0, "P", "T", 3)])
    out = scored(n, "H g1 g2 P n1 T", "Q P n1 T", "H g1 g2 P n1")
    assert [out[i].priority for i in range(3)] == [3, 3, 0]
    assert len(out[0].runs) == 1 and out[1].runs[0].route_id == 1
