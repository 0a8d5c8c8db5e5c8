import pytest
from nets import atlas

from pyspark.sql import functions as F

from waymesh.operators import legs, pool, select
from waymesh.session import together

TRIPS = {
    "spec": [("K", "M"), ("A", "A"), ("A", "ZZZ")],
    "parallel": [("S", "T")],
    "conc": [("S", "T")],
    "priority": [("S", "T")],
    "pair": [("S", "E")],
    "arena": [("S", "T")],
    "legarena": [("S", "T")],
    "exclude": [("S", "T")],
    "detour": [("A", "G")],
    "tworoutes": [("X", "Y")],
    "shortcut": [("A", "C")],
}
VIA = [
    ("waypoint", "A", "B", "C"), ("waypoint", "A", "B", "P"), ("waypoint", "A", "B", "C P"),
    ("through", "S", "T", "V"), ("spur", "S", "T", "W"), ("onway", "S", "T", "K"),
    ("two", "S", "T", "W1 W2"), ("line", "S", "E", "Q P"), ("road", "H", "T", "n1"),
    ("legarena", "P", "T", "S"), ("waypoint", "A", "B", "ZZZ"),
]


@pytest.fixture(scope="module")
def world(spark):
    n = atlas(spark)
    ids = lambda name, p: n.ids.get(f"{name}.{p}", -1)
    ready = pool.prepare(n.net)
    trips = spark.createDataFrame(
        [(f"{k} {s} {e}", ids(k, s), ids(k, e)) for k, v in TRIPS.items() for s, e in v],
        "qid string, start_place long, end_place long",
    )
    via = spark.createDataFrame(
        [(f"{k} {s} {e} via {v}", ids(k, s), ids(k, e), [ids(k, p) for p in v.split()]) for k, s, e, v in VIA],
        "qid string, start_place long, end_place long, via array<bigint>",
    )
    plain, through = together(lambda: pool.candidate_pool(trips, ready), lambda: legs.via_pool(via, ready))
    return n, ready, plain, through


def shown(n, rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.slot)):
        text = " ".join(n.names[s].split(".")[1] for s in r.stops)
        out.setdefault(r.qid, []).append((text, r))
    return out


def test_plain_trips(world):
    n, _, cand, _ = world
    top = shown(n, select.select_diverse(cand, 3).collect())
    text = {q: [t for t, _ in v] for q, v in top.items()}
    assert text["spec K M"][0] == "K J E G N M"
    assert top["spec K M"][0][1].hhi == 0.5 and top["spec K M"][0][1].q == 0.5
    assert text["spec A A"] == ["A"]
    assert "spec A ZZZ" not in text
    assert len(text["parallel S T"]) == 3
    assert text["detour A G"] == ["A B C D E F G"]
    assert text["tworoutes X Y"] == ["X A B C Y"] and top["tworoutes X Y"][0][1].route_count == 2
    assert sorted(text["shortcut A C"]) == ["A C", "A p q C"]
    assert text["conc S T"][0] == "S x a1 a2 a3 a4 a5 y T"
    assert abs(top["conc S T"][0][1].q - 0.4**0.5) < 1e-9
    assert text["priority S T"] == ["S c1 c2 c3 T", "S q1 q2 q3 T"]
    first, second = (r for _, r in top["priority S T"])
    assert (first.priority, second.priority) == (0, 1)
    assert abs(first.hhi - 10 / 36) < 1e-9 and second.hhi == 1.0
    assert text["pair S E"][0] == "S a1 a2 a3 a4 a5 M t1 t2 t3 t4 t5 t6 t7 N l1 E"
    assert [r.priority for _, r in top["arena S T"]] == [0, 1]
    assert text["arena S T"] == ["S a1 a2 a3 T", "S q1 q2 q3 T"]


def test_uncapped_soft_and_excluding(world, spark):
    n, _, cand, _ = world
    every = shown(n, select.select_diverse(cand).collect())
    assert len(every["parallel S T"]) == 4
    assert [r.priority for _, r in every["legarena S T"]] == [0, 2]
    assert every["legarena S T"][0][1].q < every["legarena S T"][1][1].q
    soft = shown(n, select.select_diverse(cand, 3, hard_tier=False).collect())
    assert soft["priority S T"][0][0] == "S q1 q2 q3 T"
    closed = spark.createDataFrame([(n.ids["exclude.M"],)], "place long")
    clean, detour = select.closure_report(cand, closed)
    assert [t for t, _ in shown(n, clean.collect())["exclude S T"]] == ["S N T"]
    assert [(r.qid, n.names[r.place]) for r in detour.collect()] == [("exclude S T", "exclude.M")]


def test_required_stops(world):
    n, _, _, via = world
    top = shown(n, select.select_diverse(via, 3, 1.5).collect())
    text = {q: [t for t, _ in v] for q, v in top.items()}
    assert text["waypoint A B via C"][0] == "A C B"
    assert [leg.hhi for leg in top["waypoint A B via C"][0][1].legs] == [1.0, 1.0]
    for chain in text["waypoint A B via P"]:
        assert "C P C" in chain
    assert text["waypoint A B via C P"]
    assert text["through S T via V"][0] == "S h1 J V c1 c2 T"
    assert abs(top["through S T via V"][0][1].q - 0.680) < 1e-3
    assert text["spur S T via W"][0] == "S h1 J W J h2 T"
    assert text["onway S T via K"][0] == "S n1 K n1 S m1 T"
    assert text["line S E via Q P"] == ["S P Q E"]
    assert text["legarena P T via S"][0] == "P p1 S b1 b2 b3 T"
    assert [r.priority for _, r in top["legarena P T via S"]] == [0, 2]
    road = top["road H T via n1"][0][1]
    assert road.priority == 3 and [leg.priority for leg in road.legs] == [3, 3]
    assert "waypoint A B via ZZZ" not in text
    for t, r in top["two S T via W1 W2"]:
        stops = t.split()
        for leg in r.legs:
            assert not {"W1", "W2"} & set(stops[leg.start_index + 1 : leg.end_index])


def test_rank_and_arteries(world):
    n, _, cand, _ = world
    order = pool.ranked(cand).where("qid = 'conc S T'").orderBy("rank").collect()
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
    assert all(a.q >= b.q for a, b in zip(order, order[1:]))
    lead = pool.leading_arteries(cand).where("qid = 'pair S E'").count()
    assert lead == 2
    assert cand.groupBy("qid", F.array_sort("edges")).count().where("count > 1").count() == 0
