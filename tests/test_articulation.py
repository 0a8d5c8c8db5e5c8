"""Articulation points: many small networks beside one another, and a long chain in few rounds."""

import random

from waymesh.operators import articulation as ar


def components_without(pairs, nodes, gone=None):
    root = {n: n for n in nodes if n != gone}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        if gone not in (a, b):
            root[top(a)] = top(b)
    return len({top(n) for n in root})


def cut_places(pairs, nodes):
    whole, degree = components_without(pairs, nodes), {n: 0 for n in nodes}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    return {n for n in nodes if degree[n] and components_without(pairs, nodes, n) > whole}


def run(spark, pairs, nodes, watch=ar.quiet):
    edges = spark.createDataFrame([(min(p), max(p), 0) for p in pairs], "a long, b long, route_id long")
    places = spark.createDataFrame([(n,) for n in nodes], "place long")
    return {r.place for r in ar.articulation_points(edges, places, watch).collect()}


def test_many_networks_like_removal(spark):
    rng = random.Random(6)
    pairs, nodes, want = [], [], set()
    for k in range(60):
        size, base = rng.randint(1, 14), 1000 * k
        names = [base + x for x in rng.sample(range(100), size)]
        links = {tuple(sorted(rng.sample(names, 2))) for _ in range(rng.randint(0, int(1.6 * size)))} if size > 1 else set()
        want |= cut_places(links, names)
        pairs += links
        nodes += names
    ring = [(90_000 + i, 90_000 + (i + 1) % 9) for i in range(9)]
    hub = [(95_000, 95_001 + i) for i in range(30)] + [(95_001, 95_002), (95_003, 95_004)]
    for links in (ring, hub):
        own = sorted({n for p in links for n in p})
        want |= cut_places(links, own)
        pairs += links
        nodes += own
    assert run(spark, pairs, nodes) == want


def test_a_long_chain_takes_few_rounds(spark):
    order = list(range(10_000))
    random.Random(2).shuffle(order)
    pairs = list(zip(order, order[1:]))
    rounds = []
    assert run(spark, pairs, order, rounds.append) == set(order[1:-1])
    assert len(rounds) < 60, {step: rounds.count(step) for step in set(rounds)}


def test_nothing(spark):
    assert run(spark, [], [1, 2]) == set() == run(spark, [], [])


def test_small_networks_take_no_rounds_and_large_ones_the_same_points(spark):
    rng = random.Random(9)
    pairs, nodes, want = set(), [], set()
    for k in range(30):
        size, base = rng.randint(2, 12), 1000 * k
        names = [base + x for x in range(size)]
        links = {tuple(sorted(rng.sample(names, 2))) for _ in range(int(1.4 * size))}
        want |= cut_places(links, names)
        pairs |= links
        nodes += names
    edges = spark.createDataFrame([(a, b, 0) for a, b in pairs], "a long, b long, route_id long")
    places = spark.createDataFrame([(n,) for n in nodes], "place long")
    for small in (4096, 8):
        rounds = []
        assert {r.place for r in ar.articulation_points(edges, places, rounds.append, small=small).collect()} == want
        assert bool(rounds) == (small == 8)
