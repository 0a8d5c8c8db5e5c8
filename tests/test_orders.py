import itertools
import random

from waymesh.operators.legs import cheapest_order, trim_sizes


def brute(count, cost):
    best = None
    for order in itertools.permutations(range(1, count + 1)):
        line = [0, *order, count + 1]
        legs = list(zip(line, line[1:]))
        if all(leg in cost for leg in legs):
            price = sum(cost[leg] for leg in legs)
            if best is None or price < best[0]:
                best = (price, list(order))
    return best and best[1]


def test_exact_order_is_the_first_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        count = rng.randrange(0, 7)
        cost = {
            (i, j): rng.randrange(1, 4)
            for i in range(count + 2)
            for j in range(count + 2)
            if i != j and rng.random() < 0.7
        }
        assert cheapest_order(count, cost) == brute(count, cost), (count, cost)


def test_nine_stops():
    rng = random.Random(2)
    cost = {(i, j): rng.randrange(1, 50) for i in range(11) for j in range(11) if i != j}
    order = cheapest_order(9, cost)
    line = [0, *order, 10]
    price = sum(cost[leg] for leg in zip(line, line[1:]))
    for _ in range(3000):
        other = [0, *rng.sample(range(1, 10), 9), 10]
        assert price <= sum(cost[leg] for leg in zip(other, other[1:]))


def test_a_limit_is_the_callers(spark):
    sizes = spark.createDataFrame([("q", 0, 30), ("q", 1, 10), ("q", 2, 10)], "qid string, leg int, n long")
    kept = {r.leg: r.keep for r in trim_sizes(sizes, 2000).collect()}
    assert kept[0] * kept[1] * kept[2] <= 2000 and kept[1] == 10
