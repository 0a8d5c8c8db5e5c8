"""The bound that spares artery searches, held against searching every artery."""

import random

from pyspark.sql import functions as F

from nets import Net
from waymesh.operators import pool


def networks(count, rng):
    routes, marks, trips = [], [], []
    for net in range(count):
        places = [f"{net}.p{k}" for k in range(rng.choice([8, 14, 20]))]
        for _ in range(rng.choice([6, 10, 14])):  # sparse and dense networks
            line = rng.sample(places, rng.randrange(2, min(7, len(places))))
            if rng.random() < 0.3 and len(line) > 2:
                first, last = sorted(rng.sample(range(len(line)), 2))
                marks.append((len(routes), line[first], line[last], rng.randrange(1, 4)))
            routes.append(" ".join(line))
        used = sorted({p for r in routes if r.startswith(f"{net}.") for p in r.split()})
        for k in range(2):
            trips.append((f"{net}:{k}", *rng.sample(used, 2)))
    return routes, marks, trips


def test_no_candidate_is_missed(spark, monkeypatch):
    routes, marks, trips = networks(50, random.Random(17))
    net = Net(spark, routes, marks)
    ready = pool.prepare(net.net)
    ids = spark.createDataFrame([(q, net.ids[a], net.ids[b]) for q, a, b in trips], "qid string, start_place long, end_place long")
    asked = ids.withColumn("banned", F.expr("cast(array() as array<bigint>)"))

    def chains():
        got = pool.generate(asked, ready, diversity=1).collect()
        return {(r.qid, tuple(r.stops)) for r in got}

    bounded = chains()
    own = spark.createDataFrame([(r.split(".")[0], i) for i, r in enumerate(routes)], "net string, route_id long")
    every = pool.both_ways(asked).select("qid", "dir", F.split("qid", ":")[0].alias("net")).join(own, "net").select("qid", "dir", "route_id")
    monkeypatch.setattr(pool, "relevant_arteries", lambda *_: every)
    exhaustive = chains()
    assert len(exhaustive) > 100
    assert bounded == exhaustive
