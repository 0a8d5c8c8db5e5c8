"""Pools of trips in small components, made by one task: the same chains under the same names as by waves of searches."""

import random
from dataclasses import replace

from nets import Net
from test_artery_bound import networks

from pyspark.sql import functions as F

from waymesh.operators import pool, search as se
from waymesh.session import cut


def rows_of(df):
    return {(r.qid, r.cid, tuple(r.stops)) for r in df.select("qid", "cid", "stops").collect()}


def test_one_task_finds_what_the_waves_find(spark, monkeypatch):
    rng = random.Random(5)
    routes, marks, trips = networks(14, rng)
    net = Net(spark, routes, marks)
    ready = pool.prepare(net.net)
    assert ready.rail.where("area is null").isEmpty() and ready.worst == 3
    # The same network without areas goes by rounds.
    by_rounds = replace(ready, rail=cut(ready.rail.withColumn("area", F.lit(None).cast("long")), "rail"))
    used = sorted(net.ids.values())
    rows = [(q, net.ids[a], net.ids[b], rng.sample(used, rng.randrange(3)) + [net.ids[a.split(".")[0] + ".p1"]] * (i % 2))
            for i, (q, a, b) in enumerate(trips) if a.split(".")[0] + ".p1" in net.ids and net.ids[a] != net.ids[b]]
    rows += [("stay", rows[0][1], rows[0][1], []), ("gone", -1, rows[0][2], []), ("lost", rows[0][1], -1, []), ("apart", rows[0][1], rows[-1][2], [])]
    asked = spark.createDataFrame(rows, "qid string, start_place long, end_place long, banned array<bigint>")
    want = rows_of(pool.generate(asked.where("start_place <> end_place"), by_rounds))
    assert len(want) > 80 and {k.split("|")[2].rstrip("0123") for _, k, _ in want} >= {"plain", "ride", "floor", "again"}
    whole = pool.candidate_pool(asked, by_rounds)
    calls = []
    monkeypatch.setattr(se, "search", lambda *a, **b: calls.append(a))
    got = pool.candidate_pool(asked, ready)
    assert not calls
    assert {r for r in rows_of(got) if "|pair|" not in r[1] and r[0] != "stay"} == want
    assert rows_of(got) == rows_of(whole)
    assert got.columns == whole.columns
    plain = lambda df: sorted(map(repr, df.drop("q").collect()))
    assert plain(got) == plain(whole)
    assert {(r.qid, r.cid, round(r.q, 9)) for r in got.collect()} == {(r.qid, r.cid, round(r.q, 9)) for r in whole.collect()}
    assert any(len(r.runs) > 1 and r.priority for r in got.collect())
    # Chains scored by hops alone, against the joins.
    by_hops = pool.candidate_pool(asked, ready, crossroads_only=False)
    scored = pool.score(by_hops.select("qid", "cid", "stops"), ready.net, ["qid", "cid"], crossroads_only=False)
    assert plain(by_hops.select(scored.columns)) == plain(scored)


def test_a_part_of_the_network_counts_the_whole(spark):
    routes, marks, trips = networks(6, random.Random(11))
    net = Net(spark, routes, marks)
    ready = pool.prepare(net.net)
    mine = [net.ids[n] for n in net.ids if n.startswith("2.")]
    n = net.net
    ours = n.stops.where(F.col("place").isin(mine)).select("route_id").distinct()
    keep = lambda df: df.join(ours, "route_id", "left_semi")
    part = pool.Network(keep(n.stops), keep(n.edges), n.degree.where(F.col("place").isin(mine)), keep(n.marks))
    whole = pool.Whole(n.degree.count(), ready.worst, ready.totals)
    small = pool.prepare(part, whole=whole)
    assert (small.ban, small.worst, small.routes) == (ready.ban, ready.worst, ready.routes)
    rows = [(q, net.ids[a], net.ids[b]) for q, a, b in trips if q.startswith("2:")]
    asked = spark.createDataFrame(rows, "qid string, start_place long, end_place long")
    got = rows_of(pool.candidate_pool(asked, small))
    assert got and got == rows_of(pool.candidate_pool(asked, ready))
