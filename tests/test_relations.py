"""Relations need the stops alone, and little of them is shuffled."""

import random

import duckdb
from test_insights import naive_components

from pyspark.sql import functions as F

from waymesh.operators import insights
from waymesh.plans import catalog, shared
from waymesh.plans import tables as tb

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_relations_are_found_without_the_rest_of_the_network(spark):
    for name in ("net", "walks", "comp", "trips", "starts"):
        shared.forget(name)
    got = sorted(tuple(r) for r in catalog.QUERIES["k8_relations"](spark, SF).select("selected", "place", "relation").collect())
    assert not [key for key in shared._made if key[2] in ("net", "trips")]
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = catalog.SQL["k8_relations"]
    assert got == sorted(con.execute(f"select selected, place, relation from ({sql})").fetchall())
    assert {r[2] for r in got} == {"selected", "neighbour", "component"}
    starts = sorted(r.place for r in shared.starts(spark, SF).collect())
    assert starts == sorted(r.start_place for r in shared.trips(spark, SF).select("start_place").distinct().collect())


def test_stops_are_grouped_and_numbered_where_their_orders_lie(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.enabled", "false")
    # Two for each of the joins, none for the grouping by stops or the numbering of an order's stops.
    assert shuffles(tb.stops(own, SF)) == 4


def test_nodes_go_along_with_the_pairs_of_their_range(spark, monkeypatch):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 90, 3)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(25)] + [(95, 95)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    ends = {n for p in pairs for n in p if p[0] != p[1]}
    # Only nodes without pairs need be named; repeated ones and one without a name are there once.
    alone = [n for n in range(97) if n not in ends]
    named = spark.createDataFrame([(n,) for n in [*alone, *alone, 3, None, None]], "node long")
    want = naive_components(range(97), pairs)
    written = []
    plain = insights.cut
    monkeypatch.setattr(insights, "cut", lambda df, label="step": written.append(label) or plain(df, label))
    for few in (1 << 18, 0):
        got = [tuple(r) for r in insights.components(named, rows, few=few, close=True).select("node", "component").collect()]
        assert len(got) == 98 and dict(got) == want | {None: None}
    assert written[:2] == ["near", "live"]


def test_relations_of_repeated_links(spark):
    # The square 1 2 3 4 with its links taken several times in both roles, the pair 7 8 and 9 alone.
    links = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (1, 4), (1, 4), (7, 8)], "a long, b long")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)], "place long, component long")
    asked = spark.createDataFrame([(2,), (4,), (8,), (9,), (None,), (99,)], "place long")
    got = sorted(tuple(r) for r in insights.relations(asked, comp, links).collect())
    assert got == [
        (2, 1, "neighbour"), (2, 2, "selected"), (2, 3, "neighbour"), (2, 4, "component"),
        (4, 1, "neighbour"), (4, 2, "component"), (4, 3, "neighbour"), (4, 4, "selected"),
        (8, 7, "neighbour"), (8, 8, "selected"), (9, 9, "selected"),
    ]


def test_links_of_the_network_are_not_shuffled_to_find_neighbours(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    big = own.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    comp = own.range(100_001).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("component"))
    asked = own.createDataFrame([(5,)], "place long").hint("broadcast")
    plan = insights.relations(asked, comp, big)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Exchange hashpartitioning(a#" not in plan
