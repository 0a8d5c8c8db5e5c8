"""The one call from trips to diverse routes, with and without required stops."""

from nets import PARALLEL, WAYPOINT, Net
from waymesh.operators import legs, pool


def test_trips_to_routes(spark):
    routes = [" ".join(f"w.{p}" for p in r.split()) for r in WAYPOINT] + [" ".join(f"p.{p}" for p in r.split()) for r in PARALLEL]
    net = Net(spark, routes)
    at = net.ids
    trips = spark.createDataFrame(
        [("via", at["w.A"], at["w.B"], [at["w.C"]]), ("plain", at["p.S"], at["p.T"], []), ("still", at["p.S"], at["p.S"], [])],
        "qid string, start_place long, end_place long, via array<bigint>",
    )
    got = {}
    for r in legs.find_routes(trips, pool.prepare(net.net), k=3).collect():
        got.setdefault(r.qid, {})[r.slot] = r
    assert net.chain("w.A w.C w.B") == got["via"][0].stops and got["via"][0].hhi == 1.0
    assert [leg.hhi for leg in got["via"][0].legs] == [1.0, 1.0]
    assert len(got["plain"]) == 3 and got["still"][0].stops == [at["p.S"]]
