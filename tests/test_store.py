import json

from waymesh.operators import pool, report, select
from waymesh.sources import documents as dc
from waymesh.streaming import refresh

DOCS = [
    ["A", "B", "C", "D"],
    {"places": ["C", "M", "N", "G", "E", "R"], "priority": 2},
    {"places": ["A"], "branches": [{"places": ["E", "J", "K", "L"]}, ["Z"]]},
]


def test_round_trip_and_freshness(spark, tmp_path):
    (tmp_path / "routes.json").write_text(json.dumps(DOCS))
    nodes = dc.load_routes(dc.read_whole_file(spark, str(tmp_path / "routes.json")))
    got = {(r.route_idx, tuple(r.node_path)): (r.places, len(r.marks)) for r in nodes.collect()}
    assert got[(1, ())] == (["C", "M", "N", "G", "E", "R"], 1)
    assert got[(2, (0,))] == (["E", "J", "K", "L"], 0) and got[(2, (1,))] == (["Z"], 0)
    store = dc.Store(spark, str(tmp_path / "store"))
    assert store.stale()
    assert store.save_routes(nodes).count() == 0
    assert not store.stale()
    shown = {(r.route_idx, tuple(r.node_path)): r.places for r in store.load_routes().collect()}
    assert shown[(2, (0,))] == ["E", "J", "K", "L"]
    net = store.network()
    assert net.edges.select("a", "b").distinct().count() == 13
    assert net.marks.first().priority == 2
    # the same routes in another order are other route ids
    swapped = nodes.selectExpr("2 - route_idx as route_idx", "node_path", "places", "marks", "priority")
    assert dc.fingerprint(nodes).first() != dc.fingerprint(swapped).first()
    bad = store.save_closures(spark.createDataFrame([(0, ["Q"])], "group_idx int, places array<string>"))
    assert bad.first().rule == "unknown place"
    assert store.save_closures(spark.createDataFrame([(0, [" M "])], "group_idx int, places array<string>")).count() == 0
    assert store.closed_places().count() == 1
    store.export_network(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).where("compromised").first().id == "M"
    ids = {r.name: r.place_id for r in store.registry().collect()}
    trips = spark.createDataFrame([("q", ids["A"], ids["R"])], "qid string, start_place long, end_place long")
    from waymesh.operators.legs import one_leg

    cand = one_leg(pool.candidate_pool(trips, pool.prepare(net)))
    clean, detour = select.closure_report(cand, store.closed_places())
    records = report.route_records(clean, dc.tree.corridor_stops(store.corridors()), ["qid", "slot"])
    dc.export_results(records, detour, str(tmp_path / "res"))
    out = spark.read.json(str(tmp_path / "res")).first()
    assert out.paths and ids["M"] not in out.paths[0]


BAD = {
    1: ('{"places": "A"}', (), "places is not a list"),
    2: ('{"places": ["A", "B"], "priority": true}', (), "priority is not a whole number"),
    3: ("7", (), "not a route"),
    4: ('{"places": ["A"], "branches": {}}', (), "branches is not a list"),
    5: ('{"places": ["A", "B"], "priority": "high"}', (), "priority is not a whole number"),
    6: ('{"places": ["A", "B"], "priority": 2.7}', (), "priority is not a whole number"),
    7: ('{"places": ["A", "B"], "marks": "abc"}', (), "marks is not a list"),
    8: ("[1, 2]", (), "a place is not text"),
    9: ('{"x": 1}', (), "places is not a list"),
    10: ('{"places": ["A"], "branches": [["B"], {"places": ["C"], "priority": "x"}]}', (1,), "priority is not a whole number"),
    11: ('{"places": ["A"], "branches": [{"places": ["C"], "branches": [{"x": 1}]}]}', (0, 0), "places is not a list"),
    12: ('{"places": ["A", "B", "C"], "marks": [{"from": 0.5, "to": 1, "priority": 1}]}', (), "a mark is not three whole numbers"),
    13: ('{"places": ["A", "B", "C"], "marks": [7]}', (), "a mark is not three whole numbers"),
    14: ("{", (), "not a route"),
    15: ('{"places": [null, "B"]}', (), "a place is not text"),
}


def test_shapes(spark):
    docs = spark.createDataFrame([(0, '["A","B"]')] + [(i, d) for i, (d, *_) in BAD.items()], "route_idx int, doc string")
    got = {(r.route_idx, tuple(r.node_path), r.rule) for r in dc.shape_violations(dc.unfold(docs)).collect()}
    assert got == {(i, p, rule) for i, (_, p, rule) in BAD.items()} | {(i, (), "places is not a list") for i in (3, 14)}


def test_bad_documents_stop_the_write(spark, tmp_path):
    store = dc.Store(spark, str(tmp_path / "s"))
    good = spark.createDataFrame([(0, '["A","B","C"]'), (1, '{"places": ["C", "D"], "priority": 2}')], "route_idx int, doc string")
    assert store.save_documents(good).isEmpty()
    before = sorted(map(tuple, store.edges().collect()))
    for i in (5, 8, 9, 11):
        wrong = store.save_documents(good.unionByName(spark.createDataFrame([(7, BAD[i][0])], "route_idx int, doc string")))
        assert BAD[i][2] in {r.rule for r in wrong.where("route_idx = 7").collect()}
        assert sorted(map(tuple, store.edges().collect())) == before
    empty = good.unionByName(spark.createDataFrame([(7, '{"places": []}')], "route_idx int, doc string"))
    assert {r.rule for r in store.save_documents(empty).collect()} == {"too few places"}


def test_stream_keeps_the_latest_and_the_sound(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    lines = [
        {"route_idx": 0, "route": ["Z", "Y"]},
        {"route_idx": 0, "route": ["A", "B"]},
        {"route_idx": 1, "version": 5, "route": ["C", "D"]},
        {"route_idx": 1, "version": 4, "route": ["E", "F"]},
        {"route_idx": 2, "route": {"x": 1}},
        {"route": ["A", "B"]},
    ]
    (inbox / "1.txt").write_text("\n".join(map(json.dumps, lines)))
    store = dc.Store(spark, str(tmp_path / "s"))
    refresh.watch(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    assert {r.route_idx: r.places for r in store.load_routes().collect()} == {0: ["A", "B"], 1: ["C", "D"]}
    rejected = spark.read.parquet(str(tmp_path / "s" / "rejected")).collect()
    assert {(r.route_idx, tuple(r.rules)) for r in rejected} == {(2, ("places is not a list",)), (None, ("no route number or no route",))}


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.txt").write_text("\n".join(json.dumps({"route_idx": i, "route": r}) for i, r in enumerate(DOCS)))
    streamed = dc.Store(spark, str(tmp_path / "s"))
    refresh.watch(spark, str(inbox), streamed, str(tmp_path / "ck")).awaitTermination()
    batch = dc.Store(spark, str(tmp_path / "b"))
    batch.save_routes(dc.load_routes(dc.read_documents(spark, str(inbox))))
    rows = lambda s: sorted(map(tuple, s.edges().collect()))
    assert rows(streamed) == rows(batch) != []
