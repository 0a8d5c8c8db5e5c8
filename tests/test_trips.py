"""Typed names to shown results in one call, with closures, unknown names and places without a name."""

from nets import DETOUR, EXCLUDE, WAYPOINT, Net
from waymesh.operators import pool, report, trips


def test_typed_names_to_results(spark):
    routes = [" ".join(f"{n}.{p}" for p in r.split()) for n, lines in (("x", EXCLUDE), ("w", WAYPOINT), ("d", DETOUR)) for r in lines]
    net = Net(spark, routes)
    registry = spark.createDataFrame(
        [(i, n, "other") for n, i in net.ids.items()], "place_id long, name string, `group` string"
    )
    asked = [
        ("closed", " x.S", "x.T ", None),
        ("via", "w.A", "w.B", ["", " w.C", "w.A"]),
        ("still", "x.S", "x.S", []),
        ("blank", "  ", "x.T", []),
        ("null", None, "x.T", []),
        ("strange", "x.S", "nowhere", []),
        ("strange via", "x.S", "x.T", ["nowhere"]),
        ("apart", "x.S", "w.B", []),
    ]
    requests = spark.createDataFrame(asked, "qid string, start string, end string, via array<string>")
    closed = spark.createDataFrame([(net.ids["x.M"],)], "place long")
    rows = trips.answer(requests, registry, pool.prepare(net.net), net.net.stops, closed).collect()
    got = {r.qid: r for r in rows}
    assert len(rows) == len(asked)
    assert {q: r.status for q, r in got.items()} == {
        "closed": "ok", "via": "ok", "still": "ok", "blank": "error", "null": "error",
        "strange": "empty", "strange via": "empty", "apart": "ok",
    }
    for qid in ("blank", "null", "strange", "strange via", "apart"):
        assert got[qid].paths == got[qid].meta == got[qid].compromisedDetour == []
    assert got["closed"].paths == [["x.S", "x.N", "x.T"]] and got["closed"].compromisedDetour == ["x.M"]
    meta = got["closed"].meta[0].asDict(recursive=True)
    assert meta["routeCount"] == 1 and meta["priority"] == 0
    chip = {"id": 1, "label": "x.S - x.T", "share": 100, "priority": 0, "startIndex": 0, "endIndex": 2}
    assert meta["routes"] == [chip]
    assert meta["legs"] == [
        {"start": "x.S", "end": "x.T", "startIndex": 0, "endIndex": 2, "match": meta["match"], "priority": 0, "routes": [chip]}
    ]
    via = got["via"].meta[0]
    assert got["via"].paths[0] == ["w.A", "w.C", "w.B"]
    assert [(leg.start, leg.end) for leg in via.legs] == [("w.A", "w.C"), ("w.C", "w.B")]
    assert [c.label for c in via.routes] == ["w.A - w.C", "w.C - w.B"]
    assert [[c.startIndex for c in leg.routes] for leg in via.legs] == [[0], [1]]
    assert got["still"].paths == [["x.S"]] and got["still"].meta[0].routes == []
    assert got["still"].meta[0].legs[0].routes == []


def test_chips_of_places_without_names(spark):
    chips = spark.createDataFrame([(1, 7, 8)], "chip int, origin long, destination long")
    names = spark.createDataFrame([(7, "Seven")], "place_id long, display string")
    assert report.labelled(chips, names).first().label == "Seven - 8"
