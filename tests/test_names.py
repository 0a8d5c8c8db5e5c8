from test_tree import nodes

from pyspark.sql import functions as F

from waymesh.functions import text as tx
from waymesh.operators import names, registry as rg, validate as va


def col(spark, values, name="text"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_prefixes_round_trip(spark):
    df = col(spark, ["מ. גולני", "מ.גולני", "מחלף גולני", "צומת", "ש.א 5", "כביש 6", "גומא", " מוצב  צפון ", "מ."])
    got = [tuple(r) for r in df.select(tx.classify(F.col("text")), tx.base_name(F.col("text"))).collect()]
    assert got == [
        ("camp", "גולני"), ("camp", "גולני"), ("interchange", "גולני"), ("other", "צומת"), ("firing_zone", "5"),
        ("road", "6"), ("other", "גומא"), ("post", "צפון"), ("other", "מ."),
    ]
    shown = df.select(tx.format_place(tx.base_name(F.col("text")), tx.classify(F.col("text"))).alias("d")).collect()
    assert [r.d for r in shown][:3] == ["מ. גולני", "מ. גולני", "מחלף גולני"]


def test_mint_resolve_translate(spark):
    t = nodes(spark, (0, [], "צ.ב C", [], None), (0, [0], "A", [], None), (1, [], "A D", [], None))
    old = spark.createDataFrame([(5, "C", "other")], "place_id long, name string, group string")
    reg = rg.mint(t, old)
    got = {r.name: (r.place_id, r.group) for r in reg.collect()}
    assert got == {"C": (5, "other"), "ב": (6, "junction"), "A": (7, "other"), "D": (8, "other")}
    ids = rg.to_ids(t, reg)
    assert {tuple(r.node_path): r.places for r in ids.where("route_idx = 0").collect()} == {(): [6, 5], (0,): [7]}
    back = rg.to_display(ids, reg).where("route_idx = 0 and size(node_path) = 0").first()
    assert back.places == ["צ. ב", "C"]
    assert rg.duplicates(reg).count() == 0


def test_reclassify(spark):
    reg = spark.createDataFrame([(1, "כביש 6", "other"), (2, "כביש 7", "other"), (3, "7", "road")], "place_id long, name string, group string")
    out, skipped = rg.reclassify(reg)
    assert {r.place_id: (r.name, r.group) for r in out.collect()} == {1: ("6", "road"), 2: ("כביש 7", "other"), 3: ("7", "road")}
    assert [r.place_id for r in skipped.collect()] == [2]


def test_score_tiers(spark):
    pairs = [
        ("golan", "Golan", 1000), ("go", "golan", 897), ("a.b", "ab cd", 847), ("lan", "golan", 748),
        ("o.l", "gol", 699), ("", "x", 0), ("golxn", "golan", 480), ("goxxx", "golan", -1), ("gol", "gxl", 480), ("gx", "gol", -1),
        ("abcdefgh", "zzabcxexghzz", 460),
    ]
    df = spark.createDataFrame([(q, o) for q, o, _ in pairs], "q string, o string").select(
        tx.normalize(F.col("q")).alias("qn"), tx.normalize(F.col("o")).alias("on")
    ).withColumn("qs", tx.strip_punct(F.col("qn"))).withColumn("os", tx.strip_punct(F.col("on")))
    got = [r.s for r in df.select(tx.match_score("qn", "on", "qs", "os").alias("s")).collect()]
    assert got == [s for _, _, s in pairs]


def test_both_distances_agree(spark):
    import itertools

    texts = ["".join(t) for n in range(0, 5) for t in itertools.product("ab", repeat=n)]
    rows = [(p, t) for p in ("abb", "aabba", "abcabc") for t in texts]
    df = spark.createDataFrame(rows, "p string, t string").select(
        "p", "t", tx.substring_distance("p", "t").alias("exact"), tx.near_distance("p", "t").alias("near"),
        tx.typo_budget(F.length("p")).alias("d"),
    )
    for r in df.collect():
        assert r.near == (r.exact if r.exact <= r.d else None), r


def test_filters_agree_with_all_pairs(spark):
    words = ["golan", "golani", "galon", "north gate", "gate-north", "tel aviv", "tel", "telem", "מ. גולני", "x", "a-b", "ab"]
    asked = ["golan", "glan", "gate n", "tel avv", "t", "-", " ", "zzz", "north", "ab", "גולני", "no ga"]
    opts = spark.createDataFrame(list(enumerate(words)), "ord int, option string")
    qs = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    for strict in (False, True):
        got = (names.strict_filter if strict else names.fuzzy_filter)(opts, qs, 4)
        every = names._asked(qs).crossJoin(names._prepared(opts))
        every = every.withColumn("q_words", tx.words_of(F.col("query"))).withColumn("o_words", tx.words_of(F.col("option")))
        score = tx.strict_score() if strict else tx.match_score("q_norm", "o_norm", "q_strip", "o_strip")
        want = names.top(every.withColumn("score", score).where("score > 0 and query <> ''"), 4)
        have = {(r.qid, r["rank"], r.option, r.score) for r in got.collect() if r.qid != 6}
        assert have == {tuple(r) for r in want.collect()}
        assert [r.option for r in got.where("qid = 6").orderBy("rank").collect()] == words[:4]


def test_violations(spark):
    t = nodes(
        spark,
        (0, [], "A B C", [(0, 1, 1), (1, 2, 2)], None),
        (1, [], "A B C", [(0, 2, 1), (1, 2, 2)], None),
        (2, [], "A B", [(0, 2, 1), (0, 1, 0)], 7),
        (3, [], "A", [], None),
        (4, [], "A", [], None), (4, [0], "B A", [(2, 3, 1), (2, 2, 5)], None),
        (5, [], "A B", [], None), (5, [0], "C", [(0, 2, 3)], None),
    )
    got = {(r.route_idx, r.rule) for r in va.route_violations(t).collect()}
    assert got == {
        (1, "marks overlap"), (2, "mark outside the route"), (2, "mark states the best priority"),
        (2, "marks overlap"), (2, "priority out of range"), (3, "too few places"), (4, "place visited twice"),
        (4, "mark outside the route"), (4, "mark priority out of range"), (4, "marks overlap"),
    }
    assert sorted(r.route_idx for r in va.valid_routes(t).collect()) == [0, 5]
    known = col(spark, ["A", "B", "C"])
    groups = spark.createDataFrame([(0, ["A"]), (1, []), (2, [" ", "Z"])], "group_idx int, places array<string>")
    assert {(r.group_idx, r.rule) for r in va.closure_violations(groups, known).collect()} == {
        (1, "empty group"), (2, "blank place"), (2, "unknown place")}
    assert sorted(r.text for r in va.unclaimed(known, groups).collect()) == ["B", "C"]
    around = {(tuple(r.node_path), r.place) for r in va.corridor_places(t).where("route_idx = 5").collect()}
    assert around == {((), "A"), ((), "B"), ((), "C"), ((0,), "A"), ((0,), "B"), ((0,), "C")}
    asked = spark.createDataFrame([(1, 0, "Z"), (1, 1, "A"), (1, 2, "Z"), (1, 3, "")], "qid int, pos int, text string")
    assert [(r.text, r.pos) for r in va.unknown_places(asked, known).collect()] == [("Z", 0)]
    reg = spark.createDataFrame([(1, "A", "other")], "place_id long, name string, group string")
    req = spark.createDataFrame([(1, " A ", "A"), (2, " ", "A"), (3, "A", "Q")], "qid int, start string, end string")
    assert {r.qid: r.status for r in va.admit(req, reg).collect()} == {1: "ok", 2: "error", 3: "empty"}
