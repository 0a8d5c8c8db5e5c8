from pyspark.sql import functions as F

from waymesh.operators import edits, tree

SCHEMA = "route_idx int, node_path array<int>, places array<string>, marks array<struct<from:int,to:int,priority:int>>, priority int"


def nodes(spark, *rows):
    return spark.createDataFrame(
        [(i, p, s.split(), [tuple(m) for m in marks], pr) for i, p, s, marks, pr in rows], SCHEMA
    )


def as_dict(df):
    return {
        (r.route_idx, tuple(r.node_path)): (" ".join(r.places), [(m["from"], m["to"], m["priority"]) for m in r.marks])
        for r in df.collect()
    }


def test_expand(spark):
    t = nodes(
        spark,
        (0, [], "J T1 T2", [], None), (0, [0], "H1a H1b", [], None), (0, [1], "H2a", [], None), (0, [2], "H3a H3b", [], None),
        (1, [], "D E", [], None), (1, [0], "C", [], None), (1, [0, 0], "A B", [], None), (1, [0, 1], "X", [], None),
        (2, [], "P Q", [], None),
    )
    out = [" ".join(r.places) for r in tree.leaves(t).orderBy("route_id").collect()]
    assert out == ["H1a H1b J T1 T2", "H2a J T1 T2", "H3a H3b J T1 T2", "A B C D E", "X C D E", "P Q"]
    assert {r.route_idx: r.leaves for r in tree.leaf_count(t).collect()} == {0: 3, 1: 2, 2: 1}
    assert tree.route_stops(t).count() == 16
    frame = tree.with_frame(t).where("size(node_path) = 2 and node_path[1] = 0").first().frame
    assert " ".join(frame) == "A B C D E"


def test_legacy_rating_and_marks(spark):
    t = tree.upgrade(nodes(
        spark,
        (0, [], "J T", [], 2), (0, [0], "H1a H1b", [], None), (0, [1], "H2a H2b", [], 0),
        (1, [], "P Q", [(0, 1, 1)], 3),
        (2, [], "S", [], None), (2, [0], "R", [], 3),
    ))
    c = tree.leaves(t)
    m = tree.resolved_marks(t, c)
    got = {(r.route_id, r.start_place, r.end_place, r.priority) for r in m.collect()}
    assert got == {(0, "H1a", "T", 2), (2, "P", "Q", 1), (3, "R", "S", 3)}
    pr = {r.route_idx: r.priorities for r in tree.route_priorities(c, m).collect()}
    assert pr == {0: [0, 2], 1: [1], 2: [3]}
    flags = edits.row_flags(t, tree.route_priorities(c, m), spark.createDataFrame([("H2b",)], "place string"))
    got = {r.route_idx: (r.compromised, r.worst, r.branched, r.too_short) for r in flags.collect()}
    assert got == {0: (True, 2, True, False), 1: (False, 1, False, False), 2: (False, 3, True, False)}


def test_pieces_and_ranges(spark):
    t = nodes(spark, (0, [], "J T U", [], None), (0, [0], "A B", [(1, 3, 2)], None))
    got = {(tuple(r.up_path), r["from"], r.to, r.head, r.continues) for r in tree.mark_pieces(t).collect()}
    assert got == {((0,), 1, 1, True, True), ((), 0, 1, False, False)}
    ranges = spark.createDataFrame([(7, 0, [0], 1, 3)], "range_id int, route_idx int, node_path array<int>, from int, to int")
    assert tree.frame_range_stops(t, ranges).first().places == ["B", "J", "T"]
    assert as_dict(tree.extract_routes(t, ranges, 5))[(5, ())] == ("B J T", [])


def test_set_and_remove_marks(spark):
    t = nodes(spark, (0, [], "a b c d e f", [(0, 5, 1)], None), (1, [], "a b c d e", [(0, 2, 1), (2, 4, 2)], None), (2, [], "a b c", [(0, 2, 3)], None))
    new = spark.createDataFrame([(0, [], 4, 2, 3), (1, [], 2, 3, 0), (2, [], 1, 1, 2)], "route_idx int, node_path array<int>, from int, to int, priority int")
    got = as_dict(edits.set_marks(t, new))
    assert got[(0, ())][1] == [(0, 2, 1), (2, 4, 3), (4, 5, 1)]
    assert got[(1, ())][1] == [(0, 2, 1), (3, 4, 2)]
    assert got[(2, ())][1] == [(0, 2, 3)]
    gone = spark.createDataFrame([(1, [], 0)], "route_idx int, node_path array<int>, mark_index int")
    assert as_dict(edits.remove_marks(t, gone))[(1, ())][1] == [(2, 4, 2)]


def test_patch_and_remove(spark):
    t = nodes(
        spark,
        (0, [], "a b c d e", [(1, 3, 2)], None),
        (1, [], "J K L", [(0, 2, 1)], None), (1, [0], "x y", [(0, 3, 2)], None), (1, [1], "z", [(0, 1, 3)], None),
    )
    p = lambda i, path, s: (i, path, s.split())
    sch = "route_idx int, node_path array<int>, next array<string>"
    ins = as_dict(edits.patch_places(t, spark.createDataFrame([p(0, [], "a q b c d e"), p(1, [], "J N K L")], sch)))
    assert ins[(0, ())] == ("a q b c d e", [(2, 4, 2)])
    assert ins[(1, ())][1] == [(0, 3, 1)]
    assert ins[(1, (0,))][1] == [(0, 4, 2)] and ins[(1, (1,))][1] == [(0, 1, 3)]
    head = as_dict(edits.patch_places(t, spark.createDataFrame([p(1, [0], "y")], sch)))
    assert head[(1, (0,))] == ("y", [(0, 2, 2)])
    cutr = spark.createDataFrame([(0, [], 3, 4), (1, [0], 1, 2)], "route_idx int, node_path array<int>, from int, to int")
    got = as_dict(edits.remove_range(t, cutr))
    assert got[(0, ())] == ("a b c", [(1, 2, 2)])
    assert got[(1, (0,))] == ("x", [(0, 1, 2)]) and got[(1, ())] == ("K L", [(0, 1, 1)])
    assert got[(1, (1,))] == ("z", [])


def test_small_edits(spark):
    t = nodes(spark, (0, [], "a b c", [(0, 1, 2)], None), (1, [], "b a", [], None))
    assert as_dict(edits.reverse_routes(t))[(0, ())] == ("c b a", [(1, 2, 2)])
    ren = spark.createDataFrame([("a", "z")], "old string, new string")
    assert edits.rename_counts(t, ren).first().occurrences == 2
    assert as_dict(edits.rename_stops(t, ren))[(1, ())][0] == "b z"
    dup = as_dict(edits.duplicate_routes(t, spark.createDataFrame([(0,)], "route_idx int")))
    assert {k[0]: v[0] for k, v in dup.items()} == {0: "a b c", 1: "a b c", 2: "b a"}
    row = spark.createDataFrame([(" x, y ,,z ",)], "t string").select(edits.split_stops(F.col("t")).alias("s")).first()
    assert row.s == ["x", "y", "z"]
    pr = spark.createDataFrame([(0, [0, 2]), (1, [0])], "route_idx int, priorities array<int>")
    ids = lambda df: sorted(r.route_idx for r in df.collect())
    assert ids(edits.filter_routes(t, pr, ["A"], "c")) == [0]
    assert ids(edits.filter_routes(t, pr, [], "", [2])) == [0]
    assert ids(edits.filter_routes(t, pr)) == [0, 1]
    assert ids(edits.filter_routes(t, pr, ["q"], pinned=spark.createDataFrame([(1,)], "route_idx int"))) == [1]
