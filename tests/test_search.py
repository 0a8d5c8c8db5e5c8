import heapq
import itertools
import random

from nets import PARALLEL, SPEC, Net

from pyspark.sql import functions as F

from waymesh.operators import search as se
from waymesh.session import cut


def brute(n, routes, src, dst, transfer, hop, step, toll):
    """Cheapest cost over (place, route) states, one search at a time."""
    on, near = {}, {}
    for rid, r in enumerate(routes):
        ps = r.split()
        for a, b in zip(ps, ps[1:]):
            on.setdefault(frozenset((a, b)), set()).add(rid)
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    best, heap, tick = {}, [(0, 0, src, None)], itertools.count(1)
    while heap:
        c, _, p, r = heapq.heappop(heap)
        if p == dst:
            return c
        if best.get((p, r), 1e18) <= c:
            continue
        best[(p, r)] = c
        for q in near.get(p, ()):
            for r2 in on[frozenset((p, q))]:
                cost = c + (0 if r2 == r else transfer) + hop * (len(near[q]) >= 3) + step + toll(p, q)
                heapq.heappush(heap, (cost, next(tick), q, r2))
    return None


def random_routes(seed, places=14, count=12):
    rnd = random.Random(seed)
    names = [chr(65 + i) for i in range(places)]
    return [" ".join(rnd.sample(names, rnd.randint(2, 7))) for _ in range(count)]


def test_costs_match_a_label_setting_search(spark):
    routes = random_routes(5)
    n = Net(spark, routes)
    names = sorted(n.ids)
    pairs = [(x, y) for x in names[:4] for y in names[-5:] if x != y]
    banned = [n.ids[names[6]]]
    rows = [(f"{x}{y}", n.ids[x], n.ids[y]) for x, y in pairs]
    base = spark.createDataFrame(rows, "q string, src long, dst long")
    for section in (2, 2048):
        rail = se.rails(n.net, section=section)
        for transfer, hop, step, ban in ((10**6, 1, 0, 0), (10**6, 1, 10**6, 0), (0, 1, 0, 0), (0, 0, 1, 0), (10**6, 1, 0, 10**8)):
            s = se.plain_searches(
                base, F.col("q"), transfer=transfer, hop_weight=hop, step=step, ban=ban,
                banned=F.array(*[F.lit(b) for b in banned]) if ban else None,
            )
            got = {r.sid: r for r in se.chains_of(se.found(se.search(s, rail), s), n.net.stops, s).collect()}
            for x, y in pairs:
                toll = lambda p, q: ban if names[6] in (p, q) else 0
                want = brute(n, routes, x, y, transfer, hop, step, toll)
                if want is None:
                    assert f"{x}{y}" not in got
                    continue
                row = got[f"{x}{y}"]
                assert row.cost == want
                assert row.stops[0] == n.ids[x] and row.stops[-1] == n.ids[y]
                if transfer:
                    assert len(set(row.stops)) == len(row.stops)


def test_spec_chain(spark):
    n = Net(spark, SPEC)
    base = spark.createDataFrame([(n.ids["K"], n.ids["M"])], "src long, dst long")
    rail = se.rails(n.net)
    s = se.plain_searches(base, F.lit("x"))
    row = se.chains_of(se.found(se.search(s, rail), s), n.net.stops, s).first()
    assert n.text(row.stops) == "K J E G N M"


def test_edge_without_route_is_its_own(spark):
    n = Net(spark, PARALLEL)
    bare = spark.createDataFrame([tuple(sorted((n.ids["a1"], n.ids["d2"])))], "a long, b long")
    rail = se.rails(n.net, bare=bare)
    base = spark.createDataFrame([(n.ids["a1"], n.ids["d2"])], "src long, dst long")
    s = se.plain_searches(base, F.lit("x"))
    assert se.found(se.search(s, rail), s).first().cost == 10**6


def test_distances(spark):
    n = Net(spark, SPEC)
    rail = se.rails(n.net)
    pts = spark.createDataFrame([("q", n.chain("K G B"))], "qid string, points array<bigint>")
    # K J E G: crossroad E; G N M C B or back: C, shared G is no crossroad
    assert se.point_distance(pts, n.net, rail).first().c_min == 2
    assert se.point_distance(pts, n.net, rail, crossroads_only=False).first().c_min == 7


def test_frontiers_hold_improved_labels_alone_and_landmarks_change_no_answer(spark):
    """A long line of short routes beside a dense part, and an island no way leads to."""
    line = [f"L{i:02} M{i:02} L{i + 1:02}" for i in range(12)]
    routes = [*random_routes(11), *line, "A L00", "X1 X2 X3"]
    n = Net(spark, routes)
    bare = cut(se.rails(n.net), "rail")
    rail = cut(se.with_landmarks(bare, se.landmarks(bare, n.net.degree)), "rail")
    ends = [("A", "D"), ("L02", "L07"), ("L06", "L06"), ("B", "X2"), ("X1", "X3"), ("L01", "C")]
    base = spark.createDataFrame([(f"{x}{y}", n.ids[x], n.ids[y]) for x, y in ends], "q string, src long, dst long")
    sizes = {}
    for transfer, hop, step, slack in ((10**6, 1, 0, 0), (10**6, 1, 10**6, 10**6), (0, 0, 1, 0)):
        s = se.plain_searches(base, F.col("q"), transfer=transfer, hop_weight=hop, step=step, slack=slack)
        answers = []
        for way in (bare, rail):
            best, rows = {}, []

            def watch(frontier, best=best, rows=rows):
                for r in frontier.collect():
                    key = (r.sid, r.place, r.through)
                    assert key not in best or r.cost < best[key]  # written because it improved
                    best[key] = r.cost
                rows.append(frontier.count())

            labels = se.search(s, way, watch=watch)
            answers.append({r.sid: r.cost for r in se.found(labels, s).collect()})
            started = {(f"{x}{y}", n.ids[x], None) for x, y in ends} - best.keys()
            assert labels.count() == len(best) + sum(1 for sid, *_ in started if way is bare or sid != "BX2")
            sizes[way is rail] = sum(rows)
        assert answers[0] == answers[1]
        for x, y in ends:
            assert answers[0].get(f"{x}{y}") == brute(n, routes, n.ids[x] and x, y, transfer, hop, step, lambda p, q: 0)
        if transfer:
            assert sizes[True] < 0.7 * sizes[False]
