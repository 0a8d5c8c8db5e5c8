"""Candidate chains of trips in small components: all profiles of a trip in one task.

:func:`pool.generate` runs a wave of searches for every kind of profile and joins what they found. In a
component whose stops one task can hold, the task that holds them makes the waves itself: the same
profiles, the same bound on arteries, the same rounds of :mod:`search`, so the same chains under the same
names, with the records of :func:`score.score`. The stops of a component are packed once for its trips, and no
label of a search is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.chains import BEST_PRIORITY, TRANSFER_WEIGHT
from waymesh.operators.score import RUNS_TYPE

T = TRANSFER_WEIGHT
#: Parts the trips of one component are dealt into, so that a busy component is not one task.
SPREAD = 64
#: Rows a task holds back before it hands them on.
ROWS = 4096
_TRIP = "start_place", "end_place", "banned"
_STOP = "struct<route_id:bigint,pos:int,place:bigint,hop:int,a:bigint,b:bigint,prio:int>"
_MARK = "struct<route_id:bigint,start_place:bigint,end_place:bigint,priority:int>"


class Area:
    """The stops of one component as its searches read them. Routes go by their place in the order of their ids."""

    def __init__(self, stops: list[tuple], marks: list[tuple]):
        """``stops(route_id, pos, place, hop, a, b, prio)``, ``marks(route_id, start_place, end_place, priority)``."""
        self.ids: list[int] = []
        self.lines: list[tuple[list, list, list, list]] = []  # places, positions, crossroads, (edge, rating) or null
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.hop: dict[int, int] = {}
        self.prio: dict[tuple[int, int], int] = {}
        self.taken: dict[tuple[int, int], list[int]] = {}
        self.rated: dict[int, list[tuple]] = {}
        for route_id, pos, place, hop, a, b, prio in sorted(stops, key=lambda s: s[:2]):
            if not self.ids or self.ids[-1] != route_id:
                self.ids.append(route_id)
                self.lines.append(([], [], [], []))
            route, (places, seats, hops, edges) = len(self.ids) - 1, self.lines[-1]
            self.at.setdefault(place, []).append((route, len(places)))
            self.hop[place] = hop
            edge = (a, b)
            if a is not None:
                self.taken.setdefault(edge, []).append(route)
                if a != b:
                    self.prio[edge] = prio
            places.append(place)
            seats.append(pos)
            hops.append(hop)
            edges.append(None if a is None else (edge, prio))
        for route_id, start, end, priority in marks:
            if priority != BEST_PRIORITY:
                self.rated.setdefault(route_id, []).append((start, end, priority))
        self.seats = {route: dict(zip(line[1], line[0])) for route, line in zip(self.ids, self.lines)}
        self.edges = {
            route: {e[0] for e in line[3] if e is not None and e[0][0] != e[0][1]} for route, line in zip(self.ids, self.lines)
        }
        self.floor = {
            route: max((m[2] for m in self.rated.get(route, ())), default=BEST_PRIORITY) for route, edges in self.edges.items() if edges
        }

    def rides(self, goal: int) -> dict[int, int]:
        """The fewest rides from every place to ``goal``."""
        far = {goal: 0}
        front, ridden, count = [goal], set(), 0
        while front:
            count += 1
            met = []
            for place in front:
                for route, _ in self.at.get(place, ()):
                    if route not in ridden:
                        ridden.add(route)
                        met += [p for p in self.lines[route][0] if p not in far]
            far |= dict.fromkeys(met, count)
            front = list(dict.fromkeys(met))
        return far

    def settle(
        self, src: int, dst: int, transfer: int, slack: int, most: float, rest: dict[int, int], paid: Callable[[int], tuple[list, list]]
    ) -> dict[int, tuple]:
        """The labels ``place -> (cost, rides)``, by the rounds of :func:`search._rounds_within`. ``most`` is what an
        answer costs at most, ``rest`` what is left to pay at a place at least, if it leads to ``dst`` at all. ``paid``
        of a route are its costs from the first stop up to and into each, and those of entering each alone."""
        best: dict[int, tuple] = {src: (0, ())}
        front, at, lines, ids = dict(best), self.at, self.lines, self.ids
        most += slack
        while front:
            if dst in best:
                most = min(most, best[dst][0] + slack)
            boards: dict[int, dict[int, tuple]] = {}
            for place, (cost, rides) in front.items():
                if cost + transfer <= most and cost + rest.get(place, transfer) <= most:
                    for route, i in at[place]:
                        on = boards.get(route)
                        if on is None:
                            on = boards[route] = {}
                        on[i] = (cost + transfer, rides)
            arrived: dict[int, tuple] = {}
            for route, on in boards.items():
                places, seats = lines[route][:2]
                to, into = paid(route)
                name = ids[route]
                for order, back in ((range(min(on), len(places)), False), (range(max(on), -1, -1), True)):
                    ride = None  # the best boarding so far: (cost at the route's first stop, rides, pos)
                    for i in order:
                        if ride is not None:
                            place = places[i]
                            cost = ride[0] - to[i] + into[i] if back else ride[0] + to[i]
                            if (place not in best or cost < best[place][0]) and cost + rest.get(place, transfer) <= most:
                                met = arrived.get(place)
                                if met is None or cost <= met[0]:
                                    way = (cost, (*ride[1], (name, ride[2], seats[i])))
                                    if met is None or way < met:
                                        arrived[place] = way
                        if i in on:
                            cost, rides = on[i]
                            mine = (cost + to[i] - into[i] if back else cost - to[i], rides, seats[i])
                            if ride is None or mine < ride:
                                ride = mine
            best.update(arrived)
            front = arrived
        return best

    def chain(self, src: int, rides: tuple) -> tuple:
        """The rides spelled out stop by stop."""
        out: list = []
        for route, p, q in rides:
            step = 1 if q >= p else -1
            seat = self.seats[route]
            out += [seat.get(i) for i in range(p + step if out else p, q + step, step)]
        return tuple(out) or (src,)

    def forced(self, chain: tuple) -> int | None:
        """The worst rating of a chain's edges, null if none is rated."""
        rated = [self.prio.get(_edge(x, y), 0) for x, y in zip(chain, chain[1:])]
        return max(rated, default=0) or None


    def score(self, chain: tuple, crossroads_only: bool) -> tuple:
        """:func:`score.score` of a chain: what follows ``stops`` in ``SCORED``."""
        flags = [self.hop.get(p) or 0 if crossroads_only else 1 for p in chain]
        count = len(chain) - 1
        spans: list[list] = []  # route, first stop, last stop
        going: dict[int, list] = {}
        first: dict[tuple, int] = {}
        for i in range(count):
            edge = _edge(chain[i], chain[i + 1])
            first.setdefault(edge, i)
            on = {self.ids[r] for r in self.taken.get(edge, ())} if edge in self.prio else ()
            on = on or (-first[edge] - 1,)
            going = {r: going[r] if r in going else [r, i, i] for r in on}
            for span in going.values():
                if span[1] == i:
                    spans.append(span)
                span[2] = i + 1
        length = [0]
        for i in range(count):
            length.append(length[-1] + (flags[i] + flags[i + 1] if crossroads_only else 1))
        reach = list(range(count))
        for _, lo, hi in spans:
            for i in range(lo, hi):
                reach[i] = min(reach[i], lo)
        best = [(0, 0, 0)]
        for j in range(1, count + 1):
            best.append(max((best[i][0] + (length[j] - length[i]) ** 2, best[i][1] - 1, -i) for i in range(reach[j - 1], j)))
        cuts = [count]
        while cuts[-1]:
            cuts.append(-best[cuts[-1]][2])
        cuts.reverse()
        stands: dict = {}
        for i, place in enumerate(chain):
            stands.setdefault(place, []).append(i)
        ridden = [
            (min(x, y), max(x, y), priority)
            for route, lo, hi in spans
            for start, end, priority in self.rated.get(route, ())
            for x in stands.get(start, ()) if lo <= x <= hi
            for y in stands.get(end, ()) if lo <= y <= hi and x != y
        ]
        runs = []
        for lo, hi in zip(cuts, cuts[1:]):
            route = min(r for r, x, y in spans if x <= lo and hi <= y)
            worst = max((p for x, y, p in ridden if x < hi and lo < y), default=BEST_PRIORITY)
            runs.append((route, length[hi] - length[lo], hi - lo, worst, chain[lo], chain[hi]))
        ids = {r[0] for r in runs}
        total, squares = sum(r[1] for r in runs), sum(r[1] * r[1] for r in runs)
        hhi = 1.0 if not runs else 1.0 / len(ids) if not total else squares / float(total * total)
        known = sorted(r for r in ids if r >= 0)
        passed = sum(flags) if crossroads_only else max(count, 0)
        worst = max((r[3] for r in runs), default=BEST_PRIORITY)
        runs = [dict(zip(_RUN, r)) for r in runs]
        return runs, total, hhi, known, worst, passed, max(count, 0), len(known)


_RUN = "route_id", "length", "hops", "priority", "start_place", "end_place"
#: A chain with its record, and the shortest its trip could be in a row of its own.
_ROW = pa.schema(
    [
        ("cid", pa.string()), ("stops", pa.list_(pa.int64())),
        ("runs", pa.list_(pa.struct([(n, pa.int32() if n in ("hops", "priority") else pa.int64()) for n in _RUN]))),
        ("length", pa.int64()), ("hhi", pa.float64()), ("route_ids", pa.list_(pa.int64())), ("priority", pa.int32()),
        ("crossroad_hops", pa.int64()), ("total_hops", pa.int32()), ("route_count", pa.int32()), ("c_min", pa.int64()),
    ]
)
_TYPES = (
    f"cid string, stops array<bigint>, runs {RUNS_TYPE}, length bigint, hhi double, route_ids array<bigint>, priority int, "
    "crossroad_hops bigint, total_hops int, route_count int, c_min bigint"
)
SCORED = ["qid", *_ROW.names[:-1]]


def _edge(x, y) -> tuple:
    return (x, y) if x is None or y is None or x <= y else (y, x)


class Trip:
    """One trip's searches, forwards (0) and backwards (1)."""

    def __init__(self, area: Area, trip: dict, ban: int):
        self.area, self.ban = area, ban
        self.banned = frozenset(trip["banned"] or ())
        self.ends = [(trip["start_place"], trip["end_place"]), (trip["end_place"], trip["start_place"])]
        self.paid: dict[tuple, dict[int, tuple]] = {}
        self.far: dict[int, dict[int, int]] = {}
        self.rest: dict[tuple, dict[int, int]] = {}

    def _paid(self, route: int, hop_weight: int, step: int, tier: int | None, deltas: dict) -> tuple[list, list]:
        _, _, hops, edges = self.area.lines[route]
        into = [hop * hop_weight for hop in hops]
        to, sofar = [], 0
        for cost, stretch in zip(into, edges):
            sofar += cost
            if stretch is not None:
                edge, prio = stretch
                sofar += step + deltas.get(edge, 0)
                if tier is not None and prio > tier:
                    sofar += self.ban
                if self.banned and (edge[0] in self.banned or edge[1] in self.banned):
                    sofar += self.ban
            to.append(sofar)
        return to, into

    def _rest(self, way: int, transfer: int, slack: int) -> dict[int, int]:
        """What is left to pay at least. Any edge may be free of charge, so rides alone count."""
        if (way, transfer, slack) not in self.rest:
            if way not in self.far:
                self.far[way] = self.area.rides(self.ends[way][1])
            self.rest[way, transfer, slack] = {
                p: max(transfer * n - slack, min(n, 1) * transfer) for p, n in self.far[way].items()
            }
        return self.rest[way, transfer, slack]

    def search(
        self, way: int, deltas: dict | None = None, *, transfer=T, hop_weight=1, step=0, slack=0, tier=None, most=float("inf")
    ) -> dict:
        src, dst = self.ends[way]
        if src not in self.area.at or dst not in self.area.at:
            return {}
        common = self.paid.setdefault((hop_weight, step, tier), {})
        own = {r: self._paid(r, hop_weight, step, tier, deltas) for e in deltas for r in self.area.taken.get(e, ())} if deltas else {}

        def paid(route: int) -> tuple[list, list]:
            known = own.get(route) or common.get(route)
            if known is None:
                known = common[route] = self._paid(route, hop_weight, step, tier, {})
            return known

        return self.area.settle(src, dst, transfer, slack, most, self._rest(way, transfer, slack), paid)

    def answer(self, way: int, labels: dict) -> tuple | None:
        src, dst = self.ends[way]
        return self.area.chain(src, labels[dst][1]) if dst in labels else None

    def relevant(self, labels: list[dict], way: int) -> set[int]:
        """:func:`pool.relevant_arteries`."""
        src, dst = self.ends[way]
        if dst not in labels[way]:
            return set()
        hop = self.area.hop
        most = labels[way][dst][0]
        leave = {p: c + (T if p == src else 0) for p, (c, _) in labels[way].items()}
        arrive = {p: 0 if p == dst else c + hop[dst] - hop[p] - T for p, (c, _) in labels[1 - way].items()}
        kept = set()
        for route, (places, *_) in zip(self.area.ids, self.area.lines):
            f = min([leave[p] for p in places if p in leave], default=None)
            g = min([arrive[p] for p in places if p in arrive], default=None)
            if f is not None and g is not None and f + g <= most:
                kept.add(route)
        return kept

    def favouring(self, *routes: int) -> dict:
        """H2: the edges of the favoured arteries are not charged."""
        deltas: dict = {}
        for route in routes:
            for edge in self.area.edges[route]:
                deltas[edge] = deltas.get(edge, 0) - T
        return deltas


def pool_of(trip: Trip, qid: str, worst: int, routes: int, totals: dict[int, int], diversity: int) -> list[tuple]:
    """:func:`pool.generate` of one trip: ``(cid, stops)``. ``worst``, ``routes`` and ``totals``, the arteries of
    each floor, are those of the whole network."""
    rows: list[tuple[int, str, tuple]] = []
    area, ways, tiers = trip.area, (0, 1), range(worst)

    def add(way: int, kind: str, chain: tuple | None) -> None:
        if chain is not None:
            rows.append((way, f"{qid}|{way}|{kind}", chain))

    def cost(way: int, found: dict) -> float:
        """What an answer costs: at most as much if edges become cheaper."""
        dst = trip.ends[way][1]
        return found[dst][0] if dst in found else float("inf")

    direct = [trip.search(w) for w in ways]
    plain = [trip.answer(w, direct[w]) for w in ways]
    labels = [trip.search(w, step=T, slack=T, most=cost(w, direct[w]) + T * (len(plain[w] or ()) - 1)) for w in ways]
    generic = [trip.answer(w, labels[w]) for w in ways]
    kept = [trip.relevant(labels, w) for w in ways]
    for w in ways:
        add(w, "plain", plain[w])
        # A chain that is not charged for its ratings is the cheapest of its tier as well, under its first name.
        for t in range((area.forced(plain[w]) or 0) if plain[w] else 0):
            if t < worst:
                add(w, f"tier{t}", trip.answer(w, trip.search(w, tier=t)))
        if len(kept[w]) < routes:
            add(w, "generic", generic[w])

    rode: dict[tuple[int, int], tuple] = {}
    for w in ways:
        for route in kept[w]:
            chain = trip.answer(w, trip.search(w, trip.favouring(route), step=T, most=cost(w, labels[w])))
            if chain is not None:
                rode[w, route] = chain
                add(w, f"ride|{route}", chain)
    if worst:
        # H7: see pool._floored.
        tiered: dict[int, list[dict]] = {}
        for w in ways:
            forced = area.forced(generic[w]) if generic[w] else None
            again = set()
            for (way, route), chain in rode.items():
                if way == w and route in area.floor and (area.forced(chain) or 0) > area.floor[route]:
                    again.add(route)
            # Only floors that a chain crosses are asked for.
            crossed = {t for t in tiers if t < (forced or 0)} | {area.floor[r] for r in again}
            for t in sorted(crossed - tiered.keys()):
                tiered[t] = [trip.search(x, step=T, slack=T, tier=t) for x in ways]
            near = {r for t in crossed for r in trip.relevant(tiered[t], w) if area.floor.get(r) == t}
            chosen = again & near
            shared = {area.floor[r] for r in again - near}
            if forced is not None:
                chosen |= {r for r in near - kept[w] if forced > area.floor[r]}
                close = near | {r for r in kept[w] if r in area.floor}
                for floor in range(forced):
                    if totals.get(floor, 0) > sum(area.floor[r] == floor for r in close):
                        shared.add(floor)
            for floor in shared:
                if floor < worst:
                    add(w, f"generic{floor}", trip.answer(w, tiered[floor][w]))
            for route in chosen:
                floor = area.floor[route]
                found = trip.search(w, trip.favouring(route), step=T, tier=floor, most=cost(w, tiered[floor][w]))
                add(w, f"floor|{route}", trip.answer(w, found))

    for w in ways:
        found, last, spent = direct[w], plain[w], {}
        for number in range(2, diversity + 1):
            if last is None:
                break
            for edge in {_edge(x, y) for x, y in zip(last, last[1:])}:
                spent[edge] = spent.get(edge, 0) + T
            found = trip.search(w, spent, most=cost(w, found) + T * (len(last) - 1))
            last = trip.answer(w, found)
            add(w, f"again{number}", last)
    return once(rows)


def once(rows: list[tuple[int, str, tuple]]) -> list[tuple]:
    """:func:`pool.dedup`."""
    first: dict[tuple, tuple] = {}
    for way, sid, chain in rows:
        if len(chain) >= 2:
            facing = chain[::-1] if way else chain
            first[facing] = min(first.get(facing, (way, sid)), (way, sid))
    return [(sid, chain) for chain, (_, sid) in first.items()]


def _least(trip: Trip, crossroads_only: bool) -> int:
    """:func:`search.point_distance` of a trip's two ends."""
    src, dst = trip.ends[0]
    labels = trip.search(0, transfer=0, hop_weight=int(crossroads_only), step=int(not crossroads_only))
    if dst not in labels:
        return 0
    return max(labels[dst][0] + (trip.area.hop[src] if crossroads_only else 0), 0)


def _table(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)


def _lists(column: pa.ListArray) -> Callable[[int], list[tuple]]:
    """The structs of a row of ``column`` as tuples, each field decoded once."""
    ends, values = column.offsets.to_pylist(), column.values
    fields = [values.field(i).to_pylist() for i in range(values.type.num_fields)]
    return lambda i: list(zip(*(f[ends[i] : ends[i + 1]] for f in fields)))


def _over(work: Callable[[Area, dict], Iterator[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = area = None
        for batch in batches:
            trips = batch.column("trips")
            shape = pa.schema([trips.type.value_type.field("qid"), *_ROW])
            areas, stops, marks = batch.column("area").to_pylist(), _lists(batch.column("rail")), _lists(batch.column("rated"))
            rows: list[tuple] = []
            for i, asked in enumerate(trips):
                if areas[i] != known:
                    known, area = areas[i], Area(stops(i), marks(i))
                for trip in asked.as_py():
                    rows += work(area, trip)
                    if len(rows) >= ROWS:
                        yield _table(rows, shape)
                        rows = []
            yield _table(rows, shape)

    return run


def _each(trips: DataFrame, more: list[str], rail: DataFrame, marks: DataFrame, work) -> DataFrame:
    """``work`` over the trips ``(qid, area, ...)`` of each component, beside its stops and marks."""
    own = rail.join(trips.select("area").distinct(), "area", "left_semi")
    stop = F.struct("route_id", F.col("pos").cast("int").alias("pos"), "place", "hop", "a", "b", "prio")
    packed = own.groupBy("area").agg(F.collect_list(stop.cast(_STOP)).alias("rail"))
    mark = F.struct("route_id", "start_place", "end_place", "priority").cast(_MARK)
    routes = own.select("route_id", "area").distinct()
    rated = marks.join(routes, "route_id").groupBy("area").agg(F.collect_list(mark).alias("rated"))
    packed = packed.join(rated, "area", "left").withColumn("rated", F.coalesce("rated", F.expr(f"cast(array() as array<{_MARK}>)")))
    tasks = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = (
        trips.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(SPREAD)))
        .groupBy("area", "part")
        .agg(F.collect_list(F.struct("qid", *_TRIP, *more)).alias("trips"))
    )
    # Few bytes, much work: spread over as many tasks as a shuffle has, not by size.
    beside = asked.join(packed, "area").repartition(tasks, "area", "part").sortWithinPartitions("area")
    kind = dict(trips.dtypes)["qid"]
    return beside.select("area", "trips", "rail", "rated").mapInArrow(_over(work), f"qid {kind}, {_TYPES}")


def generate_within(
    trips: DataFrame, rail: DataFrame, marks: DataFrame, ban: int, worst: int, routes: int, totals: dict[int, int],
    diversity: int, crossroads_only: bool,
) -> DataFrame:
    """Candidates of trips ``(qid, area, start_place, end_place, banned)`` with their records (``SCORED``), and a row
    without ``cid`` for each trip, with ``c_min``, the shortest a way could be."""

    def work(area: Area, asked: dict) -> Iterator[tuple]:
        qid = asked["qid"]
        yield qid, *[None] * (len(_ROW) - 1), _least(Trip(area, asked | {"banned": ()}, 0), crossroads_only)
        for cid, stops in pool_of(Trip(area, asked, ban), qid, worst, routes, totals, diversity):
            yield qid, cid, stops, *area.score(stops, crossroads_only), None

    return _each(trips, [], rail, marks, work)


def pairs_within(trips: DataFrame, rail: DataFrame, marks: DataFrame, ban: int, crossroads_only: bool) -> DataFrame:
    """H12 of trips that also have ``pairs``, arteries ``(r1, r2)`` to favour together: ``SCORED``."""

    def work(area: Area, asked: dict) -> Iterator[tuple]:
        trip, qid = Trip(area, asked, ban), asked["qid"]
        rows = []
        for pair in asked["pairs"]:
            one, two = pair["r1"], pair["r2"]
            for w in (0, 1):
                chain = trip.answer(w, trip.search(w, trip.favouring(one, two), step=2 * T))
                if chain is not None:
                    rows.append((w, f"{qid}|{w}|pair|{one}+{two}", chain))
        for cid, stops in once(rows):
            yield qid, cid, stops, *area.score(stops, crossroads_only), None

    return _each(trips, ["pairs"], rail, marks, work).select(*SCORED)
