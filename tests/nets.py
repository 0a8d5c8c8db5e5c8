"""Small named networks, place names mapped to numbers in order of first mention."""

from waymesh.operators import network as nw
from waymesh.operators.score import Network


class Net:
    def __init__(self, spark, routes, marks=()):
        self.spark = spark
        self.ids, self.names = {}, {}
        rows = []
        # Numbers follow the alphabet, so orders by name and by number agree.
        for name in sorted({p for r in routes for p in r.split()}):
            self.ids[name] = len(self.ids) + 1
            self.names[len(self.ids)] = name
        for rid, route in enumerate(routes):
            for pos, name in enumerate(route.split()):
                rows.append((rid, pos, self.ids[name]))
        stops = spark.createDataFrame(rows, "route_id long, pos int, place long")
        mark_rows = [(r, self.ids[s], self.ids[e], p) for r, s, e, p in marks]
        mark_df = spark.createDataFrame(
            mark_rows, "route_id long, start_place long, end_place long, priority int"
        )
        edges = nw.edges(stops)
        self.net = Network(stops, edges, nw.degrees(edges, nw.places_of(stops)), mark_df)

    def chain(self, text):
        return [self.ids[n] for n in text.split()]

    def text(self, stops):
        return " ".join(self.names[s] for s in stops)

    def chains(self, *texts):
        return self.spark.createDataFrame(
            [(i, self.chain(t)) for i, t in enumerate(texts)], "chain_id long, stops array<bigint>"
        )


SPEC = ["A B C D", "C M N G E R", "E J K L A"]
PARALLEL = ["S a1 a2 T", "S b1 b2 T", "S c1 c2 T", "S d1 d2 T"]
WAYPOINT = ["A B", "A C", "C B", "A Z X N K C", "A w1 w2", "w2 w3 w4", "w4 w5 w6", "w6 w7 w8", "w8 w9 C", "C P"]
THROUGH = ["S h1 J h2 T", "J V", "V c1 c2 T", "c1 zc1", "c2 zc2"]
TWO_STOP = ["S a1", "a1 W1", "S b1 W2 b2 W1", "W2 c1 T", "W1 d1 T", "a1 za", "b1 zb", "b2 zb2", "c1 zc", "d1 zd"]
START_ON_WAY = ["K n1 S m1 T", "K p1", "p1 p2", "p2 T", "n1 zn", "m1 zm", "p1 zp1", "p2 zp2"]
SPUR = ["S h1 J h2 T", "J W", "W x1", "x1 x2", "x2 T", "x1 s1", "x2 s2"]
CONC = ["x a1 a2 a3 a4 a5 y", "S x", "y T", "a1 p1", "a2 p2", "a3 p3", "S b1 m", "m b2 T", "b1 q1", "b2 q2", "a4 p4", "a5 p5"]
PRIORITY = ["S c1", "c1 c2", "c2 c3", "c3 T", "S q1 q2 q3 T", "c1 z1", "c2 z2", "c3 z3", "q1 z4", "q2 z5", "q3 z6"]
PAIR = ["S a1 a2 a3 a4 a5 M", "S p1 X", "X q1 M", "M t1 t2 t3 t4 t5 t6 t7 N", "N l1 E", "M y1", "y1 y2", "y2 y3", "y3 E"]
CONTAIN = ["A B C D E F G"]
TIER_RIDE = ["S u1 u2 u3 T", "S u1", "u1 u2", "u2 u3", "u3 T", "u1 z1", "u2 z2", "u3 z3"]
ROAD = ["H g1 g2 P n1 T", "Q P n1 T", "g1 z1", "g2 z2"]
EXCLUDE = ["S M T", "S N T", "M zm", "N zn"]
ARENA = ["S a1 a2 a3 T", "S q1 q2 q3 T", "S b1 b2", "b2 b3 T", "S c1 c2", "c2 c3 T"] + [
    f"{x}{i} z{x}{i}" for x in "aqbc" for i in (1, 2, 3)
]
LEG_ARENA = ["P p1 S", "S q1 q2 q3 T", "S b1 b2", "b2 b3 T", "p1 zp1"] + [f"{x}{i} z{x}{i}" for x in "qb" for i in (1, 2, 3)]
DETOUR = ["A B C D E F G", "B R G"]
TWO_ROUTES = ["X A B", "B C Y"]
SHORTCUT = ["A C", "A p q C", "A x", "C y"]
LINE = ["S P Q E"]

NAMED = {
    "spec": (SPEC, []),
    "parallel": (PARALLEL, []),
    "waypoint": (WAYPOINT, []),
    "through": (THROUGH, []),
    "two": (TWO_STOP, []),
    "onway": (START_ON_WAY, []),
    "spur": (SPUR, []),
    "conc": (CONC, []),
    "priority": (PRIORITY, [(4, "S", "T", 1)]),
    "pair": (PAIR, []),
    "road": (ROAD, [(0, "P", "T", 3)]),
    "arena": (ARENA, [(1, "S", "T", 1)]),
    "legarena": (LEG_ARENA, [(1, "S", "T", 2)]),
    "exclude": (EXCLUDE, []),
    "detour": (DETOUR, []),
    "tworoutes": (TWO_ROUTES, []),
    "shortcut": (SHORTCUT, []),
    "line": (LINE, []),
}


def atlas(spark):
    """All named networks side by side; a place is written ``network.place``."""
    routes, marks = [], []
    for name, (lines, rated) in NAMED.items():
        first = len(routes)
        routes += [" ".join(f"{name}.{p}" for p in line.split()) for line in lines]
        marks += [(first + r, f"{name}.{s}", f"{name}.{e}", p) for r, s, e, p in rated]
    return Net(spark, routes, marks)
