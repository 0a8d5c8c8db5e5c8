"""Column expressions over edges and chains of stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BEST_PRIORITY = 0
WORST_PRIORITY = 3
CROSSROAD_DEGREE = 3
TRANSFER_WEIGHT = 1_000_000
LENGTH_EXPONENT = 0.5
ALTERNATIVE_FLOOR = 0.65
MAX_OVERLAP = 0.85
MAX_STRETCH = 2.5
WAYPOINT_MAX_STRETCH = 1.5
MAX_OPTIMIZED_WAYPOINTS = 7
MAX_LEG_COMBINATIONS = 2000
PAIR_SEED_ARTERIES = 3
DIVERSITY_ROUNDS = 6
TOP_N = 3
CONFIRMED_GAP = 2
LAZY_GAP = 8
CONFIRMED_MIN_ROUTES = 2
DERIVATION_VERSION = 2
HUB_COUNT = 5


def edge_ends(a, b) -> list[Column]:
    """The two ends of an undirected edge in key order, named ``a`` and ``b``."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def is_crossroad_expr(degree: str) -> Column:
    """1 for a real intersection, 0 for a transparent place."""
    return (F.col(degree) >= CROSSROAD_DEGREE).cast("int")


def hop_pairs(stops: Column) -> Column:
    """Consecutive pairs of a chain as ordered edge keys, one per hop."""
    return F.when(
        F.size(stops) < 2,
        F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(stops) - 1, F.lit(1))),
            lambda i: F.struct(
                F.least(F.element_at(stops, i), F.element_at(stops, i + 1)).alias("a"),
                F.greatest(F.element_at(stops, i), F.element_at(stops, i + 1)).alias("b"),
            ),
        )
    )


def path_edges(stops: Column) -> Column:
    """The edge set of a chain, sorted, each edge once."""
    return F.array_sort(F.array_distinct(hop_pairs(stops)))


def canonical(stops: Column) -> Column:
    """The smaller of a chain and its reverse: one reading per corridor."""
    return F.least(stops, F.reverse(stops))


def chain_text(stops: Column) -> Column:
    """A chain as text, stops joined by ``>``."""
    return F.array_join(F.transform(stops, lambda s: s.cast("string")), ">")


def overlap(own: Column, other: Column) -> Column:
    """The share of ``own`` edges that ``other`` also rides."""
    return F.size(F.array_intersect(own, other)) / F.size(own)
