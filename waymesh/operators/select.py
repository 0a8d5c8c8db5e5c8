"""Diverse selection from a scored pool.

The greedy walk becomes rounds over all trips: every round takes each trip's best
candidate that still qualifies and drops for good what fails against it. A rejected
candidate can never pass later, so the rounds give exactly the walk's answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.chains import ALTERNATIVE_FLOOR, MAX_OVERLAP, MAX_STRETCH, TOP_N, overlap
from waymesh.operators.pool import rank_struct
from waymesh.session import cut, retire


def length_baseline(pool: DataFrame, hard_tier: bool = True) -> DataFrame:
    """I4: stops of the best candidate of the unfiltered pool: ``(qid, best_stops)``."""
    front = [F.col("priority")] if hard_tier else []
    return pool.groupBy("qid").agg(
        F.min_by(F.size("stops"), F.struct(rank_struct(*front).alias("k"), F.col("cid"))).alias("best_stops")
    )


def excluding(pool: DataFrame, closed: DataFrame) -> DataFrame:
    """Candidates that touch none of ``closed(place)``. An anti-join, so the closed
    set may be of any size."""
    hit = (
        pool.select("qid", "cid", F.explode("stops").alias("place"))
        .join(closed.select("place").distinct(), "place", "left_semi")
        .select("qid", "cid")
        .distinct()
    )
    return pool.join(hit, ["qid", "cid"], "left_anti")


def select_diverse(
    pool: DataFrame,
    k: int | None = None,
    max_stretch: float = MAX_STRETCH,
    max_overlap: float = MAX_OVERLAP,
    hard_tier: bool = True,
    closed: DataFrame | None = None,
) -> DataFrame:
    """Up to ``k`` diverse candidates per trip, with ``slot`` from 0; all with ``k`` None.

    With ``hard_tier`` each slot opens its arena one tier further, at least to the slot's
    own number and past the tier just taken; if nothing qualifies inside, to the cheapest
    tier in which something does. The best candidate is therefore the smallest by
    (tier or arena, whichever is worse; rank).
    """
    keep = pool.columns
    base = length_baseline(pool, hard_tier)
    rest = pool if closed is None else excluding(pool, closed)
    rest = (
        rest.join(base, "qid")
        .where(F.size("stops") <= F.col("best_stops") * F.lit(float(max_stretch)))
        .select(
            "qid", "cid", "edges", "q", "priority", F.struct(rank_struct().alias("r"), F.col("cid")).alias("rk")
        )
        .withColumn("arena", F.lit(0))
        .withColumn("lead_q", F.lit(None).cast("double"))
    )
    rest = cut(rest, "rest")
    slots: list[DataFrame] = []
    while k is None or len(slots) < k:
        tier = F.greatest("priority", "arena") if hard_tier else F.lit(0)
        best = (
            rest.groupBy("qid")
            .agg(F.min_by(F.struct("cid", "edges", "q", "priority"), F.struct(tier.alias("t"), F.col("rk"))).alias("w"))
            .select(
                "qid",
                F.col("w.cid").alias("w_cid"),
                F.col("w.edges").alias("w_edges"),
                F.col("w.q").alias("w_q"),
                F.col("w.priority").alias("w_priority"),
            )
        )
        best = cut(best, "slot")
        if best.isEmpty():
            break
        slots.append(best.select("qid", F.col("w_cid").alias("cid"), F.lit(len(slots)).alias("slot")))
        if k is not None and len(slots) == k:
            break
        left = (
            rest.join(best, "qid")
            .where("cid <> w_cid")
            .withColumn("lead_q", F.coalesce("lead_q", "w_q"))
            .where(F.col("q") >= F.lit(ALTERNATIVE_FLOOR) * F.col("lead_q"))
            .where(F.col("edges") != F.col("w_edges"))
            .where((F.size("edges") == 0) | (overlap(F.col("edges"), F.col("w_edges")) <= max_overlap))
            .withColumn("arena", F.greatest(F.lit(len(slots)), F.col("w_priority") + 1))
            .select("qid", "cid", "edges", "q", "priority", "rk", "arena", "lead_q")
        )
        left = cut(left, "rest")
        retire(rest)
        rest = left
    if not slots:
        return pool.limit(0).withColumn("slot", F.lit(0))
    chosen = slots[0]
    for more in slots[1:]:
        chosen = chosen.unionByName(more)
    return pool.join(chosen, ["qid", "cid"]).select(*keep, "slot")


def closure_report(
    pool: DataFrame, closed: DataFrame, top: int = TOP_N, max_stretch: float = MAX_STRETCH
) -> tuple[DataFrame, DataFrame]:
    """The best clean routes, and the closed places the natural ones would have used:
    ``(qid, place)``. The pool is scored once and selected from twice."""
    natural = select_diverse(pool, top, max_stretch)
    clean = cut(select_diverse(pool, top, max_stretch, closed=closed), "clean")
    detour = (
        natural.select("qid", F.explode("stops").alias("place"))
        .distinct()
        .join(closed.select("place").distinct(), "place", "left_semi")
        .join(clean.select("qid").distinct(), "qid", "left_semi")
        .select("qid", "place")
    )
    return clean, detour


def first_rows(rows: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows per key."""
    line = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(line)).where(F.col("n") <= limit).drop("n")
