"""From typed names to shown results in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions import text as tx
from waymesh.functions.chains import MAX_STRETCH, TOP_N, WAYPOINT_MAX_STRETCH
from waymesh.operators import legs, registry as rg, report, validate
from waymesh.operators.pool import Prepared, candidate_pool
from waymesh.operators.select import closure_report
from waymesh.session import cut, together


def admitted(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests ``(qid, start, end, via)`` by id: ``(qid, status, start_place, end_place, via)``.

    Names are trimmed and blank required stops left out. ``status`` is ``error`` for a blank end,
    ``empty`` if any name is unknown, else ``ok``.
    """
    typed = requests.select("qid", F.posexplode("via").alias("pos", "raw"))
    typed = typed.select("qid", "pos", tx.strip(F.coalesce("raw", F.lit(""))).alias("text")).where("text <> ''")
    through = rg.resolve(typed, registry).groupBy("qid").agg(
        F.max(F.col("place_id").isNull()).alias("strange"),
        F.expr("transform(array_sort(collect_list(struct(pos, place_id))), e -> e.place_id)").alias("via"),
    )
    strange = (F.col("status") == "ok") & F.coalesce("strange", F.lit(False))
    return validate.admit(requests, registry).join(through, "qid", "left").select(
        "qid",
        F.when(strange, "empty").otherwise(F.col("status")).alias("status"),
        "start_place",
        "end_place",
        F.coalesce("via", F.expr("cast(array() as array<bigint>)")).alias("via"),
    )


def pools(asked: DataFrame, ready: Prepared, crossroads_only: bool = True, **search) -> tuple[DataFrame, DataFrame]:
    """The scored pools of admitted requests, direct ones and those with required stops."""
    trips = cut(legs.normalise_via(asked.where("status = 'ok'").drop("status")), "trips")
    return together(
        lambda: candidate_pool(trips.where(F.size("via") == 0).drop("via"), ready, crossroads_only, **search),
        lambda: legs.via_pool(trips.where(F.size("via") > 0), ready, crossroads_only, **search),
    )


def shown_results(
    asked: DataFrame, direct: DataFrame, through: DataFrame, corridors: DataFrame, registry: DataFrame,
    closed: DataFrame, k: int = TOP_N,
) -> DataFrame:
    """One row a request, ``(qid, status, paths, meta, compromisedDetour)``, by display name.

    Every pool is selected from twice: the routes shown avoid ``closed(place)``, and the detour
    names the closed places the best ``k`` routes would have used. Lists are empty where there is
    no way or no admitted request. ``corridors(route_id, pos, place)`` are the authored stops.
    """
    parts = [closure_report(legs.one_leg(direct), closed, k, MAX_STRETCH), closure_report(through, closed, k, WAYPOINT_MAX_STRETCH)]
    columns = ["qid", "slot", "stops", "q", "hhi", "priority", "route_count", "legs"]
    clean = cut(parts[0][0].select(columns).unionByName(parts[1][0].select(columns)), "clean")
    records = report.display_records(clean, corridors, registry, ["qid", "slot"])
    listed = records.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "path", "meta"))).alias("r"))
    listed = listed.select("qid", F.transform("r", lambda e: e["path"]).alias("paths"), F.transform("r", lambda e: e["meta"]).alias("meta"))
    names = rg.with_display(registry).select(F.col("place_id").alias("place"), "display")
    lost = parts[0][1].unionByName(parts[1][1]).join(names, "place", "left")
    lost = lost.groupBy("qid").agg(F.sort_array(F.collect_list(F.coalesce("display", F.col("place").cast("string")))).alias("lost"))
    kinds = dict(listed.dtypes)
    empty = lambda column, kind: F.coalesce(column, F.expr(f"cast(array() as {kind})")).alias(column)
    return asked.select("qid", "status").join(listed, "qid", "left").join(lost, "qid", "left").select(
        "qid",
        "status",
        empty("paths", kinds["paths"]),
        empty("meta", kinds["meta"]),
        F.coalesce("lost", F.expr("cast(array() as array<string>)")).alias("compromisedDetour"),
    )


def answer(
    requests: DataFrame, registry: DataFrame, ready: Prepared, corridors: DataFrame, closed: DataFrame, k: int = TOP_N, **search
) -> DataFrame:
    """Typed requests ``(qid, start, end, via)`` to shown results; ``search`` goes to :func:`pools`."""
    asked = cut(admitted(requests, registry), "asked")
    direct, through = pools(asked, ready, **search)
    return shown_results(asked, direct, through, corridors, registry, closed, k)
