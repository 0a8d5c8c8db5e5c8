"""The place dimension (D4-D12): ``registry(place_id, name, group)``, unique by group and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions import text as tx
from waymesh.operators.numbering import number_rows
from waymesh.operators.tree import KEY


def with_display(registry: DataFrame) -> DataFrame:
    """The registry with its display names."""
    return registry.select("*", tx.format_place(F.col("name"), F.col("group")).alias("display"))


def duplicates(registry: DataFrame) -> DataFrame:
    """Pairs of group and name held by more than one id; empty for a sound registry."""
    return registry.groupBy("group", "name").agg(F.count("*").alias("ids")).where("ids > 1")


def resolve(names: DataFrame, registry: DataFrame, column: str = "text") -> DataFrame:
    """``names`` with ``place_id``, null for a place nobody knows. Never mints."""
    keyed = names.withColumn("group", tx.classify(F.col(column))).withColumn("name", tx.base_name(F.col(column)))
    return keyed.join(registry.select("place_id", "group", "name"), ["group", "name"], "left").drop("group", "name")


def mint(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with an id for every name of the trees, new ones numbered in order
    of first mention: a node's own stops before those of its branches."""
    named = nodes.select(*KEY, F.posexplode("places").alias("pos", "text")).select(
        *KEY, "pos", tx.classify(F.col("text")).alias("group"), tx.base_name(F.col("text")).alias("name")
    )
    first = named.groupBy("group", "name").agg(F.min(F.struct("route_idx", "node_path", "pos")).alias("seen"))
    fresh = first.join(registry.select("group", "name"), ["group", "name"], "left_anti")
    top = registry.agg(F.coalesce(F.max("place_id"), F.lit(0)).alias("top")).first()["top"]
    numbered = number_rows(fresh, ["seen"], "place_id", int(top) + 1)
    return registry.select("place_id", "name", "group").unionByName(numbered.select("place_id", "name", "group"))


def to_ids(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Trees with ids for names, marks untouched. Only distinct names are looked up."""
    stops = nodes.select(*KEY, F.posexplode("places").alias("pos", "text"))
    known = resolve(stops.select("text").distinct(), registry)
    ids = (
        stops.join(known, "text")
        .groupBy(*KEY)
        .agg(F.expr("transform(array_sort(collect_list(struct(pos, place_id))), e -> e.place_id)").alias("places"))
    )
    none = F.expr("cast(array() as array<bigint>)")
    return nodes.drop("places").join(ids, KEY, "left").select(
        *KEY, F.coalesce("places", none).alias("places"), "marks", "priority"
    )


def to_display(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Trees with display names for ids."""
    return translate(nodes, registry, KEY, "places").select(*KEY, "places", "marks", "priority")


def translate(rows: DataFrame, registry: DataFrame, key: list[str], column: str) -> DataFrame:
    """The ids of an array column as display names, in place; an id without a name stays
    as its number, and a row without ids keeps its empty list."""
    shown = with_display(registry).select(F.col("place_id").alias("_id"), "display")
    names = (
        rows.select(*key, F.posexplode(column).alias("_pos", "_id"))
        .join(shown, "_id", "left")
        .withColumn("display", F.coalesce("display", F.col("_id").cast("string")))
        .groupBy(*key)
        .agg(F.expr("transform(array_sort(collect_list(struct(_pos, display))), e -> e.display)").alias(column))
    )
    none = F.expr("cast(array() as array<string>)")
    return rows.drop(column).join(names, key, "left").withColumn(column, F.coalesce(column, none))


def migration_counts(names: DataFrame) -> DataFrame:
    """Places per group a first migration of ``names(text)`` would create."""
    return names.select("text").distinct().groupBy(tx.classify(F.col("text")).alias("group")).agg(
        F.count("*").alias("places")
    )


def reclassify(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default-group entries whose name now shows a known prefix move to that group;
    one that would collide with another id stays. Returns the registry and the skipped."""
    wrong = registry.where(F.col("group") == tx.DEFAULT_GROUP).select(
        "place_id",
        F.col("name").alias("old_name"),
        tx.parsed_group(F.col("name")).alias("group"),
        tx.parsed_base(F.col("name")).alias("name"),
    ).where("group is not null")
    taken = registry.select("group", "name", F.col("place_id").alias("existing"))
    checked = wrong.join(taken, ["group", "name"], "left")
    skipped = checked.where("existing is not null and existing <> place_id").select(
        "place_id", "old_name", "group", "name", "existing"
    )
    moved = checked.where("existing is null or existing = place_id").select(
        "place_id", F.col("name").alias("new_name"), F.col("group").alias("new_group")
    )
    out = registry.join(moved, "place_id", "left").select(
        "place_id",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("new_group", "group").alias("group"),
    )
    return out, skipped


def group_counts(names: DataFrame) -> DataFrame:
    """Places per group in the vocabulary's order, empty groups left out."""
    counted = names.groupBy(tx.classify(F.col("text")).alias("key")).agg(F.count("*").alias("places"))
    return (
        tx.groups_table(names.sparkSession)
        .join(counted, "key")
        .select("ord", "key", "label", "places")
        .orderBy("ord")
    )


def filter_options(names: DataFrame) -> DataFrame:
    """Pickable names with their search keywords."""
    return names.select("text", tx.keywords(F.col("text")).alias("keywords"))
