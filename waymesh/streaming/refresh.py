"""Re-deriving the network when route documents arrive (A7 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymesh.operators import tree
from waymesh.sources.documents import Store, document_violations, nodes_of, unfold
from waymesh.session import cut

#: What orders the versions of a route: a stated version, then the file's time and name, then the place in it.
ORDER = ["version", "file_time", "file_name", "file_start", "line"]


def watch(spark: SparkSession, inbox: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Follow a folder of documents ``{"route_idx": n, "route": ...}``, one a line.

    Of several documents for a route the latest counts: by a whole number ``version`` if lines
    state one, then by the time of their file, then by their order. Every batch replaces the
    routes it names and derives the network again. A batch that is run twice leaves the same
    tables. Documents with violations are kept out and written below ``rejected`` with what is
    wrong; the sound ones of their batch go through.
    """
    lines = spark.readStream.schema("value string").text(inbox)
    docs = lines.where(F.trim("value") != "").select(
        F.get_json_object("value", "$.route_idx").try_cast("int").alias("route_idx"),
        F.get_json_object("value", "$.route").alias("doc"),
        F.coalesce(F.get_json_object("value", "$.version").try_cast("long"), F.lit(0)).alias("version"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("file_start"),
        F.col("value"),
    )
    return (
        docs.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def apply_batch(batch: DataFrame, number: int, store: Store) -> None:
    """One batch of documents into the store."""
    if batch.isEmpty():
        return
    numbered = cut(batch.withColumn("line", F.monotonically_increasing_id()), "batch")
    latest = cut(
        numbered.where("route_idx is not null and doc is not null")
        .groupBy("route_idx")
        .agg(F.max_by("doc", F.struct(*ORDER)).alias("doc")),
        "latest",
    )
    raw = unfold(latest)
    wrong = document_violations(raw)
    bad = wrong.select("route_idx").distinct()
    reasons = wrong.groupBy("route_idx").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    unread = numbered.where("route_idx is null or doc is null").select(
        "route_idx", F.col("value").alias("doc"), F.array(F.lit("no route number or no route")).alias("rules")
    )
    rejected = cut(latest.join(reasons, "route_idx").unionByName(unread), "rejected")
    if not rejected.isEmpty():
        rejected.write.mode("overwrite").parquet(store.path(f"rejected/batch={number}"))
    fresh = cut(tree.upgrade(nodes_of(raw.join(bad, "route_idx", "left_anti"))), "fresh")
    if fresh.isEmpty():
        return
    kept = store.load_routes().join(
        fresh.select("route_idx").distinct(), "route_idx", "left_anti"
    )
    left = store.save_routes(kept.unionByName(fresh))
    if not left.isEmpty():  # what was stored before is sound and so are the new ones: never expected
        raise ValueError(f"batch {number} breaks rules only together with stored routes")
