"""Numbering rows in a global order without sending them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import cut


def number_rows(df: DataFrame, order: list[str], name: str, start: int | Column = 0) -> DataFrame:
    """``df`` with ``name``: each row's place in the order of ``order``, from ``start``.

    Rows are range-partitioned and written once; then each partition counts its own rows
    and adds the counts of the partitions before it. Only one row per partition is summed
    in one place.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_local") - 1 + F.col("_offset") + start).cast("long"))
        .drop("_part", "_local", "_offset")
    )
