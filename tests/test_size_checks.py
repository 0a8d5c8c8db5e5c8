"""What Spark is told of sizes, and plans that must not read the same partitions in several branches."""

import pathlib

from pyspark.sql import functions as F

from waymesh.operators import names
from waymesh.plans import catalog
from waymesh.session import COMPRESSION, TASK_BYTES, cut, sized_as_rows


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_written_tables_are_not_taken_for_their_compressed_size(spark):
    path_rows = spark.range(200_000).select(F.col("id").cast("int"), F.array(F.lit("a place"), F.lit("another")).alias("places"))
    table = cut(path_rows, "sized")
    on_disk = sum(p.stat().st_size for p in pathlib.Path(table._waymesh_path.removeprefix("file:")).rglob("*.parquet"))
    assert optimized(table).stats().sizeInBytes() > 8 * on_disk


def test_a_factor_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.sources.fileCompressionFactor", "3.0")
    assert sized_as_rows(own).conf.get("spark.sql.sources.fileCompressionFactor") == "3.0"
    own.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
    assert sized_as_rows(own).conf.get("spark.sql.sources.fileCompressionFactor") == COMPRESSION


def test_returns_are_walked_without_a_union(spark):
    plan = optimized(catalog.QUERIES["f5_marked_edges_of_returns"](spark, "/root/testdata/sf0.001")).toString()
    assert plan.count("Union") == 1  # that of marked_edges itself


def test_the_index_of_a_name_search_is_never_broadcast(spark):
    options = cut(spark.createDataFrame([(1, "Old Mill Road 7"), (2, "New Bridge 12")], "ord long, option string"), "options")
    queries = spark.createDataFrame([("a", "mill"), ("b", "'")], "qid string, query string")
    for search in (names.strict_filter, names.fuzzy_filter):
        plan = search(options, queries)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [gram" in plan and "BroadcastHashJoin [gram" not in plan


def test_tasks_are_given_few_shuffled_bytes_unless_the_session_says_otherwise(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = spark.newSession()
    own.conf.set(name, "3m")
    assert sized_as_rows(own).conf.get(name) == "3m"
    assert spark.conf.get(name) == TASK_BYTES
