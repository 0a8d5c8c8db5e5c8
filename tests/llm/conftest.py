import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text, ...) rows, with extra columns whose names clash with inner ones."""

    def make(rows, **extra):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
            + [T.StructField(n, t) for n, t in extra.items()]
            + [T.StructField(n, T.StringType()) for n in ("size", "row", "score", "key", "spans", "shard", "words", "part")]
        )
        width = len(schema)
        return spark.createDataFrame([tuple(r) + ("x",) * (width - len(r)) for r in rows], schema)

    return make
