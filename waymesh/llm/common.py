"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of bounded rows and bytes, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``docs`` as ``(doc_id, text, ...)``: other columns, whatever their names, stay behind."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c] for c in more]
    )


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Like mapInPandas, but whole numbers stay whole where a column has nulls."""
    kinds = StructType.fromDDL(schema)
    out = to_arrow_schema(kinds)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.to_pandas(integer_object_nulls=True) for b in batches if b.num_rows)
        for frame in run(frames):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(convert, kinds)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``make()`` runs once in every task and gives the function that maps each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            yield work(batch)

    return map_frames(df, run, schema)


def text_function(make: Callable[[], Callable[[str | None], object]], kind: str):
    """A column function of a text. ``make()`` runs once in every task; only the text goes to
    Python and only the result comes back, the other columns stay where they are."""

    @F.pandas_udf(kind)
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = make()
        for texts in batches:
            yield pd.Series([work(t) for t in texts], dtype=object)

    return of_texts


def keep_rows(df: DataFrame, make: Callable[[], Callable[[str | None], bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text passes the test that ``make()`` gives."""
    bounded_batches(df.sparkSession)
    return df.where(text_function(make, "boolean")(df[text_col]))


#: Bits of a sieve: what is sent to every task has at most SIEVE_BITS / 64 rows of two numbers.
SIEVE_BITS = 1 << 24


def sift(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``_hit``: false for rows whose id is surely not in the first column of ``ids``.

    One bit for the hash of every id, in a table of bounded size whatever the number of ids.
    Rows that are hit have to be joined with ``ids`` to be sure; the others need no shuffle. With
    many more ids than bits every row is hit and the join sees them all.
    """
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
    bit = lambda column: F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    marks = ids.select(place(F.col(ids.columns[0])).alias("_place")).select(F.shiftright("_place", 6).alias("_word"), bit("_place").alias("_bit"))
    words = marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return (
        df.withColumn("_place", place(df[id_col]))
        .withColumn("_word", F.shiftright("_place", 6))
        .join(F.broadcast(words), "_word", "left")
        .withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(bit("_place")) != 0, F.lit(False)))
        .select(*[df[c] for c in df.columns], "_hit")
    )


def sorted_groups(
    df: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: tuple[str, ...] = ()
) -> DataFrame:
    """``work`` on the rows of every value of ``key``, many small groups to a task.

    Rows are dealt by key and sorted; a task holds one group at a time. Callers see to it
    that no group outgrows a task: what could is split before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        rows = 0

        def close():
            nonlocal rows
            if held:
                made = work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
                held.clear()
                if made is not None and len(made):
                    out.append(made)
                    rows += len(made)

        current = None
        for batch in batches:
            keys = batch[key].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for lo, hi in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                if current is None or keys[lo] != current:
                    close()
                    current = keys[lo]
                held.append(batch.iloc[lo:hi])
                if rows >= BATCH_ROWS:
                    yield pd.concat(out, ignore_index=True)
                    out.clear()
                    rows = 0
        close()
        if out:
            yield pd.concat(out, ignore_index=True)

    return map_frames(df.repartition(key).sortWithinPartitions(key, *order), run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
