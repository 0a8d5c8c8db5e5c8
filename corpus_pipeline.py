"""Corpus cleaning, stage by stage, on the documents table.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``;
the last packs what is left and returns its pieces. Columns other than ``doc_id``, ``text``,
``lang`` and ``n_chars`` pass through. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import decontaminate, langid, secret_scan
from waymesh.llm.common import bounded_batches, id_and_text, keep_rows, sift, text_function
from waymesh.llm.ngram_join import ngram_rows
from waymesh.llm.packing import pack_documents
from waymesh.session import cut

#: A document whose likeliest language has a smaller share is rejected, as is one without letters.
LEAST_SHARE = 0.4
REDACTED = "[secret]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told. The model is fitted on the rows' own ``lang``.

    Null and empty texts, and texts without a letter, have none and go. Where no row has a
    ``lang`` there is nothing to tell languages by, so no document is judged: all stay.
    """
    model = langid.fit(id_and_text(docs, "doc_id", "text", "lang"))
    if not model.languages:
        return docs
    shared = spark.sparkContext.broadcast(model)

    def make():
        rows = langid.WordRows(shared.value)

        def told(text: str | None) -> bool:
            lang, share = rows.score(text)
            return lang != langid.UNDETERMINED and share >= LEAST_SHARE

        return told

    return keep_rows(docs, make)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of every group of near duplicates, one row: that with the smallest id.

    A null id is taken as smaller than any. Rows are told apart by id and text, so rows that
    share an id, or have none, are each judged by their own group.
    """
    rows = ngram_rows(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "root")
    pairs = cut(rows.groupBy("_id", "_text", "root").agg(F.count("*").alias("_rows")), "pairs")
    heads = pairs.groupBy("root").agg(F.min(F.struct("_id", "_text")).alias("head")).select(F.col("head._id").alias("id"), F.col("head._text").alias("text"))
    judged = pairs.join(heads, pairs["_id"].eqNullSafe(heads["id"]) & (pairs["_text"] == heads["text"]), "left")
    kept = F.col("text").isNotNull()
    # Rows that go, or that are equal to others in id and text.
    special = judged.where(~kept | (F.col("_rows") > 1)).select(F.xxhash64("_id", "_text").alias("_row"), "_id", "_text", kept.alias("_kept"))
    special = cut(special, "special")
    text_hash = F.xxhash64(docs["text"].cast("string"))
    marked = docs.withColumn("_hash", text_hash).withColumn("_row", F.xxhash64(docs["doc_id"].cast("long"), text_hash))
    sifted = sift(marked, special, "_row")
    plain = sifted.where("not _hit").select(docs.columns)
    same = sifted["doc_id"].eqNullSafe(special["_id"]) & (sifted["_hash"] == special["_text"])
    known = sifted.where("_hit").join(special.drop("_row"), same, "left").select(*docs.columns, "_kept")
    left = plain.unionByName(known.where("_kept is null").drop("_kept"))
    if special.where("_kept").isEmpty():
        return left
    return left.unionByName(known.where("_kept").drop("_kept").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaking(docs, items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with each secret replaced and ``n_chars`` counted anew where it changed."""

    def make():
        machine = secret_scan.keyword_automaton()

        def changed(text: str | None) -> str | None:
            clean = secret_scan.redact(text, machine, REDACTED)
            return None if clean == text else clean

        return changed

    bounded_batches(spark)
    clean = text_function(make, "string")(docs["text"])
    again = docs.withColumn("_clean", clean)
    out = {"text": F.coalesce("_clean", "text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.col("_clean").isNull(), F.col("n_chars")).otherwise(F.length("_clean").cast(kind))
    return again.select(*[out[c].alias(c) if c in out else again[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of what is left, with its sequence and place there."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: No stage can be written as SQL: learnt models, MinHash, automata and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
