"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import warc
from waymesh.llm.conversation import repair_conversations
from waymesh.llm.decontaminate import find_leaks
from waymesh.llm.fingerprint import fingerprint_edits
from waymesh.llm.html_extract import extract_pages
from waymesh.llm.langid import predict_languages
from waymesh.llm.merkle import manifest
from waymesh.llm.near_dedup import near_duplicates
from waymesh.llm.ngram_join import ngram_join
from waymesh.llm.packing import pack_documents
from waymesh.llm.secret_scan import scan_secrets
from waymesh.llm.sharding import assign_shards
from waymesh.llm.toxicity import predict_toxicity
from waymesh.llm.twins import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_minimax_shards(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark, sf_dir):
    return predict_languages(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark, sf_dir):
    return predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


#: All pairs of n-gram sets that share one, counted exactly; classes by reaching along links.
SQL["op9_ngram_jaccard_join"] = r"""WITH RECURSIVE
split AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
described AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [chr(10) || text] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM split),
keyed AS (SELECT doc_id, md5(array_to_string(list_sort(grams), chr(10))) AS k, grams FROM described),
sets AS (SELECT k, any_value(grams) AS grams, count(*) AS n_copies, min(doc_id) AS first FROM keyed GROUP BY 1),
held AS (SELECT k, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT x.k AS a, y.k AS b, count(*) AS common, any_value(x.n) AS n, any_value(y.n) AS m FROM held x JOIN held y ON x.gram = y.gram AND x.k < y.k GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE common >= 0.8 * (n + m - common) - 1e-9),
facing AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(k, first) AS (SELECT k, first FROM sets UNION SELECT f.b, r.first FROM reach r JOIN facing f ON f.a = r.k),
roots AS (SELECT k, min(first) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a AS k, count(*) AS n FROM facing GROUP BY 1)
SELECT doc_id, class_id, doc_id = class_id AS is_kept, coalesce(c.n, 0) AS n_links, n_copies
FROM keyed JOIN sets USING (k) JOIN roots USING (k) LEFT JOIN counts c USING (k)"""


@query
def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_quartile_digest(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op2_site_style_tree(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op3_warc_derivatives(spark, sf_dir):
    responses = warc.responses_of_pages(table(spark, sf_dir, "pages"))
    return warc.derive(responses).drop("record")


@query
def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


@query
def op12_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
