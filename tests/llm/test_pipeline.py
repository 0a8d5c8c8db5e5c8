import random

from pyspark.sql import types as T

import corpus_pipeline as cp
from waymesh.llm import decontaminate, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = {"en": [f"the{k}ing" for k in range(300)], "de": [f"schu{k}keit" for k in range(300)]}

    def text(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "er", "s"]) for _ in range(n))

    docs = [(i, text("en" if i % 2 else "de", 120), "en" if i % 2 else "de") for i in range(60)]
    item = text("en", 40)
    docs += [(100, None, "en"), (101, "", None), (102, "12345 !!", "de")]
    docs += [(103, docs[0][1], "de"), (104, docs[1][1] + " more", "en"), (105, docs[2][1], "de"), (105, docs[2][1], "de"), (3, docs[3][1], "en")]
    docs += [(106, text("en", 50) + " " + item + " " + text("en", 50), "en")]
    docs += [(107, text("en", 30) + " password=hunter2hunter2 " + text("en", 30), "en")]
    write(spark, str(tmp_path), docs, [(1, item), (2, None)])

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = frame
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        frame = spark.read.parquet(f"{tmp_path}/out{k}")
        left[name] = before, frame
        if k < len(cp.STAGES) - 1:
            assert frame.columns == COLUMNS
    ids = {n: sorted(r.doc_id for r in f.select("doc_id").collect()) for n, (_, f) in left.items()}
    assert ids["language_id"] == sorted(d[0] for d in docs if d[0] not in (100, 101, 102))
    assert ids["ngram_jaccard_join"] == [*range(60), 106, 107]
    assert ids["benchmark_decontamination"] == [*range(60), 107]
    redacted = {r.doc_id: r for r in left["secret_scan"][1].collect()}
    assert "hunter2" not in redacted[107].text and cp.REDACTED in redacted[107].text
    assert redacted[107].n_chars == len(redacted[107].text)
    assert all(redacted[d[0]].text == d[1] for d in docs[:60])
    assert sorted(set(ids["best_fit_packing"])) == ids["secret_scan"]
    assert cp.run(spark, str(tmp_path)).count() == frame.count()


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_odd_rows(spark, tmp_path, docs_of):
    extra = {"lang": T.StringType(), "n_chars": T.LongType()}
    docs = docs_of([(1, "token=abcdef", "en", 12), (1, None, "en", None), (None, "some words here", "en", 1), (2, "", None, None)], **extra)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0


def test_rows_of_one_id_or_none_are_judged_by_their_own_group(spark, docs_of):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(4))
    docs = docs_of([(7, a), (7, b + " more"), (3, b), (None, c), (None, c + " more"), (None, c), (9, c + " again"), (None, d), (8, a), (8, a)])
    left = [(r.doc_id, r.text) for r in cp.keep_one_of_each_group(spark, docs, "").collect()]
    assert len(left) == 4 and {(7, a), (3, b), (None, d)} < set(left)
    assert [t for i, t in left if i is None and t != d][0] in (c, c + " more")


def test_overlapping_spans_go_as_one():
    machine = secret_scan.keyword_automaton()
    text = "x token=" + "0123456789abcdef" * 2 + " y"
    assert secret_scan.redact(text, machine, "#") == "x # y"
    assert secret_scan.redact(None, machine, "#") is None


def test_drops_what_is_found(spark, docs_of):
    item = " ".join(f"w{k}" for k in range(30))
    docs = docs_of([(1, f"a b {item} c"), (2, "a b c"), (3, None), (None, item)])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(docs, items).collect()) == [2, 3]
