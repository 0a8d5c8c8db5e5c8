import re
import time
import zlib

import pytest
from pyspark.sql import types as T

from waymesh.llm import langid

LANG = {"lang": T.StringType()}


def test_backs_off_to_shorter_grams(docs_of):
    rows = [(i, "the house and the garden", "en") for i in range(8)] + [(20 + i, "das haus und der garten", "de") for i in range(8)]
    model = langid.fit(docs_of(rows, **LANG))
    assert model.languages == ["de", "en"]
    assert "the" in model.words and "häuser" not in model.words
    rows = langid.WordRows(model)
    assert rows.score("The garden")[0] == "en"
    assert rows.score("hausgarten gartenhaus")[0] == "de"
    assert model.backed_off("жж")[0] == pytest.approx(model.vectors[model.grams["_"]][0] * 2)


def test_odd_texts(docs_of):
    learn = [(i, "the house and the garden", "en") for i in range(8)] + [(20 + i, "das haus und der garten", "de") for i in range(8)]
    odd = [(104, "½ ² ① Ⅷ", None), (100, None, "en"), (101, "", "en"), (102, "12 34 !!", None), (None, "the house", "en"), (103, "the " * 90000, None), (103, "das haus", None)]
    got = [tuple(r) for r in langid.predict_languages(docs_of(learn + odd, **LANG)).collect()]
    assert len(got) == len(learn) + len(odd)
    by = {(r[0], r[2]) for r in got}
    assert {(104, "und"), (100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "en"), (103, "de")} <= by
    assert all(0 <= r[3] <= 1 for r in got)
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)


def test_nothing_to_learn_from(docs_of):
    assert langid.predict_languages(docs_of([], **LANG)).count() == 0
    got = langid.predict_languages(docs_of([(1, "the house", None)], **LANG)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.predict_languages(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.98


def test_words_are_runs_of_letters_at_the_cost_of_a_plain_expression():
    plain = re.compile(r"[^\W\d_]+")
    odd = "".join(map(chr, range(0x3000))) + " a½b Ⅷx ①②y z³ \U00010107q 中〇文"
    own = re.compile(rf"[^\W\d_{langid.NUMBER_SIGNS}]+")
    assert langid.words_of(odd) == own.findall(odd.lower())

    def least(work):
        seconds = []
        for _ in range(7):
            start = time.process_time()
            work()
            seconds.append(time.process_time() - start)
        return min(seconds)

    long = "das Haus über dem Garten, шум und 25 Wörter. " * 4000
    assert least(lambda: langid.words_of(long)) < 3 * least(lambda: plain.findall(long.lower()))
