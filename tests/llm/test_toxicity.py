import zlib

from waymesh.llm import toxicity as tx


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, toxic int, score string")


def corpus():
    rows, marks = [], []
    for i in range(120):
        bad = i % 3 == 0
        rows.append((i, f"some words about topic {i % 7} and " + ("you idiot you scumbag" if bad else "a kind friend who left the class")))
        marks.append((i, int(bad)))
    return rows, marks


def test_folds_disguises():
    fold = tx.Folded()
    plain = fold.words("idiot stupid clown")
    assert fold.words("1d10t $tup1d c1own") [:1] == plain[:1]
    assert fold.words("іdіоt stupіd ｃlown") == plain
    assert fold.words("id​iot ѕtuріd CL0WN!!") == plain
    assert fold.words("in 2024 only 15%") == ["in", "2024", "oniy", "15"]


def test_learns_and_spares_phrases(spark, docs_of):
    rows, marks = corpus()
    lexicon = tx.fit(*tx.sample(docs_of(rows).select("doc_id", "text"), labels_of(spark, marks)))
    assert any("idiot".startswith(s) for s in lexicon.stems)
    machine = tx.Lexicon({"trash": 3.0}, list(tx.EXCEPTIONS)).automaton()
    fold = tx.Folded()
    assert len(tx.hits_of(fold.words("such trash, the trash can"), machine)) == 1


def test_odd_rows(spark, docs_of):
    rows, marks = corpus()
    odd = [(900, None), (901, ""), (None, "you 1d1ot you scumbag"), (902, "you іdiot scumbag"), (902, "a kind friend"), (903, "friend " * 80000)]
    got = tx.predict_toxicity(docs_of(rows + odd), labels_of(spark, marks + [(902, None), (None, 1)])).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {(r.doc_id, r.predicted) for r in got} >= {(900, 0), (901, 0), (None, 1), (902, 1), (902, 0), (903, 0)}


def test_nothing_to_learn_from(spark, docs_of):
    assert tx.predict_toxicity(docs_of([]), labels_of(spark, [])).count() == 0
    got = tx.predict_toxicity(docs_of([(1, "idiot")]), labels_of(spark, [(1, 1)])).collect()
    assert [r.predicted for r in got] == [0]


def test_held_out_accuracy(spark):
    here = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{here}/labels.parquet").collect()}
    got = tx.predict_toxicity(spark.read.parquet(f"{here}/documents.parquet"), spark.read.parquet(f"{here}/labels.parquet")).collect()
    mine = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in mine) / len(mine) > 0.97
