import random
import re
from collections import Counter

import numpy as np

from waymesh.llm import decontaminate as dc


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def brute(text, items, threshold=0.8):
    """Items similar to some window of their size."""
    own = re.findall(r"\w+", (text or "").lower())
    found = set()
    for item_id, item in items:
        theirs = re.findall(r"\w+", (item or "").lower())
        if not theirs:
            continue
        if len(theirs) < 5:
            if any(own[k : k + len(theirs)] == theirs for k in range(len(own))):
                found.add(item_id)
            continue
        bag = Counter(tuple(theirs[k : k + 5]) for k in range(len(theirs) - 4))
        width = min(len(theirs), len(own))
        for s in range(len(own) - width + 1):
            window = own[s : s + width]
            here = Counter(tuple(window[k : k + 5]) for k in range(len(window) - 4))
            both = (here & bag).total()
            if both and both >= threshold * (here.total() + bag.total() - both) - 1e-9:
                found.add(item_id)
                break
    return found


def cases():
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.choice([15, 16, 30, 45, 60])))) for i in range(40)]
    items += [(50, "only two"), (51, None), (52, "!!"), (53, items[0][1]), (54, "rep rep rep rep rep rep rep rep rep rep")]
    docs = []
    for i in range(150):
        body = words(rng, rng.choice([3, 20, 80, 400]))
        kind = i % 5
        if kind:
            leak = items[rng.randrange(40)][1].split()
            if kind == 2:
                leak[rng.randrange(len(leak))] = "changed"
            if kind == 3:
                del leak[rng.randrange(len(leak))]
            if kind == 4:
                leak = leak[: rng.randrange(5, len(leak) + 1)]
            at = rng.randrange(len(body) + 1)
            body[at:at] = leak
        docs.append((i, " ".join(body).capitalize() + "."))
    docs += [(200, None), (201, ""), (202, "Only two!"), (203, "here are only two more, only two"), (208, "only one two"), (None, items[3][1]), (204, items[5][1] + " " + items[5][1])]
    docs += [(205, "rep " * 5000), (206, " ".join(items[7][1].split()[:-1])), (207, items[8][1]), (207, items[8][1])]
    return docs, items


def test_like_brute_force(spark, docs_of):
    docs, items = cases()
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    want = {(d, i) for d, t in docs for i in brute(t, items)}
    assert len(want) > 50
    rows = dc.find_leaks(docs_of(docs), table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(0.8 - 1e-9 <= r.similarity <= 1 for r in rows)
    exact = {r.doc_id: r for r in rows if r.doc_id == 207}
    assert exact[207].start_word == 0 and exact[207].similarity == 1.0
    assert sum(r.doc_id == 207 for r in rows) == 2
    assert sorted((r.start_word, r.n_words) for r in rows if r.doc_id == 203) == [(2, 2), (5, 2)]
    parts = dc.find_leaks(docs_of(docs), table, part_items=9).collect()
    assert sorted(map(repr, parts)) == sorted(map(repr, rows))


def test_index_misses_nothing():
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    index = dc.SizeIndex.of(list(range(30)), prints, dc.RADIUS)
    windows = []
    for p in prints:
        for flips in range(0, 40):
            windows.append(p ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    windows = np.array(windows, dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in index.within(windows, dc.RADIUS))))
    want = {(w, i) for w, v in enumerate(windows.tolist()) for i, p in enumerate(prints) if (v ^ p).bit_count() <= dc.RADIUS}
    assert got == want


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(docs_of([]), none).count() == 0
    assert dc.find_leaks(docs_of([(1, "a b c d e f")]), none).count() == 0


def test_whole_table(spark):
    here = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{here}/documents.parquet"), spark.read.parquet(f"{here}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i in brute(r.text, items)}
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} == want and want
