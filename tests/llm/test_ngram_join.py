import random
from itertools import combinations

import numpy as np

from waymesh.llm import ngram_join as nj


def brute(texts, threshold=0.8):
    """Links of every row's set and the class of every row, all pairs compared."""
    sets = [frozenset(nj.shingles(t).tolist()) for t in texts]
    distinct = sorted(set(sets), key=sets.index)
    links = {s: 0 for s in distinct}
    root = {s: s for s in distinct}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(distinct, 2):
        if len(a) * threshold <= len(b) / threshold and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    return [links[s] for s in sets], [top(s) for s in sets], [sets.count(s) for s in sets]


def agree(rows, ids, texts):
    links, classes, copies = brute(texts)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) == len(by)
    least = {}
    for i, c in zip(ids, classes):
        least[c] = min(i, least.get(c, i))
    for i, n, c, k in zip(ids, links, classes, copies):
        assert (by[i].n_links, by[i].class_id, by[i].n_copies) == (n, least[c], k), i
        assert by[i].is_kept == (least[c] == i)


def family(rng, size, copies, edits, vocabulary=4000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
    for _ in range(copies):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
        yield " ".join(own)


def mixed_texts():
    rng = random.Random(11)
    texts = []
    for size, copies, edits in ((80, 30, 1), (120, 12, 2), (300, 8, 7), (60, 10, 3), (6, 3, 0), (4, 2, 0), (400, 6, 9)):
        texts += family(rng, size, copies, edits)
    shared = " ".join(f"s{k}" for k in range(55))
    texts += [shared + " " + next(family(rng, rng.choice([5, 20, 60, 200]), 1, 0)) for _ in range(60)]
    texts += ["", "!!", "??", "", "one", "one", "One!", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    return texts


def test_all_pairs_and_blocks(spark, docs_of):
    texts = mixed_texts()
    docs = docs_of(list(enumerate(texts)))
    agree(nj.ngram_join(docs).collect(), range(len(texts)), texts)
    small = [r for r in nj.ngram_join(docs, block=7).collect()]  # buckets and clusters split into blocks
    agree(small, range(len(texts)), texts)


def test_odd_rows(docs_of):
    got = nj.ngram_join(docs_of([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "A, b. c"), (5, "long " * 70000)])).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[2].class_id == 1 and by[2].n_copies == 2
    assert by[3].class_id is None and by[None].is_kept and by[3].n_copies == 3 and not by[3].is_kept
    assert by[5].is_kept and by[5].n_links == 0
    assert nj.ngram_join(docs_of([])).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall, hashes in ((0.8, 0.9999, 192), (0.5, 0.99, 128), (0.9, 0.999, 64)):
        bands, rows = nj.bands_and_rows(threshold, recall, hashes)
        assert bands * rows <= hashes and 1 - (1 - threshold**rows) ** bands >= recall


def test_minima_estimate_the_similarity():
    minhash = nj.MinHash(*nj.bands_and_rows())
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.9):
        errors = []
        for _ in range(30):
            both = nj.mixed(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
            n = int(400 * (1 - share) / (2 * share))
            a, b = (np.concatenate([both, nj.mixed(rng.integers(0, 1 << 62, n, dtype=np.uint64))]) for _ in range(2))
            true = 400 / (400 + 2 * n)
            errors.append((minhash.minima(a) == minhash.minima(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    agree(nj.ngram_join(docs).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_blocks_are_bounded_by_their_sets(spark, docs_of):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k:]) for k in range(0, 400, 10)]
    agree(nj.ngram_join(docs_of(list(enumerate(texts))), block_grams=3000).collect(), range(len(texts)), texts)
    members = spark.createDataFrame([(f"k{i}", "r", 400) for i in range(40)], "key string, root string, n_grams long")
    sized = members.join(nj.cluster_sizes(members, nj.BLOCK, 3000), "root")
    pairs = nj.dealt_in_blocks(sized, "root", "size", nj.BLOCK).groupBy("pair").agg(nj.F.sum("n_grams").alias("n"))
    assert 1 < pairs.count() and pairs.agg(nj.F.max("n")).first()[0] < 40 * 400 * 0.75
