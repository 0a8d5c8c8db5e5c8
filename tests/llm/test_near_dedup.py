"""Near duplicates against all pairs."""

import itertools
import random

import numpy as np
import pytest

from waymesh.llm import near_dedup as nd


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows, percent=85):
    """Components over rows by comparing every two of them."""
    sets = [plain_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[top(j)] = top(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if top(k) == top(i) and d is not None] if sets[i] else [doc_id]
        least = min(ids, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def text(rng, n=60):
    return [f"{rng.choice('abcdefghij')}{rng.randint(0, 400)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return words


@pytest.fixture
def found(docs_of):
    def run(rows, **more):
        return sorted((tuple(r) for r in nd.near_duplicates(docs_of(rows), **more).collect()), key=repr)

    return run


def test_equals_all_pairs(found):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(25):
        base = text(rng, rng.choice([8, 40, 200]))
        for edits in (0, 0, 1, 2, 3, 5, 9):
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(edited(rng, base, edits)).title()))
            i += 1
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "é É"), (5007, "é é"), (5008, "a b")]
    rows += [(None, rows[0][1]), (3, "shared id"), (3, "shared id"), (None, "no id"), (None, "no id"), (9000, "word " * 100_000)]
    assert found(rows) == plain(rows)
    assert found([]) == []


def test_chains_and_groups_larger_than_a_block(found):
    """Chains of texts each linked only to the next, and groups near the threshold, many blocks each."""
    rng = random.Random(9)
    rows, i = [], 0
    for length in (3, 12, 30):
        words = text(rng, 80)
        for _ in range(length):
            rows.append((i, " ".join(words)))
            words = edited(rng, words, 2)
            i += 1
    base = text(rng, 120)
    rows += [(i + k, " ".join(edited(rng, base, 2 + k % 4))) for k in range(120)]
    assert found(rows, block=8) == plain(rows)
    assert found(rows, block_shingles=300) == plain(rows)
    assert found(rows, block_signatures=8, block=8) == plain(rows)


def test_links_between_roots_of_one_size(docs_of):
    """Two components of two texts each, linked by one pair alone, whole and in blocks."""
    rng = random.Random(3)
    words, rows = text(rng, 80), []
    for i in range(4):
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 2)
    signatures = nd.Signatures(85)
    texts = nd.id_and_text(docs_of(rows), "doc_id", "text")
    sets = nd.described_sets(texts, 3, signatures).withColumn("id", nd.F.col("doc_id")).withColumnRenamed("doc_id", "first")
    for root in ("if(id < 2, 0, 2)", "if(id < 3, 0, 3)", "if(id < 1, 0, 3)"):
        rooted = sets.select(nd.F.lit(1).alias("bucket"), "id", nd.F.expr(f"cast({root} as long)").alias("root"))
        for block in (1, 2, 8):
            links = nd.links_left(rooted, sets, texts, signatures, 85, 3, block, 1 << 20, block)
            assert len(links.collect()) == 1, (root, block)


def test_every_pair_within_the_distance_shares_a_key():
    signatures = nd.Signatures(85)
    rng = np.random.default_rng(1)
    table = rng.integers(0, 1 << 16, size=(400, signatures.places), dtype=np.uint16)
    other = table.copy()
    for row in other:
        at = rng.permutation(signatures.places)[: rng.integers(0, signatures.distance + 1)]
        row[at] ^= 1
    keys = [signatures.keys([r.tobytes() for r in t]) for t in (table, other)]
    assert all(set(a) & set(b) for a, b in zip(*keys, strict=True))
    apart = signatures.keys([rng.integers(0, 1 << 16, signatures.places, dtype=np.uint16).tobytes() for _ in range(400)])
    assert not any(set(a) & set(b) for a, b in zip(keys[0], apart, strict=True))


def test_small_sets_that_cannot_be_linked():
    n = nd.smallest_linked()
    assert n == 6 and 100 * n >= 85 * (n + 1) and 100 * (n - 1) < 85 * n


def test_shingles_of_long_and_odd_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["a", " A  b\tC\n", "é É é", "x" * 5000 + " y", " \x0b\x0c ", "a\u00a0b c", *(" ".join(rng.choices("abcdefgh ij", k=300)) for _ in range(20))]
    whole = [nd.shingle_set(t) for t in texts]
    assert [len(v) for v in whole] == [len(plain_set(t)) for t in texts]
    monkeypatch.setattr(nd, "PART_BYTES", 7)
    assert all(np.array_equal(nd.shingle_set(t), v) for t, v in zip(texts, whole, strict=True))
    assert len(np.unique(np.concatenate(whole))) == len(set().union(*map(plain_set, texts)))
