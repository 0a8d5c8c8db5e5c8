import random
import zlib
from collections import defaultdict

from waymesh.llm import sharding as sh


def greedy(sizes, capacity):
    bins, room = 0, 0
    for size in sizes:
        if size > capacity:
            return len(sizes) + 1
        if bins == 0 or size > room:
            bins, room = bins + 1, capacity
        room -= size
    return bins


def brute_capacity(sizes, shards):
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    return next(c for c in sums if greedy(sizes, c) <= shards)


def test_least_capacity_against_all_sums(spark, monkeypatch):
    monkeypatch.setattr(sh, "BLOCKS", 8)  # several rounds of splitting
    rng = random.Random(3)
    for shards, count in ((3, 40), (5, 60)):
        keys = sorted(rng.sample(range(sh.KEY_END), count - 4) + [7, 8, 9, 10])
        sizes = [rng.choice([1, 2, 3, 50, 400]) for _ in keys]
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
        capacity, cuts = sh.minimax_cuts(groups, shards)
        assert capacity == brute_capacity(sizes, shards)
        sums = defaultdict(int)
        for k, s in zip(keys, sizes):
            sums[sum(k >= c for c in cuts)] += s
        assert len(sums) <= shards and max(sums.values()) == capacity


def check(rows, texts, shards):
    by = defaultdict(list)
    home = {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        assert home.setdefault(text, r.shard) == r.shard
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sh.assign_shards(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 16)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    mean = sum(sums.values()) / 16
    assert len(sums) == 16 and max(sums.values()) < 1.2 * mean and min(sums.values()) > 0.75 * mean


def test_odd_rows_and_a_hot_group(docs_of):
    texts = {i: "x" * 50 for i in range(40)} | {100: None, 101: "", 102: "é" * 9} | {200 + i: f"t{i}" * 3 for i in range(60)}
    rows = sh.assign_shards(docs_of(list(texts.items())), 4).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 4)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    assert sums[0] == 40 * 51 and max(sums[i] for i in (1, 2, 3)) - min(sums[i] for i in (1, 2, 3)) < 25
    twice = sh.assign_shards(docs_of([(1, "a"), (1, "a"), (None, "b"), (None, "b")]), 2).collect()
    assert sorted((r.shard, r.slot) for r in twice) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_empty_table(docs_of):
    assert sh.assign_shards(docs_of([])).count() == 0


def test_hot_groups_keep_the_windows_few(spark):
    """Single groups of 1, 3 and 6 per cent of the bytes, alone and together."""
    rng = random.Random(8)
    for shares in ((0.01,), (0.03,), (0.06, 0.03, 0.01, 0.05)):
        keys = sorted(rng.sample(range(sh.KEY_END), 9000))
        sizes = [rng.randint(1, 3000) for _ in keys]
        whole = sum(sizes)
        for share, i in zip(shares, rng.sample(range(9000), len(shares)), strict=True):
            sizes[i] = int(share * whole)
        groups = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key long, size long")
        windows = []
        capacity, cuts = sh.minimax_cuts(groups, 16, windows.append)
        low, high = -(-sum(sizes) // 16), sum(sizes)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if greedy(sizes, middle) <= 16 else (middle + 1, high)
        assert capacity == low and max(windows) <= sh.BLOCKS and len(windows) <= 3
        sums = defaultdict(int)
        for k, s in zip(keys, sizes, strict=True):
            sums[sum(k >= c for c in cuts)] += s
        assert len(sums) == 16 and max(sums.values()) <= capacity
        assert min(sums.values()) > 0.9 * sum(sizes) / 16 or len(shares) > 1
