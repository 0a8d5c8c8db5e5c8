"""Self-join of documents on the Jaccard similarity of their word n-grams, by MinHash banding.

1. Documents with the same set of n-grams become one class; what follows works on classes.
2. Each class gets ``bands x rows`` minima. Rows are as many as a budget of hashes allows while
   a pair at the threshold still meets in some band with the target recall.
3. Classes that share a band hash meet in a bucket. Inside a bucket their minima are compared
   (eight bits of each) and a spanning forest of the pairs that may be similar is kept, so what
   leaves a bucket is linear in its size.
4. Connected buckets form clusters. Only now are the n-gram sets built, for clustered classes
   alone, and sent to their cluster once; there all pairs are verified on the full sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import id_and_text, map_rows, sift, sorted_groups
from waymesh.operators.insights import components as reach
from waymesh.session import cut, retire

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
HASHES = 192
#: Deviations of the estimate that a pair may fall short of the threshold and still be verified.
SLACK = 5.0
#: Classes of a bucket or cluster that one task compares with as many others.
BLOCK = 1024
#: N-grams of the classes in a block, about: 16 MB of hashes, and some eight times that while a pair is compared.
BLOCK_GRAMS = 1 << 21
#: Columns of the incidence matrix held at a time.
STRIP = 4096
REMEMBERED = 500_000

WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The most rows a band can have while ``hashes`` still reach ``recall`` at ``threshold``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def least_estimate(threshold: float, hashes: int, slack: float = SLACK) -> float:
    """The share of equal minima below which a pair isn't similar, but for ``slack`` deviations."""
    return threshold - slack * math.sqrt(threshold * (1 - threshold) / hashes)


class WordHashes(dict):
    """Words -> 64-bit hashes."""

    def __missing__(self, word: str) -> int:
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_words = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def gram_sequence(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the word n-grams of ``text`` in order; none if it has no words.

    Words are runs of letters and digits, in lower case. Fewer words than ``words`` make one
    n-gram.
    """
    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(found))
    value = np.zeros(len(found) - size + 1, dtype=np.uint64)
    for k in range(size):
        value = value * _MULTIPLIER + hashes[k : len(found) - size + 1 + k]
    return mixed(value + np.uint64(size))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct n-grams; a text without words is one of its own, equal to no other text."""
    values = gram_sequence(text, words)
    if not len(values):
        return mixed(np.array([_words.__missing__("\n" + (text or ""))], dtype=np.uint64))
    return np.unique(values)


class MinHash:
    """Minima of a set under ``bands * rows`` multiplications modulo 2^32."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 32, size=(bands * rows, 1), dtype=np.uint32) | np.uint32(1)
        self.lift = rng.integers(1, 1 << 32, size=(bands * rows, 1), dtype=np.uint32)
        self.weight = rng.integers(0, 1 << 63, size=(1, rows), dtype=np.uint64) | np.uint64(1)

    def minima(self, values: np.ndarray) -> np.ndarray:
        low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
        out = None
        for at in range(0, len(values), 512):  # what is held stays in the processor's cache
            part = (low[at : at + 512] * self.odd) ^ (high[at : at + 512] * self.lift)
            least = part.min(axis=1)
            out = least if out is None else np.minimum(out, least)
        return out

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        table = minima.reshape(self.bands, self.rows).astype(np.uint64)
        return mixed((table * self.weight).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def set_key(values: np.ndarray) -> bytes:
    """What stands for a set of n-grams: 128 bits of its contents."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, minhash: MinHash, words: int) -> DataFrame:
    """``doc_id, text_hash, key, n_grams, bands, low``: class key, size of the set, band hashes, low bits of the minima."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for text in batch["text"]:
                values = shingles(text, words)
                minima = minhash.minima(values)
                rows.append((set_key(values), len(values), minhash.band_hashes(minima), minima.astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["key", "n_grams", "bands", "low"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy(dtype=object))
            out.insert(1, "text_hash", batch["text_hash"].to_numpy())
            return out

        return work

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_rows(hashed, make, "doc_id long, text_hash long, key binary, n_grams long, bands array<long>, low binary")


@dataclass
class Forest:
    """Union of numbers, each set named by its smallest."""

    parent: np.ndarray

    def top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self, names: np.ndarray) -> list[tuple]:
        """Every member but the first of each set, with the first."""
        tops = [self.top(i) for i in range(len(names))]
        return [(names[i], names[t]) for i, t in enumerate(tops) if i != t]


def dealt_in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows of a group, each to every pair of blocks it belongs to: ``pair`` keys and ``side``.

    A group of a ``size`` of at most ``block`` is one pair. A larger one is split by a hash of ``key``
    into blocks, and each two of them meet in a task of their own.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("key"), n).cast("int")
    return (
        rows.withColumn("_n", n)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn(
            "pair",
            F.concat_ws(":", F.hex(F.col(group)), F.least("_own", "_other").cast("string"), F.greatest("_own", "_other").cast("string")),
        )
        .withColumnRenamed("_own", "side")
        .drop("_n", "_other", size)
    )


def cluster_sizes(members: DataFrame, block: int, block_grams: int) -> DataFrame:
    """``root, size`` of the clusters in ``members(root, n_grams)``: classes, or more if their sets need more blocks."""
    counted = members.groupBy("root").agg(F.count("*").alias("classes"), F.sum("n_grams").alias("grams"))
    return counted.select("root", F.greatest(F.col("classes"), F.ceil(F.col("grams") * F.lit(block / block_grams))).alias("size"))


def near_in_bucket(least: float):
    """Spanning stars of the pairs of a bucket whose minima agree often enough."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("key")
        if len(rows) < 2:
            return None
        names = rows["key"].to_numpy()
        order = np.argsort([bytes(k) for k in names], kind="stable")
        names = names[order]
        low = np.frombuffer(b"".join(rows["low"].to_numpy()[order]), dtype=np.uint8).reshape(len(names), -1)
        forest = Forest(np.arange(len(names)))
        waiting = np.arange(len(names))
        while len(waiting) > 1:  # from one class to all it may link, until nobody is left
            first, waiting = waiting[0], waiting[1:]
            near = (low[waiting] == low[first]).mean(axis=1) >= least
            for other in waiting[near]:
                forest.join(int(first), int(other))
        return pd.DataFrame(forest.stars(names), columns=["a", "b"])

    return work


def linked_in_cluster(threshold: float):
    """Links of every class to the others of its cluster, verified on full sets.

    Gives a row for each class with its number of links, and spanning stars of the links.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("key")
        names = rows["key"].to_numpy()
        order = np.argsort([bytes(k) for k in names], kind="stable")
        names, sides = names[order], rows["side"].to_numpy()[order]
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["grams"].to_numpy()[order]]
        n = len(sets)
        if n < 2:
            return None
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), sizes)
        values = np.concatenate(sets)
        by_value = np.argsort(values, kind="stable")
        values, owner = values[by_value], owner[by_value]
        column = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
        shared = np.bincount(column)[column] > 1  # an n-gram of one class alone adds to no pair
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        both = np.zeros((n, n), dtype=np.float32)
        starts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + STRIP, STRIP))
        for s, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if lo < hi:
                part = np.zeros((n, min(STRIP, int(column[hi - 1]) - s * STRIP + 1)), dtype=np.float32)
                part[owner[lo:hi], column[lo:hi] - s * STRIP] = 1
                both += part @ part.T
        union = sizes[:, None] + sizes[None, :] - both
        linked = both >= (threshold - 1e-9) * union
        np.fill_diagonal(linked, False)
        if len(set(sides)) > 1:  # two blocks: pairs inside one are another task's
            linked &= sides[:, None] != sides[None, :]
        first = np.full(n, -1)
        for i in range(n):  # breadth first from every class not reached yet
            if first[i] < 0:
                front = np.array([i])
                while len(front):
                    first[front] = i
                    front = np.flatnonzero(linked[front].any(axis=0) & (first < 0))
        counts = linked.sum(axis=1)
        out = [(names[i], names[first[i]], int(counts[i])) for i in range(n) if counts[i]]
        return pd.DataFrame(out, columns=["a", "b", "n"]) if out else None

    return work


def components(edges: DataFrame) -> DataFrame:
    """``key, root``: the smallest key of everything linked to a key by ``edges(a, b)``.

    Minima are taken before rows are dealt by key, so the key of a large cluster, which all its
    links meet in, costs a row a task.
    """
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return reach(ends, edges).select(F.col("node").alias("key"), F.col("component").alias("root"))


def ngram_join(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
    block: int = BLOCK,
    block_grams: int = BLOCK_GRAMS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, is_kept, n_links, n_copies``.

    ``class_id`` is the smallest doc_id of the documents joined to one another by links, which
    are pairs with a Jaccard similarity of at least ``threshold``; ``is_kept`` marks one row
    of the class, that with this id. ``n_links`` counts the other n-gram sets a document is linked
    to, ``n_copies`` the rows with its own set. A null text counts as an empty one; texts
    without words are linked only to equal texts. Of repeated rows, all carry the mark. A null
    id is taken as smaller than any. An empty table gives no rows; further columns are ignored.
    """
    return ngram_rows(docs, words, threshold, recall, hashes, block, block_grams, id_col, text_col).drop("text_hash", "root")


def ngram_rows(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
    block: int = BLOCK,
    block_grams: int = BLOCK_GRAMS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """:func:`ngram_join` with ``text_hash``, which tells rows of one id apart, and the class's own key ``root``."""
    minhash = MinHash(*bands_and_rows(threshold, recall, hashes))
    texts = id_and_text(docs, id_col, text_col)
    described = cut(describe(texts, minhash, words), "minima")
    sets = cut(
        described.groupBy("key").agg(
            F.min("doc_id").alias("first"),
            F.count("*").alias("n_copies"),
            F.count(F.when(F.col("doc_id").isNull(), 1)).alias("no_id"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
            F.first("low").alias("low"),
        ),
        "sets",
    )

    in_band = sets.select("key", F.explode("bands").alias("band"))
    crowded = in_band.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = in_band.join(crowded, "band").join(sets.select("key", "low"), "key")
    buckets = dealt_in_blocks(members, "band", "size", block).select("pair", "side", "key", "low")
    near = sorted_groups(buckets, "pair", near_in_bucket(least_estimate(threshold, hashes)), "a binary, b binary")
    clusters = cut(components(cut(near.distinct(), "near")), "clusters")

    members = clusters.join(sets.select("key", "first", "no_id", "n_grams"), "key")
    chosen = members.join(cluster_sizes(members, block, block_grams), "root")
    wanted = chosen.select("key", "root", "size", F.when(F.col("no_id") == 0, F.col("first")).alias("doc_id"))
    wanted = cut(wanted, "wanted")

    def build():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            found = [shingles(t, words) for t in batch["text"]]
            return pd.DataFrame({"key": [set_key(v) for v in found], "grams": [v.tobytes() for v in found]})

        return work

    asked = wanted.select(F.col("doc_id").alias("_id"))
    sources = sift(texts, asked).where("_hit").join(asked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    full = map_rows(sources.select("text"), build, "key binary, grams binary")
    pairs = dealt_in_blocks(full.join(wanted.select("key", "root", "size"), "key"), "root", "size", block)
    linked = sorted_groups(
        pairs.select("pair", "side", "key", "grams"), "pair", linked_in_cluster(threshold), "a binary, b binary, n int"
    )
    linked = cut(linked, "linked")
    counts = linked.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    classes = components(linked.select("a", "b"))
    retire(wanted)

    known = sets.select("key", "first", "no_id", "n_copies").join(classes, "key", "left").join(counts, "key", "left")
    known = cut(known.withColumn("root", F.coalesce("root", "key")), "known")
    heads = known.groupBy("root").agg(F.min("first").alias("least"), F.max("no_id").alias("no_id"))
    ids = known.drop("first", "no_id").join(heads.select("root", F.when(F.col("no_id") == 0, F.col("least")).alias("class_id")), "root")
    return described.select("doc_id", "text_hash", "key").join(ids, "key").select(
        "text_hash",
        "root",
        "doc_id",
        "class_id",
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept"),
        F.coalesce(F.col("n_links"), F.lit(0)).cast("long").alias("n_links"),
        "n_copies",
    )
