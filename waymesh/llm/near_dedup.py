"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A signature has ``PLACES`` minima of ``b`` bits. Two sets at the threshold differ in more than
``distance`` places about once in a million; all pairs within ``distance`` are found for sure: the
places are split into chunks, so few that a pair within ``distance`` has, in some chunk, at most
one place in error (pigeonhole). Every chunk gives a key for each error allowed in it, that is with
each of its places left out, and such a pair shares one of these keys.

1. Equal sets are one class. Keys that two or more classes share make buckets.
2. The first class of every bucket is compared with the others: on signatures, then, if they are
   near enough, on full sets. What leaves this step is linear in the buckets' rows.
3. Most buckets now lie in one component of verified links and can add nothing. In the others, the
   signatures of classes in different components are compared. Components that may be linked form
   clusters, and of their classes those near to another component are compared on full sets: all
   outside the largest component with everything else, in blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import id_and_text, map_frames, map_rows, sift, sorted_groups
from waymesh.llm.ngram_join import Forest, MinHash, mixed, set_key
from waymesh.operators.insights import components
from waymesh.session import cut

WORDS = 3
#: Intersection and union are compared as 100 * intersection >= PERCENT * union.
PERCENT = 85
PLACES = 64
BITS = 16
#: The share of pairs just at the threshold that may lie beyond the distance.
MISSED = 1e-6
#: Errors of a chunk that are enumerated.
CHUNK_ERRORS = 1
#: Parts a bucket's or head's rows are dealt into.
SALTS = 256
#: Classes, and shingles of all of them together, in one block of a cluster.
BLOCK = 512
BLOCK_SHINGLES = 1 << 21
#: Signatures in one block of a bucket: 128 bytes each, so they need no bound by size.
BLOCK_SIGNATURES = 2048
#: Bytes of a text that are hashed at a time.
PART_BYTES = 1 << 20
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def distance_at(percent: int = PERCENT, places: int = PLACES, missed: float = MISSED) -> int:
    """The least distance that all but ``missed`` of the pairs at the threshold keep."""
    same, left = percent / 100, 1.0
    for distance in range(places):
        left -= math.comb(places, distance) * (1 - same) ** distance * same ** (places - distance)
        if left <= missed:
            return distance
    return places


def chunks_for(distance: int, places: int = PLACES) -> list[np.ndarray]:
    """Places split into so many chunks that ``distance`` errors can't put more than one in each."""
    return np.array_split(np.arange(places), min(places, distance // (CHUNK_ERRORS + 1) + 1))


def smallest_linked(percent: int = PERCENT) -> int:
    """The least shingles a set needs to be linked to a different one: a union of n + 1, all but one shared."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


_random = np.random.default_rng(12)
_BYTES = _random.integers(0, 1 << 63, size=256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_IS_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def powers(n: int) -> np.ndarray:
    """The multiplier's first ``n`` powers."""
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _MULTIPLIER)]))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every word of a lower-case text: its bytes' numbers, weighted by their places."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_IS_BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    sizes = edges[1::2] - edges[::2]
    if not len(sizes):
        return np.zeros(0, dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(starts[-1] + sizes[-1]) - np.repeat(starts, sizes)
    sums = np.add.reduceat(_BYTES[raw[inside]] * powers(int(sizes.max()))[place], starts)
    return mixed(sums + sizes.astype(np.uint64))


def parts_of(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end where a word does."""
    at = 0
    while at < len(data):
        end = BLANK.search(data, at + size)
        stop = end.start() if end else len(data)
        yield data[at:stop]
        at = stop


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``; empty if it has no word.

    Words are what blanks of ASCII leave, A-Z in lower case; fewer than ``words`` are one shingle.
    """
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    found = [word_hashes(part) for part in parts_of(data, PART_BYTES)]
    hashes = np.concatenate(found) if len(found) > 1 else found[0]
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    value = np.full(len(hashes) - size + 1, np.uint64(size))
    for k in range(size):
        value = value * _MULTIPLIER + hashes[k : len(hashes) - size + 1 + k]
    return np.unique(mixed(value))


class Signatures:
    """Signatures of sets and the keys they are looked up by."""

    def __init__(self, percent: int, places: int = PLACES):
        self.distance = distance_at(percent, places)
        self.chunks = chunks_for(self.distance, places)
        self.minhash = MinHash(places, 1)
        self.places = places

    def of(self, values: np.ndarray) -> bytes:
        return self.minhash.minima(values).astype(np.uint16).tobytes() if len(values) else b""

    def table(self, signatures) -> np.ndarray:
        return np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(-1, self.places)

    def keys(self, signatures) -> np.ndarray:
        """A key for each place left out of its chunk: rows by places."""
        table = self.table(signatures).astype(np.uint64)
        values = mixed(table + (np.arange(self.places, dtype=np.uint64) << np.uint64(BITS)))
        out = np.empty_like(values)
        for chunk in self.chunks:
            rest = values[:, chunk].sum(axis=1, dtype=np.uint64)[:, None] - values[:, chunk]
            out[:, chunk] = mixed(rest + chunk.astype(np.uint64))
        return out.view(np.int64)


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def described_sets(texts: DataFrame, words: int, signatures: Signatures) -> DataFrame:
    """``doc_id, key, n_shingles, signature`` of every row."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            found = [shingle_set(t, words) for t in batch["text"]]
            return pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "key": [set_key(v) for v in found],
                    "n_shingles": [len(v) for v in found],
                    "signature": [signatures.of(v) for v in found],
                }
            )

        return work

    return map_rows(texts, make, "doc_id long, key binary, n_shingles long, signature binary")


def keys_of(sets: DataFrame, signatures: Signatures) -> DataFrame:
    """``bucket, id``: all lookup keys of all classes."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            keys = signatures.keys(batch["signature"])
            return pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(batch["id"].to_numpy(dtype=np.int64), keys.shape[1])})

        return work

    return map_rows(sets.select("id", "signature"), make, "bucket long, id long")


def near_pairs(pairs: DataFrame, sets: DataFrame, signatures: Signatures) -> DataFrame:
    """``pairs(head, id)`` within the distance."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            apart = (signatures.table(batch["x"]) != signatures.table(batch["y"])).sum(axis=1)
            return batch.loc[apart <= signatures.distance, ["head", "id"]]

        return work

    own = sets.select("id", F.col("signature").alias("x"))
    other = sets.select(F.col("id").alias("head"), F.col("signature").alias("y"))
    return map_rows(pairs.join(own, "id").join(other, "head"), make, "head long, id long")


def with_sets(rows: DataFrame, sets: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``rows(id, ...)`` with the full ``shingles`` of each class, made again from one text of it.

    The sieve over ids lets few texts pass in vain; sets are dealt out once, by their key.
    """

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            found = [shingle_set(t, words) for t in batch["text"]]
            return pd.DataFrame({"key": [set_key(v) for v in found], "shingles": [v.tobytes() for v in found]})

        return work

    wanted = cut(rows.join(sets.select("id", "key", "first"), "id"), "wanted")
    passed = sift(texts, wanted.select("first").distinct()).where("_hit")
    made = map_rows(passed.select("text"), make, "key binary, shingles binary").dropDuplicates(["key"])
    return wanted.drop("first").join(made, "key").drop("key")


def verified_pairs(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs(head, id)`` that are linked on full sets; a head's rows pass one by one, in parts."""
    group = F.concat_ws(":", "head", "salt").alias("group")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    rows = salted.select(group, F.lit(1).alias("side"), "head", "id")
    heads = salted.select("head", "salt").distinct().select(group, F.lit(0).alias("side"), "head", F.col("head").alias("id"))
    rows = with_sets(rows.unionByName(heads), sets, texts, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for side, head, own, data in zip(batch["side"], batch["head"], batch["id"], batch["shingles"], strict=True):
                values = np.frombuffer(data, dtype=np.uint64)
                if side == 0:
                    held = values
                    continue
                at = np.minimum(np.searchsorted(held, values), len(held) - 1)
                if linked(int((held[at] == values).sum()), len(held), len(values), percent):
                    out.append((head, own))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return map_frames(rows.repartition("group").sortWithinPartitions("group", "side"), run, "a long, b long")


def joined_outside_largest(roots: np.ndarray, near) -> list[tuple[int, int]]:
    """Joins of different roots, until every row outside the largest component was compared with all.

    ``near(i)`` says which rows row ``i`` is joined to. The largest component is that of these rows, whichever root is
    the largest elsewhere: of two rows in different components one is always outside it.
    """
    names, tree = np.unique(roots, return_inverse=True)
    forest, made = Forest(np.arange(len(names))), []
    done = np.zeros(len(roots), dtype=bool)
    while True:
        tops = np.array([forest.top(int(t)) for t in range(len(names))])[tree]
        largest = np.bincount(tops).argmax()
        left = np.flatnonzero(~done & (tops != largest))
        if not len(left):
            return made
        i = left[0]
        done[i] = True
        for other in np.unique(tree[near(i) & (tops != tops[i])]):
            if forest.top(int(tree[i])) != forest.top(int(other)):
                forest.join(int(tree[i]), int(other))
                made.append((int(names[tree[i]]), int(names[other])))


def dealt(rows: DataFrame, group: str, largest: DataFrame, block: int, shingles: int) -> DataFrame:
    """``rows(group, id, root, n)`` so that each one outside its group's largest root meets every other.

    A group that fits one block stays whole. Of others, outsiders are split into blocks; each two of these meet, and each
    meets every block of the largest root's rows.
    """
    told = rows.join(largest, group).withColumn("outside", F.col("root") != F.col("main"))
    size = lambda which: F.ceil(
        F.greatest(F.count(F.when(which, 1)) / block, F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / shingles)
    ).cast("int")
    blocks = told.groupBy(group).agg(
        size(F.col("outside")).alias("_out"), size(~F.col("outside")).alias("_in"), (size(F.lit(True)) <= 1).alias("_whole")
    )
    told = told.join(blocks, group)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("_out")).otherwise(F.col("_in"))).cast("int")
    meets = F.when(F.col("_whole"), F.array(F.lit("w"))).when(
        F.col("outside"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("_out") - 1), lambda o: F.concat_ws(":", F.lit("o"), F.least("_own", o), F.greatest("_own", o))),
            F.when(F.col("_in") > 0, F.transform(F.sequence(F.lit(0), F.col("_in") - 1), lambda o: F.concat_ws(":", F.lit("i"), "_own", o))).otherwise(F.array()),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("_out") - 1), lambda o: F.concat_ws(":", F.lit("i"), o, "_own")))
    told = told.withColumn("_own", own).withColumn("_meets", F.explode(meets))
    return told.select(F.concat_ws("/", group, "_meets").alias("pair"), "id", "root", "outside", "n")


def largest_roots(rows: DataFrame, group: str) -> DataFrame:
    counts = rows.groupBy(group, "root").agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.max(F.struct("_n", "root"))["root"].alias("main"))


def links_left(rows: DataFrame, sets: DataFrame, texts: DataFrame, signatures: Signatures, percent: int, words: int, block: int, shingles: int, signed: int) -> DataFrame:
    """``a, b``: further verified links between the roots of ``rows(bucket, id, root)``, enough to join all that are linked."""

    def near_roots(batch: pd.DataFrame) -> pd.DataFrame | None:
        """Joins of roots that may be linked (a, b), and all rows that a link of theirs could start from (id)."""
        batch = batch.drop_duplicates("id")
        ids, roots = batch["id"].to_numpy(), batch["root"].to_numpy()
        table = signatures.table(batch["signature"])
        names, at = np.unique(roots, return_inverse=True)
        top, ends = np.arange(len(names)), np.zeros(len(ids), dtype=bool)
        for i in np.flatnonzero(batch["outside"].to_numpy(dtype=bool)):
            near = ((table != table[i]).sum(axis=1) <= signatures.distance) & (roots != roots[i])
            if near.any():
                ends |= near
                ends[i] = True
                met = top[at[near]]
                if (met != top[at[i]]).any():  # most rows of a large group only meet what is joined already
                    met = np.unique(np.append(met, top[at[i]]))
                    top[np.isin(top, met)] = met[0]
        joins = [(names[k], names[t], None, None) for k, t in enumerate(top) if k != t]
        out = joins + [(None, None, i, r) for i, r in zip(ids[ends], roots[ends], strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "id", "root"], dtype=object)

    sized = rows.withColumn("n", F.lit(0))
    meeting = dealt(sized, "bucket", largest_roots(rows, "bucket"), signed, shingles).drop("n").join(sets.select("id", "signature"), "id")
    meeting = meeting.select("pair", "id", "root", "outside", "signature")
    maybe = cut(sorted_groups(meeting, "pair", near_roots, "a long, b long, id long, root long").distinct(), "maybe")
    pairs = maybe.where("id is null").select("a", "b")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    clusters = components(ends, pairs).select(F.col("node").alias("root"), F.col("component").alias("cluster"))
    members = maybe.where("id is not null").select("id", "root").join(clusters, "root").join(sets.select("id", "n_shingles"), "id")
    members = cut(members.withColumnRenamed("n_shingles", "n"), "members")

    def link(batch: pd.DataFrame) -> pd.DataFrame | None:
        batch = batch.drop_duplicates("id")
        sets_ = [np.frombuffer(s, dtype=np.uint64) for s in batch["shingles"]]
        sizes = np.array([len(s) for s in sets_])
        values = np.concatenate(sets_)
        order = np.argsort(values, kind="stable")
        owner, values = np.repeat(np.arange(len(sets_)), sizes)[order], values[order]

        def near(i: int) -> np.ndarray:
            lo, hi = np.searchsorted(values, sets_[i], "left"), np.searchsorted(values, sets_[i], "right")
            each = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            common = np.bincount(owner[at], minlength=len(sets_))
            return linked(common, sizes[i], sizes, percent)

        return pd.DataFrame(joined_outside_largest(batch["root"].to_numpy(), near), columns=["a", "b"])

    meeting = dealt(members.select("cluster", "id", "root", "n"), "cluster", largest_roots(members, "cluster"), block, shingles)
    meeting = with_sets(meeting.drop("n", "outside"), sets, texts, words).select("pair", "id", "root", "shingles")
    return sorted_groups(meeting, "pair", link, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    words: int = WORDS,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
    block_signatures: int = BLOCK_SIGNATURES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked if 100 * intersection >= ``percent`` * union of their sets of shingles, equal
    sets always. ``component_id`` is the smallest doc_id reachable along links, ``kept`` whether it
    is the row's own. A text that is null, empty or without words has no shingle and no link. Null
    ids name no component where another id can; where none can, ``component_id`` is null and the
    row kept. Of repeated rows all are kept or none. An empty table gives no rows; further columns
    are ignored.
    """
    signatures = Signatures(percent)
    texts = id_and_text(docs, id_col, text_col)
    described = cut(described_sets(texts, words, signatures), "signatures")
    sets = described.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    keys = keys_of(sets.where(F.col("n_shingles") >= smallest_linked(percent)), signatures)
    crowded = cut(keys.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"), "crowded")
    hits = cut(sift(keys, crowded, "bucket").where("_hit").drop("_hit").join(crowded, "bucket"), "hits")

    stars = hits.where("head <> id").select("head", "id").distinct()
    near = cut(near_pairs(stars, sets, signatures), "near")
    links = cut(verified_pairs(near, sets, texts, words, percent).distinct(), "links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    joined = components(ends, links)

    rooted = hits.where("n > 2").join(joined.withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.select("bucket", "id", F.coalesce("component", "id").alias("root"))
    # Of buckets that hold the same rows, as two hashes tell, one is enough.
    held = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), *held).where("low <> high")
    split = split.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    rooted = cut(rooted.join(split.select("bucket"), "bucket"), "rooted")
    if not rooted.isEmpty():
        more = cut(links_left(rooted, sets, texts, signatures, percent, words, block, block_shingles, block_signatures), "more")
        ends = ends.unionByName(more.select(F.col("a").alias("node"))).unionByName(more.select(F.col("b").alias("node"))).distinct()
        joined = components(ends, links.unionByName(more))

    named = sets.select("id", "key", "first").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = cut(named.select("key", "first", F.coalesce("component", "id").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(ids, "root").select("key", "component_id")
    out = described.select("doc_id", "key", "n_shingles").join(known, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
