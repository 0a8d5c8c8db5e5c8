"""Benchmark passages in documents, by SimHash of item-sized windows.

Every window of as many words as a benchmark item has gets a 64-bit SimHash of its word
5-grams. A multi-index over blocks of the items' fingerprints finds all items within a Hamming
radius: of 8 blocks, one differs in at most an eighth of the bits that the whole differs in,
so looking up every block with that many flips misses none. Exact weighted similarity (5-grams
with their multiplicity) decides.

Two facts keep this cheap without losing a window. A similarity of at least t needs at least
t of the window's 5-grams to be 5-grams of the item, so a window with fewer benchmark 5-grams
is not fingerprinted; and only items of the window's own size are looked up.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import id_and_text, keep_rows, map_rows
from waymesh.llm.ngram_join import THRESHOLD, WORDS, gram_sequence

BITS, BLOCKS = 64, 8
#: At similarity 0.8 a bit differs with probability 0.152: 9.7 bits, deviation 2.9. Radius 23 is
#: more than four deviations off.
RADIUS = 23
#: Items a task holds at a time; a larger benchmark takes as many passes as it has such parts.
PART_ITEMS = 20_000
SIEVE_BITS = 20


def spread(grams: np.ndarray) -> np.ndarray:
    """Bits of the hashes as -1 and 1, a row for each."""
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(votes: np.ndarray) -> np.ndarray:
    """Sign of every column as a bit: fingerprints of summed rows."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(grams: np.ndarray) -> int:
    return int(packed(spread(grams).sum(axis=0, keepdims=True))[0])


@dataclass
class SizeIndex:
    """Items with one number of n-grams: fingerprints and, for each block and value, who is near."""

    items: np.ndarray
    prints: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, items: list[int], prints: list[int], radius: int) -> SizeIndex:
        flips = radius // BLOCKS
        width = BITS // BLOCKS
        masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)]
        near = np.zeros((BLOCKS, 1 << width, len(items)), dtype=bool)
        for i, value in enumerate(prints):
            for block in range(BLOCKS):
                own = value >> (block * width) & ((1 << width) - 1)
                near[block, [own ^ m for m in masks], i] = True
        return cls(np.array(items), np.array(prints, dtype=np.uint64), near)

    def within(self, windows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) whose fingerprints differ in at most ``radius`` bits: all there are."""
        keys = windows.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        found = self.near[0, keys[:, 0]].copy()
        for block in range(1, BLOCKS):
            found |= self.near[block, keys[:, block]]
        at, item = np.nonzero(found)
        close = np.bitwise_count(windows[at] ^ self.prints[item]) <= radius
        return at[close], item[close]


@dataclass
class Benchmark:
    """Items by number of n-grams, all their n-grams, and a sieve over hash bits."""

    ids: list[int | None]
    bags: list[Counter]
    sizes: dict[int, SizeIndex]
    short: dict[int, dict[int, list[int]]]
    grams: np.ndarray
    sieve: np.ndarray
    threshold: float
    radius: int

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], threshold: float, radius: int) -> Benchmark:
        ids, bags, by_size, short = [], [], {}, {}
        for item_id, text in rows:
            grams = gram_sequence(text)
            if not len(grams):
                continue
            count = len(gram_sequence(text, 1)) if len(grams) == 1 else WORDS
            if count < WORDS:  # its one n-gram has so many words
                short.setdefault(count, {}).setdefault(int(grams[0]), []).append(len(ids))
            else:
                by_size.setdefault(len(grams), []).append((len(ids), simhash(grams)))
            ids.append(item_id)
            bags.append(Counter(grams.tolist()))
        sizes = {n: SizeIndex.of([i for i, _ in v], [p for _, p in v], radius) for n, v in sorted(by_size.items())}
        grams = np.unique(np.array([g for b in bags for g in b], dtype=np.uint64))
        sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        sieve[(grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        return cls(ids, bags, sizes, short, grams, sieve, threshold, radius)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard: shared multiplicities over joint ones."""
        own, bag = Counter(window.tolist()), self.bags[item]
        both = (own & bag).total()
        return both / (own.total() + bag.total() - both)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which n-grams some item has."""
        found = self.sieve[(grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
            found[at] = self.grams[place] == grams[at]
        return found

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)``: the best window of every stretch of matches."""
        grams = gram_sequence(text)
        if not len(grams) or not len(self.grams):
            return []
        found = self._short_leaks(text)
        hits = self.hits(grams)
        if not hits.any():
            return sorted(found)
        before = np.concatenate([[0], np.cumsum(hits)])
        for size, index in self.sizes.items():
            width = min(size, len(grams))  # a document a little shorter than the item is one window
            need = math.ceil(self.threshold * size - 1e-9)
            starts = np.flatnonzero(before[width:] - before[: len(before) - width] >= need)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
                found += self._stretch(grams, run, width, index)
        return sorted(found)

    def _short_leaks(self, text: str) -> list[tuple[int, int, int, float]]:
        """Items of fewer words than an n-gram, wherever the text holds just these words; one place of each stretch."""
        found = []
        for count, items in self.short.items():
            grams = gram_sequence(text, count)
            for gram in set(grams.tolist()) & items.keys():
                starts = np.flatnonzero(grams == np.uint64(gram))
                firsts = starts[np.concatenate([[True], np.diff(starts) >= count])]
                found += [(item, int(start), count, 1.0) for item in items[gram] for start in firsts]
        return found

    def _stretch(self, grams: np.ndarray, run: np.ndarray, width: int, index: SizeIndex) -> list[tuple[int, int, int, float]]:
        best: dict[int, tuple[float, int]] = {}
        for lo in range(0, len(run), 4096):
            part = run[lo : lo + 4096]
            first = int(part[0])
            sums = np.cumsum(spread(grams[first : int(part[-1]) + width]), axis=0)
            sums = np.concatenate([np.zeros((1, BITS), dtype=sums.dtype), sums])
            windows = packed(sums[part - first + width] - sums[part - first])
            for at, item in zip(*index.within(windows, self.radius), strict=True):
                start, number = int(part[at]), int(index.items[item])
                share = self.similarity(grams[start : start + width], number)
                if share >= self.threshold - 1e-9:
                    best[number] = max(best.get(number, (0.0, 0)), (share, -start))
        return [(number, -start, width + WORDS - 1, share) for number, (share, start) in best.items()]


def benchmark_parts(items: DataFrame, threshold: float, radius: int, part_items: int):
    """``items(doc_id, text)`` as broadcasts of about ``part_items`` items each, whatever their number."""
    items = items.where("text is not null")
    parts = max(1, -(-items.count() // part_items))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part).collect()
        yield items.sparkSession.sparkContext.broadcast(Benchmark.of([tuple(r) for r in own], threshold, radius))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, part_items: int = PART_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark passage is found; null and empty texts stay."""
    for shared in benchmark_parts(id_and_text(benchmark, "item_id"), threshold, radius, part_items):

        def make(shared=shared):
            known = shared.value
            return lambda text: not known.leaks(text)

        docs = keep_rows(docs, make)
    return docs


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_items: int = PART_ITEMS,
) -> DataFrame:
    """The benchmark passages in ``docs``: ``doc_id, item_id, start_word, n_words, similarity``.

    One row for each row of ``docs``, item and stretch of overlapping windows that match: the
    best window, the first of equals. Clean documents give no rows, nor do null and empty texts
    or items. An item of fewer than five words is found where a text holds
    just these words one after another.
    Repeated rows of either table give repeated rows; further columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col)
    found = None
    for shared in benchmark_parts(id_and_text(benchmark, item_col, item_text_col), threshold, radius, part_items):

        def make(shared=shared):
            known = shared.value

            def work(batch: pd.DataFrame) -> pd.DataFrame:
                ids = batch["doc_id"].to_numpy(dtype=object)
                rows = [
                    (doc_id, known.ids[item], start, words, share)
                    for doc_id, text in zip(ids, batch["text"], strict=True)
                    for item, start, words, share in known.leaks(text)
                ]
                return pd.DataFrame(rows, columns=["doc_id", "item_id", "start_word", "n_words", "similarity"], dtype=object)

            return work

        schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
        leaks = map_rows(texts, make, schema)
        found = leaks if found is None else found.unionByName(leaks)
    return found
