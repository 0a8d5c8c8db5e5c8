"""Shards of near-equal size from whole groups: the minimax contiguous partition.

Rows of equal text form one atomic group; groups stand in the order of a hash of their text.
The smallest capacity for which a greedy walk over the order needs no more shards than given
is found by binary search on the driver, over sums of at most a few thousand blocks of
neighbouring groups. Where a cut may fall inside a block, the block is split by another pass
over the group table, until every cut is known to the group. So the driver's memory is
bounded whatever the number of groups, and the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.common import id_and_text, map_rows
from waymesh.session import cut, retire

LAW = "bytes"
BLOCKS = 4096
#: Parts an unsettled block is split into, at least.
LEAST_PIECES = 16
KEY_END = 1 << 62


@dataclass(frozen=True)
class Block:
    """Neighbouring groups: first and last key, bytes in all."""

    first: int
    last: int
    size: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


class Order:
    """Blocks in key order with their running sums."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.ends = [0, *accumulate(b.size for b in blocks)]
        self.total = self.ends[-1]

    def surely(self, capacity: int, shards: int) -> list[int]:
        """Where greedy shards end if cuts fall on block ends only: never too far."""
        at, found = 0, []
        for _ in range(shards):
            at = self.ends[bisect_right(self.ends, at + capacity) - 1]
            found.append(at)
        return found

    def at_most(self, capacity: int, shards: int) -> list[int]:
        """Where greedy shards end if cuts may fall anywhere in a block of several groups."""
        at, found = 0, []
        for _ in range(shards):
            reach = min(at + capacity, self.total)
            i = bisect_right(self.ends, reach) - 1
            at = self.ends[i] if i == len(self.blocks) or self.blocks[i].atomic else reach
            found.append(at)
        return found

    def least(self, walk, shards: int) -> int:
        """The smallest capacity with which ``walk`` gets to the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if walk(middle, shards)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low


    def even(self, capacity: int, shards: int) -> list[int]:
        """Ends of the shards but the last, none above ``capacity``, each as near to an even share as that lets it be.

        ``capacity`` is feasible: walking back from the end tells how early each cut may be.
        """
        earliest, at = [], self.total
        for _ in range(shards - 1):
            at = self.ends[bisect_left(self.ends, at - capacity)]
            earliest.append(at)
        found, at = [], 0
        for j, low in zip(range(1, shards), reversed(earliest), strict=True):
            target = self.total * j // shards
            lo, hi = bisect_left(self.ends, max(low, at)), bisect_right(self.ends, at + capacity) - 1
            i = min(max(bisect_left(self.ends, target), lo), hi)
            if i > lo and target - self.ends[i - 1] < self.ends[i] - target:
                i -= 1
            at = self.ends[i]
            found.append(at)
        return found


def window_sums(groups: DataFrame, firsts: list[int], lasts: list[int]) -> list[Block]:
    """The groups within disjoint ranges of keys, in order, as a block for each range that holds any."""
    shared = groups.sparkSession.sparkContext.broadcast((np.array(firsts, dtype=np.int64), np.array(lasts, dtype=np.int64)))

    def make():
        lows, highs = shared.value

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            keys, sizes = batch["key"].to_numpy(dtype=np.int64), batch["size"].to_numpy(dtype=np.int64)
            at = np.searchsorted(lows, keys, side="right") - 1
            within = (at >= 0) & (keys <= highs[at])
            return pd.DataFrame({"block": at, "key": keys, "size": sizes})[within]

        return work

    dealt = map_rows(groups.select("key", "size"), make, "block int, key long, size long")
    sums = dealt.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"))
    return sorted((Block(r["first"], r["last"], r["size"]) for r in sums.collect()), key=lambda b: b.first)


def pieces(windows: list[tuple[int, int]], each: int) -> tuple[list[int], list[int]]:
    """First and last keys of ``each`` even parts of every window."""
    firsts, lasts = [], []
    for first, last in windows:
        width = -(-(last - first + 1) // each)
        starts = range(first, last + 1, width)
        firsts += starts
        lasts += [min(start + width - 1, last) for start in starts]
    return firsts, lasts


def first_blocks(groups: DataFrame, total: int) -> list[Block]:
    """Blocks of about even sizes. Groups of an even block's size or more, at most ``BLOCKS``, are blocks of their own:
    what is left has no block that a cut could move by much, however skewed the groups are."""
    heavy = sorted((r["key"], r["size"]) for r in groups.where(F.col("size") * F.lit(BLOCKS) >= F.lit(total)).collect())
    firsts, lasts = pieces([(0, KEY_END - 1)], BLOCKS)
    for key, _ in heavy:  # no block reaches across a heavy group
        i = bisect_right(firsts, key) - 1
        firsts[i : i + 1], lasts[i : i + 1] = [firsts[i], key + 1], [key - 1, lasts[i]]
    taken = [(a, b) for a, b in zip(firsts, lasts, strict=True) if a <= b]
    light = window_sums(groups, [a for a, _ in taken], [b for _, b in taken])
    return sorted(light + [Block(key, key, size) for key, size in heavy], key=lambda b: b.first)


def minimax_cuts(groups: DataFrame, shards: int, watch: Callable[[int], None] = lambda windows: None) -> tuple[int, list[int]]:
    """Least capacity and the first key of every shard but the first, for ``groups(key, size)``.

    Keys are distinct and in ``[0, 2^62)``. Fewer cuts come back when shards stay empty.
    ``watch`` is told how many windows each further pass splits.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    order = Order(first_blocks(groups, total))
    while True:
        sure, open_ = order.least(order.surely, shards), order.least(order.at_most, shards)
        near = order.surely(open_, shards)
        far = order.at_most(sure, shards)
        unknown = set()
        for low, high in zip(near, far, strict=True):
            lo, hi = bisect_right(order.ends, low) - 1, bisect_right(order.ends, high) - 1
            unknown |= {i for i in range(lo, min(hi + 1, len(order.blocks))) if not order.blocks[i].atomic}
        if not unknown:
            break
        watch(len(unknown))
        windows = [(order.blocks[i].first, order.blocks[i].last) for i in sorted(unknown)]
        finer = window_sums(groups, *pieces(windows, max(LEAST_PIECES, BLOCKS // len(windows))))
        kept = [b for i, b in enumerate(order.blocks) if i not in unknown]
        order = Order(sorted(kept + finer, key=lambda b: b.first))
    starts = sorted({order.ends.index(end) for end in order.even(sure, shards) if 0 < end < order.total})
    return sure, [order.blocks[i].first for i in starts]


def own_shards(groups: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """Groups no smaller than an even share of what is left, largest first: each fills a shard alone.

    The least capacity is at least the largest group. Where that is above an even share the
    capacity says nothing about the other shards: a walk under it would fill few and leave many
    empty. Below an even share it bounds every shard, so no such rule is needed there.
    """
    alone: list[tuple[int, int]] = []
    for row in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if row["size"] * (shards - len(alone)) < total:
            break
        alone.append((row["key"], row["size"]))
        total -= row["size"]
    return alone


def shard_of(key: Column, alone: list[int], cuts: list[int]) -> Column:
    shard = F.lit(len(alone)) + sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i, giant in enumerate(alone):
        shard = F.when(key == F.lit(giant), i).otherwise(shard)
    return shard.cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus 1; equal texts share a shard, a null text goes
    with the empty one. A group larger than an even share has a shard of its own, so the rest
    can still be even. ``slot`` counts a shard's rows by text hash, then doc_id, from 0 without
    gaps; repeated rows get a slot each, null ids come first. An empty table gives no rows;
    further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        id_and_text(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 2).alias("key"),
        ),
        "sized",
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone = [key for key, _ in own_shards(groups, total, shards)]
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    _, cuts = minimax_cuts(rest, shards - len(alone))
    placed = cut(
        rows.withColumn("shard", shard_of(F.col("key"), alone, cuts))
        .repartitionByRange("shard", "key", "doc_id")
        .sortWithinPartitions("shard", "key", "doc_id")
        .withColumn("place", F.monotonically_increasing_id()),
        "placed",
    )
    retire(groups)
    part = F.shiftright("place", 33).alias("part")
    pieces = placed.groupBy("shard", part).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (  # one row for every task and shard: a few more than there are tasks
        placed.withColumn("part", part)
        .join(F.broadcast(starts), ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("place") - F.col("first") + F.col("before")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
