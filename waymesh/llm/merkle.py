"""A Merkle manifest of a table: every row a leaf, proofs, and the roots of tampered versions.

Rows of a language are leaves in the order of their ids; eight neighbours have one parent, level by
level. Four levels over 4096 aligned leaves make a block, which one task holds. Blocks know nothing
of each other: what a block hands up is its root, and the roots are the leaves of the level above,
again in aligned blocks, until one block is left. The subroots of the languages are one more such
tree. Going down again, every block learns the siblings on the way from its root to the top.

A tampered leaf makes a version of the tree (:class:`Version`): it copies the ancestors of the leaf
and shares every other node. Inside a block the copies are made from the block's own nodes; above
it they are continued from the siblings that came down.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.common import map_rows, sorted_groups
from waymesh.operators.numbering import number_rows
from waymesh.session import cut

FAN = 8
#: Levels of a block: FAN ** HEIGHT leaves.
HEIGHT = 4
TAMPERED_PARTS = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What stands beside the path at one level: the run's nodes before and after, joined.
STEPS = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    """A tree with one leaf replaced: its copied nodes, from the leaf up, and the tree all others are shared with."""

    base: BlockTree
    pos: int
    copied: tuple[str, ...]

    def node(self, level: int, at: int) -> str:
        return self.copied[level] if at == self.pos // FAN**level else self.base.levels[level][at]

    @property
    def root(self) -> str:
        return self.copied[-1]


class BlockTree:
    """The nodes of an aligned block and what stands above them within the block."""

    def __init__(self, leaves: list[str], height: int | None):
        """``height`` None: the block is its tree's only one, so it ends where one node is left."""
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            under = self.levels[-1]
            self.levels.append([digest("".join(under[i : i + FAN])) for i in range(0, len(under), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def step(self, level: int, at: int) -> tuple[str, str]:
        """What stands left and right of node ``at`` in its run."""
        start = at - at % FAN
        nodes = self.levels[level]
        return "".join(nodes[start:at]), "".join(nodes[at + 1 : start + FAN])

    def path(self, pos: int) -> list[tuple[str, str]]:
        """The steps from leaf ``pos`` to the root."""
        return [self.step(level, pos // FAN**level) for level in range(len(self.levels) - 1)]

    def version(self, pos: int, leaf: str) -> Version:
        """The tree in which ``leaf`` stands at ``pos``; only its ancestors are made anew."""
        return Version(self, pos, tuple(copies(leaf, self.path(pos))))


def copies(leaf: str, steps) -> list[str]:
    """``leaf`` and its ancestors along ``steps``."""
    made = [leaf]
    for left, right in steps:
        made.append(digest(left + made[-1] + right))
    return made


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, other``: the language's key, the leaf, and the tampered leaf where there is one.

    ``tree`` sorts as the languages do, null first.
    """
    columns = [docs[c].cast(t) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    text = docs["text"].cast("string")
    hit = F.crc32(columns[0].cast("string").cast("binary")) % TAMPERED_PARTS == 0
    lower = F.translate(text, UPPER, UPPER.lower())
    return docs.select(
        F.coalesce(F.concat(F.lit("="), columns[2]), F.lit("")).alias("tree"),
        columns[0].alias("doc_id"),
        F.unhex(leaf_of(*columns, text)).alias("leaf"),
        F.when(hit, F.unhex(leaf_of(*columns, lower))).alias("other"),
        F.spark_partition_id().alias("_part"),
    )


def in_order(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``pos``, the place in its tree, and ``n``, the leaves of the tree.

    Equal rows are told apart by where they were read, so a row that repeats without end still
    spreads over many tasks.
    """
    order = ["tree", "doc_id", "leaf", "_part"]
    placed = leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("_part")
    placed = cut(placed.withColumn("_place", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_place", 33).alias("_part")
    pieces = placed.groupBy("tree", part).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n")
    )
    numbered = placed.withColumn("_part", F.shiftright("_place", 33)).join(starts, ["tree", "_part"])
    return numbered.withColumn("pos", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_part", "_first", "_before")


def block_tree(leaves, n: int, height: int) -> BlockTree:
    return BlockTree([bytes(x).hex() for x in leaves], None if n <= FAN**height else height)


def blocks_of(nodes: DataFrame, height: int, others: bool = False) -> DataFrame:
    """One row for each aligned block of ``nodes(tree, pos, n, leaf, ...)``: its nodes in order and its root."""
    held = ["doc_id", "other"] if others else []
    size = FAN**height

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        leaves = list(rows["leaf"])
        root = bytes.fromhex(block_tree(leaves, first["n"], height).root)
        out = {"tree": [first["tree"]], "block": [first["pos"] // size], "n": [first["n"]], "root": [root], "leaves": [leaves]}
        return pd.DataFrame(out | {f"{c}s": [list(rows[c].to_numpy(dtype=object))] for c in held})

    keyed = nodes.withColumn("key", F.concat_ws(":", "tree", F.expr(f"pos div {size}")))
    schema = "tree string, block long, n long, root binary, leaves array<binary>"
    schema += ", doc_ids array<long>, others array<binary>" if others else ""
    return sorted_groups(keyed.select("key", "tree", "pos", "n", "leaf", *held), "key", work, schema, ("pos",))


def grown(nodes: DataFrame, height: int, others: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every level of all trees, lowest first, and ``tree, subroot``."""
    size = FAN**height
    levels = [cut(blocks_of(nodes, height, others), "blocks")]
    while levels[-1].where(F.col("n") > size).limit(1).count():
        up = levels[-1].where(F.col("n") > size)
        up = up.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("leaf"))
        levels.append(cut(blocks_of(up, height), "blocks"))
    tops = [level.where(F.col("n") <= size).select("tree", F.col("root").alias("subroot")) for level in levels]
    return levels, reduce(DataFrame.unionByName, tops)


def opened(blocks: DataFrame, height: int, more: list[str]) -> DataFrame:
    """A row for every node of ``blocks``, as the block below it that it is the root of: the steps from it to the top."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in batch.itertuples(index=False):
                tree = block_tree(row.leaves, row.n, height)
                above = [(s["left"], s["right"]) for s in row.steps]
                for i in range(len(row.leaves)):
                    steps = [{"left": a, "right": b} for a, b in tree.path(i) + above]
                    out.append((row.tree, row.block * FAN**height + i, steps, *[getattr(row, c) for c in more]))
            return pd.DataFrame(out, columns=["tree", "block", "steps", *more])

        return work

    schema = ", ".join([f"tree string, block long, steps {STEPS}", *[f"{c} string" for c in more]])
    return map_rows(blocks.select("tree", "block", "n", "leaves", "steps", *more), make, schema)


def with_steps(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest blocks with ``steps`` from their roots upwards, and what else ``tops(tree, steps, ...)`` says of their trees."""
    size, more = FAN**height, [c for c in tops.columns if c not in ("tree", "steps")]
    below = None
    for level in reversed(levels):
        known = level.where(F.col("n") <= size).join(tops, "tree")
        if below is not None:
            known = known.unionByName(level.where(F.col("n") > size).join(below, ["tree", "block"]))
        below = opened(known, height, more)
    return known


def proved(blocks: DataFrame, height: int) -> DataFrame:
    """Every leaf of the lowest blocks with its proof, and the root of its version of the tree."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in batch.itertuples(index=False):
                tree = block_tree(row.leaves, row.n, height)
                above = [(s["left"], s["right"]) for s in row.steps]
                beyond = "".join(a + b for a, b in above)
                for i, (doc_id, leaf, other) in enumerate(zip(row.doc_ids, tree.levels[0], row.others, strict=True)):
                    proof = digest("".join(a + b for a, b in tree.path(i)) + beyond)
                    version = tree.version(i, leaf if other is None else bytes(other).hex())
                    folded = copies(version.root, above)[-1]
                    out.append((doc_id, leaf, row.subroot, row.root_, proof, folded, folded == row.root_))
            return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], dtype=object)

        return work

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_rows(blocks.select("n", "leaves", "doc_ids", "others", "steps", "subroot", "root_"), make, schema)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``docs`` has doc_id, source, lang, n_chars and text; any may be null, further columns are
    ignored. Null ids and null languages come first; rows of one id stand by their leaf's digest;
    repeated rows are leaves of their own. A null id is never tampered with, and a tampered text
    without capitals, empty or null, has the leaf it had, so it verifies. A lone leaf is its
    subroot; the proof of an only leaf is the digest of nothing. An empty table gives no rows.
    A task holds blocks of ``height`` levels.
    """
    levels, subroots = grown(in_order(leaves_of(docs)), height, others=True)
    ordered = number_rows(subroots, ["tree"], "pos")
    forest = ordered.select(F.lit("").alias("tree"), "pos", F.col("subroot").alias("leaf"))
    upper, top = grown(forest.withColumn("n", F.lit(subroots.count())), height)
    top = top.select("tree", F.array().cast(STEPS).alias("steps"), F.lower(F.hex("subroot")).alias("root_"))
    above = opened(with_steps(upper, top, height), height, ["root_"]).select(F.col("block").alias("pos"), "steps", "root_")
    tops = ordered.join(above, "pos").select("tree", "steps", F.lower(F.hex("subroot")).alias("subroot"), "root_")
    return proved(with_steps(levels, tops, height), height)
