"""The Merkle manifest against a plain tree held whole."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from waymesh.llm.merkle import BlockTree, manifest

FIELDS = [("doc_id", T.LongType()), ("source", T.StringType()), ("lang", T.StringType()), ("n_chars", T.LongType()), ("text", T.StringType())]
# Names that clash with inner ones.
EXTRA = [(n, T.StringType()) for n in ("tree", "leaf", "pos", "n", "steps", "root", "key", "_part")]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS + EXTRA])


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain(rows):
    """Every level of every tree in lists."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(tree, at):
        out = []
        for level in tree[:-1]:
            start = at // 8 * 8
            out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
            at //= 8
        return out

    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: levels([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for i, lang in enumerate(order):
        for j, (has, doc_id, own, row) in enumerate(sorted(langs[lang], key=lambda x: x[:3])):
            steps = way(trees[lang], j) + way(top, i)
            fold = own
            if has and zlib.crc32(str(doc_id).encode()) % 3 == 0 and row[4] is not None:
                fold = leaf(row, row[4].encode().lower().decode())
            for left, right in steps:
                fold = h(left + fold + right)
            root = top[-1][0]
            out.append((row[0], own, trees[lang][-1][0], root, h("".join(a + b for a, b in steps)), fold, fold == root))
    return sorted(out, key=repr)


@pytest.fixture
def made(spark):
    def make(rows, height=4):
        df = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], SCHEMA)
        return sorted((tuple(r) for r in manifest(df, height).collect()), key=repr)

    return make


def odd_rows(n, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "Ünicode ÀB Z", "no capitals", "ABC", "x" * 50_000 + "Y", "a:b|c"]
    rows = [(rng.choice([None, 7, *range(n)]), rng.choice([None, "s", ""]), rng.choice([None, "", "en", "en", "en", "de", "é"]), rng.choice([None, 0, -5]), rng.choice(texts)) for _ in range(n)]
    return rows + rows[: n // 3]  # repeated rows


@pytest.mark.parametrize("height", [1, 2, 4])
def test_equals_the_whole_tree(made, height):
    rows = odd_rows(400)
    assert made(rows, height) == plain(rows)


def test_small_tables(made):
    assert made([]) == []
    for n in (1, 2, 8, 9):
        rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
        assert made(rows, 1) == plain(rows)
    lone = made([(2, None, None, None, None)])
    assert lone[0][1] == lone[0][2] == lone[0][3] and lone[0][4] == h("") and lone[0][6]


def test_many_languages_and_one_repeated_row(made):
    rows = [(i, "s", f"l{i}", i, "T") for i in range(70)] + [(0, "s", "l0", 0, "T")] * 90
    assert made(rows, 1) == plain(rows)


def test_a_version_shares_what_its_leaf_does_not_touch():
    leaves = [h(str(i)) for i in range(600)]
    tree = BlockTree(leaves, None)
    version = tree.version(77, h("other"))
    changed = BlockTree([*leaves[:77], h("other"), *leaves[78:]], None)
    touched = 0
    for level, nodes in enumerate(changed.levels):
        for at, node in enumerate(nodes):
            assert version.node(level, at) == node
            touched += version.node(level, at) is not tree.levels[level][at]
    assert touched == len(version.copied) == 5 and version.root == changed.root
