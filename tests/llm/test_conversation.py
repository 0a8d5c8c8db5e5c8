"""Repair of conversations against a plain search over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from waymesh.llm import conversation as c

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("conv", "copies", "part", "seq", "key", "audit", "cells")]
)
LEGAL = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Left to right over (state, rows done): the least (cost, audit, lines)."""
    steps = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def grown(front):
        for _ in range(3):
            for state, (cost, audit, lines) in list(front.items()):
                for role in ("user", "assistant"):
                    to = steps.get((state, role[0]))
                    new = (cost + 5, audit + "I", [*lines, role + ":"])
                    if to and (to not in front or new[:2] < front[to][:2]):
                        front[to] = new
        return front

    front = grown({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def put(state, cost, audit, lines, after=after):
            if state and (state not in after or (cost, audit) < after[state][:2]):
                after[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in front.items():
            put(state, cost + 2, audit + "D", lines)
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                put(steps.get((state, role[:1])), cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    put(steps.get((state, new[0])), cost + more + 1, audit + "R", [*lines, f"{new}:{text}"])
        front = grown(after)
    return min((front[s] for s in ("0", "a") if s in front), key=lambda x: x[:2])


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = after_damage([r for r in rows if r[0] == conv])
        faults = faults_of(mine)
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = cheapest(mine, faults)
        assert LEGAL.fullmatch("".join(line[0] for line in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=repr)


@pytest.fixture
def repaired(spark):
    def make(rows, **sizes):
        df = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)
        return sorted((tuple(r) for r in c.repair_conversations(df, **sizes).collect()), key=repr)

    return make


def odd_rows(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "useless", "S"]
    texts = [None, "", " \n", "Hi.", "Hi", "Why? ", "ü!", "Long " * 2000 + ".", "No end", *[f"Line {i}." for i in range(60)]]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, turn, None, 3]), rng.choice(roles), rng.choice(texts)))
    return rows + rng.sample(rows, len(rows) // 5)


def test_equals_plain_search(repaired):
    rows = odd_rows(1, [None, -3, 0, *range(5, 45)], 9) + [(100 + i, t, "user", "x.") for i in range(30) for t in range(2)]
    assert repaired(rows) == plain(rows)


def test_conversations_over_many_blocks_and_tasks(repaired):
    rows = odd_rows(2, [7, 8, None], 150) + odd_rows(3, range(20, 26), 6) + [(8, 3, "user", "Again.")] * 70 + [(8, 900, "assistant", "Again.")] * 9
    assert repaired(rows, block_rows=3, fan=2) == plain(rows)
    assert repaired(rows, block_chars=20, fan=3) == plain(rows)


def test_nothing_left_and_empty(repaired):
    dropped = [(i, 0, "user", "Hi.") for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    assert dropped and repaired(dropped) == plain(dropped)
    assert plain(dropped)[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired([]) == []


def test_cells_do_not_depend_on_where_spans_are_cut():
    rng = random.Random(5)
    for _ in range(60):
        kinds = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(2, 12)))
        whole = c.span(kinds, [1] * len(kinds))
        at = rng.randint(1, len(kinds) - 1)
        assert c.joined(c.span(kinds[:at], [1] * at), c.span(kinds[at:], [1] * (len(kinds) - at))) == whole
        assert c.root(whole)[1].count("D") >= kinds.count("x")
