"""Repair of damaged conversations: the cheapest edits that make the roles legal.

Legal role initials are none, or ``s?(ua)+``. Edits and their costs make a grammar in Chomsky normal
form. Its symbols are the ways a span of rows can lead from one state of a conversation to another
(start, after the system row, after a user row, after an assistant row); a symbol of a span is two
symbols of its halves that meet in a state, and one row derives a symbol by being kept, given
another role or deleted, with rows inserted before and after (the closure is part of the leaf). A
cell holds the least (cost, audit) of every symbol. Cells of neighbouring spans are joined bottom-up,
by span length; equal costs never let one audit be the beginning of another, so the least of the
parts is the least of the whole, wherever a span is cut.

So a conversation needs no task of its own: rows are sorted by range, a conversation that ends
within a task and a block is repaired there, and all others leave blocks whose cells, counts and ends
are joined in rounds of ``FAN``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import map_frames, map_rows, sorted_groups
from waymesh.session import cut, retire

DROP, EMPTY, STRIP, REPEAT, RECAST, KINDS = 0, 1, 2, 3, 4, 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: Rows and characters of a block.
BLOCK_ROWS = 1024
BLOCK_CHARS = 4 << 20
#: Spans that one round joins.
FAN = 32
#: Characters of a text that take part in dealing rows out; the order itself uses all of them.
DEALT_CHARS = 200
#: Spans of so many rows are remembered by their kinds of rows.
REMEMBERED = 8

START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row of a role does to the state.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
SYMBOLS = [(p, q) for p in range(4) for q in range(4) if p == q or (p < q and q) or (p, q) == (ASSISTANT, USER)]
#: For each symbol, the pairs of symbols it derives.
RULES = [[(SYMBOLS.index((p, r)), SYMBOLS.index((r, q))) for r in range(4) if (p, r) in SYMBOLS and (r, q) in SYMBOLS] for p, q in SYMBOLS]
LEGAL = {"su", "ua", "au"}

Cell = tuple[tuple[int, str] | None, ...]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for rules in RULES:
        best = None
        for a, b in rules:
            x, y = left[a], right[b]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best[0]:
                best = (cost, x[1] + y[1])
            elif cost == best[0]:
                best = min(best, (cost, x[1] + y[1]))
        out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """No row at all, and any number of inserted ones."""
    cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit) in list(cell.items()):
            for role in "ua":
                to = STEP[role].get(q)
                if to is not None:
                    more = (cost + INSERT, audit + "I")
                    cell[p, to] = min(cell.get((p, to), more), more)
    return tuple(cell.get(s) for s in SYMBOLS)


NOTHING = _closure()


def leaf(kind: str) -> Cell:
    """One row. ``x`` must go; else its initial (o: any other), a capital if the text is cut short."""
    cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "x":
        short = TRUNCATED if kind.isupper() else 0
        for edit, cost, roles in (("K", KEEP, kind.lower()), ("R", REROLE, "ua")):
            for role in roles:
                for p, q in STEP.get(role, {}).items():
                    way = (cost + short, edit)
                    cell[p, q] = min(cell.get((p, q), way), way)
    return joined(joined(NOTHING, tuple(cell.get(s) for s in SYMBOLS)), NOTHING)


LEAVES = {kind: leaf(kind) for kind in "xsuaoSUAO"}
_known: dict[str, Cell] = dict(LEAVES)


def span(kinds: str, copies: list[int]) -> Cell:
    """The cell of rows of ``kinds``; of ``copies`` of a row all but the first must go."""
    spans = []
    for kind, n in zip(kinds, copies, strict=True):
        if n:
            spans.append((kind, LEAVES[kind]))
        if n > 1:
            spans.append(("", power(LEAVES["x"], n - 1)))
    while len(spans) > 1:
        pairs = []
        for i in range(0, len(spans) - 1, 2):
            (x, left), (y, right) = spans[i], spans[i + 1]
            key = x + y if x and y and len(x + y) <= REMEMBERED else ""
            made = _known.get(key) if key else None
            if made is None:
                made = joined(left, right)
                if key:
                    _known[key] = made
            pairs.append((key, made))
        spans = pairs + spans[len(spans) - len(spans) % 2 :]
    return spans[0][1] if spans else NOTHING


def power(cell: Cell, n: int) -> Cell:
    out, step = NOTHING, cell
    while n:
        if n & 1:
            out = joined(out, step)
        step, n = joined(step, step) if n > 1 else step, n >> 1
    return out


def root(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the whole: no rows, or an end after an assistant row."""
    return min(x for x in (cell[SYMBOLS.index((START, START))], cell[SYMBOLS.index((START, ASSISTANT))]) if x is not None)


def apply_edits(audit: str, state: int, rows) -> tuple[list[str], int]:
    """Lines of ``rows(role, text, copies)`` after ``audit``, and the state they end in."""
    lines, letters = [], iter(audit)

    def insert(state: int, text: str) -> int:
        role = "assistant" if state == USER else "user"
        lines.append(f"{role}:{text}")
        return STEP[role[0]][state]

    for role, text, copies in rows:
        for _ in range(copies):
            edit = next(letters)
            while edit == "I":
                state = insert(state, "")
                edit = next(letters)
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = STEP[role[0]][state]
            elif edit == "R":
                state = insert(state, text)
    for _ in letters:  # inserted at the end
        state = insert(state, "")
    return lines, state


def pieces(audit: str, sizes: list[int], initials: list[str]) -> list[tuple[str, int]]:
    """``audit`` cut where blocks of so many rows end, each with the state it starts from."""
    out, at, state = [], 0, START
    for size, known in zip(sizes, initials, strict=True):
        start, before = at, state
        rows = iter(known)
        while size:
            edit = audit[at]
            at += 1
            if edit != "I":
                size -= 1
                initial = next(rows)
            if edit in "IR":
                state = ASSISTANT if state == USER else USER
            elif edit == "K":
                state = STEP[initial][state]
        out.append([start, at, before])
    if out:
        out[-1][1] = len(audit)
    return [(audit[a:b], s) for a, b, s in out]


@dataclass
class Counts:
    """What neighbouring spans add up to; ``first`` and ``last`` are initials at the ends."""

    rows: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    first: str = ""
    last: str = ""
    illegal: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0

    def then(self, after: Counts) -> Counts:
        if not self.rows or not after.rows:
            return self if self.rows else after
        same = self.high is not None and self.high == after.low
        return Counts(
            self.rows + after.rows,
            self.low if self.low is not None else after.low,
            after.high if after.high is not None else self.high,
            self.turns + after.turns - same,
            self.first,
            after.last,
            self.illegal + after.illegal + (self.last + after.first not in LEGAL),
            self.blank + after.blank,
            self.duplicate + after.duplicate,
            self.truncated + after.truncated,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


COUNTS = "rows long, low long, high long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long"
COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


@dataclass
class Block:
    """Neighbouring rows of a conversation; ``faults``: b blank, d duplicate, t truncated, else a point."""

    turns: list = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    marks: list[bytes] = field(default_factory=list)
    faults: str = ""
    chars: int = 0

    def add(self, turn, role: str, text: str, copies: int, seen: set[bytes]) -> None:
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        bare = text.rstrip(BLANKS)
        self.faults += "b" if not bare else "d" if mark in seen else "." if bare[-1] in ENDS else "t"
        seen.add(mark)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.marks.append(mark)
        self.chars += len(text)

    @property
    def initials(self) -> str:
        return "".join(r[0] if r and r[0] in STEP else "o" for r in self.roles)


def summed(turns, initials: str, faults: str, copies) -> tuple[Counts, Cell]:
    """Counts and cell of a block."""
    total, kinds = Counts(), ""
    for turn, initial, fault, n in zip(turns, initials, faults, copies, strict=True):
        kinds += "x" if fault in "bd" else initial.upper() if fault == "t" else initial
        if not n:
            continue
        blank, again = (n, 0) if fault == "b" else (0, n if fault == "d" else n - 1)
        turn = None if pd.isna(turn) else int(turn)
        total = total.then(Counts(n, turn, turn, int(turn is not None), initial, initial, n - 1, blank, again, int(fault == "t")))
    return total, span(kinds, copies)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
RESULT_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def result(total: Counts, cell: Cell) -> tuple:
    cost, audit = root(cell)
    return total.gaps, total.blank, total.duplicate, total.truncated, total.illegal, cost, audit


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows after damage, equal ones as one.

    A conversation's dropped rows become one of no copies, so none is forgotten.
    """
    conv_id, turn = conversations["conv_id"].cast("long"), conversations["turn"].cast("long")
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv_id), F.lit(":"), plain(turn)).cast("binary")) % KINDS
    role, text = plain(conversations["role"]), plain(conversations["text"])
    rows = conversations.select(
        conv_id.alias("conv_id"),
        F.when(kind != DROP, turn).alias("turn"),
        F.when(kind == DROP, "").when(kind == RECAST, "user").otherwise(role).alias("role"),
        F.when(kind.isin(DROP, EMPTY), "").when(kind == STRIP, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1).alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


BLOCK_SCHEMA = (
    "part int, seq int, turns array<long>, initials string, faults string, copies array<long>, "
    "marks array<binary>, roles array<string>, texts array<string>"
)


def in_blocks(rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Repaired conversations, and blocks of those that a task can't be sure to hold whole.

    ``conv_id, conv``, then the result or null, then the block or null.
    """
    names = ["conv_id", "conv", *RESULT, "repaired_sha256", *[c.split()[0] for c in BLOCK_SCHEMA.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out = TaskContext.get().partitionId(), []
        conv_id, conv, block, seen, seq, whole = None, None, None, set(), 0, False

        def leave():
            out.append(
                (conv_id, conv, *[None] * 8, part, seq, block.turns, block.initials, block.faults, block.copies, block.marks, block.roles, block.texts)
            )

        def finish():
            done = result(*summed(block.turns, block.initials, block.faults, block.copies))
            lines, _ = apply_edits(done[-1], START, zip(block.roles, block.texts, block.copies, strict=True))
            out.append((conv_id, conv, *done, hashlib.sha256("\n".join(lines).encode()).hexdigest(), *[None] * 9))

        for batch in batches:
            columns = (batch[c].to_numpy(dtype=object) for c in ("conv_id", "turn", "role", "text", "copies"))
            for own, turn, role, text, copies in zip(*columns, strict=True):
                key = "none" if own is None else str(own)
                if key != conv:
                    if conv is not None:
                        finish() if whole else leave()
                    whole = conv is not None  # the first may have begun in the task before
                    conv_id, conv, block, seen, seq = own, key, Block(), set(), 0
                elif len(block.turns) >= block_rows or block.chars >= block_chars:
                    leave()
                    block, seq, whole = Block(), seq + 1, False
                block.add(turn, role, text, copies, seen)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out.clear()
        if conv is not None:  # the last may go on in the task after
            leave()
            yield pd.DataFrame(out, columns=names, dtype=object)

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions(*order)
    return map_frames(dealt, run, f"conv_id long, conv string, {RESULT_SCHEMA}, repaired_sha256 string, {BLOCK_SCHEMA}")


def seen_before(blocks: DataFrame) -> DataFrame:
    """``conv, part, seq, again``: places in a block whose role and text stand in an earlier task's block.

    Within a task repeats are known, so a role and text come once from each.
    """
    rows = blocks.select("conv", "part", "seq", "faults", F.posexplode("marks").alias("place", "mark"))
    fault = F.substring("faults", F.col("place") + 1, F.lit(1))
    first = rows.where(~fault.isin("b", "d")).groupBy("conv", "mark").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "place"))).alias("at"))
    later = first.where(F.size("at") > 1).select("conv", F.explode(F.slice("at", 2, F.size("at") - 1)).alias("at"))
    return later.groupBy("conv", "at.part", "at.seq").agg(F.collect_list("at.place").alias("again"))


CELLS = "cells array<struct<cost: long, audit: string>>"


def packed(cell: Cell) -> list:
    return [None if x is None else {"cost": x[0], "audit": x[1]} for x in cell]


def unpacked(cells) -> Cell:
    return tuple(None if x is None else (int(x["cost"]), x["audit"]) for x in cells)


def counts_in(row) -> Counts:
    """The counts in a row of a table of spans."""
    known = (getattr(row, c) for c in COUNT_NAMES)
    return Counts(*[v if isinstance(v, str) else None if pd.isna(v) else int(v) for v in known])


def cells_of(blocks: DataFrame) -> DataFrame:
    """Counts and cells of every block: ``conv, part, seq, size, initials, ...``."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in batch.itertuples(index=False):
                again = set() if row.again is None else set(row.again)
                faults = "".join("d" if i in again else f for i, f in enumerate(row.faults))
                copies = [int(n) for n in row.copies]
                total, cell = summed(row.turns, row.initials, faults, copies)
                expanded = "".join(i * n for i, n in zip(row.initials, copies, strict=True))
                out.append((row.conv, row.part, row.seq, expanded, *[getattr(total, c) for c in COUNT_NAMES], packed(cell)))
            return pd.DataFrame(out, columns=["conv", "part", "seq", "initials", *COUNT_NAMES, "cells"], dtype=object)

        return work

    known = blocks.select("conv", "part", "seq", "turns", "initials", "faults", "copies")
    known = known.join(seen_before(blocks), ["conv", "part", "seq"], "left")
    return map_rows(known, make, f"conv string, part int, seq int, initials string, {COUNTS}, {CELLS}")


def joined_spans(spans: DataFrame, fan: int) -> DataFrame:
    """One row per conversation: its counts and cell, by rounds that join ``fan`` neighbours."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        total, level = Counts(), []
        for row in rows.itertuples(index=False):
            total = total.then(counts_in(row))
            level.append(unpacked(row.cells))
        while len(level) > 1:
            level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        first = rows.iloc[0]
        out = (first["conv"], first["part"], first["seq"], *[getattr(total, c) for c in COUNT_NAMES], packed(level[0]))
        return pd.DataFrame([out], columns=["conv", "part", "seq", *COUNT_NAMES, "cells"], dtype=object)

    spans = spans.drop("initials")
    for column in ("seq", "part"):
        while spans.agg(F.max(column)).first()[0]:
            up = spans.withColumn("at", F.col(column)).withColumn(column, F.expr(f"{column} div {fan}").cast("int"))
            keyed = up.withColumn("key", F.concat_ws(":", "conv", "part", "seq"))
            made = cut(sorted_groups(keyed, "key", work, f"conv string, part int, seq int, {COUNTS}, {CELLS}", ("at",)), "spans")
            retire(spans)
            spans = made
    return spans


def texts_hashed(blocks: DataFrame, audits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``. A digest is made in order, so one task reads a conversation's blocks, one after another."""

    def make_pieces():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in batch.itertuples(index=False):
                found = pieces(row.audit, [int(b["rows"]) for b in row.at], [b["initials"] for b in row.at])
                out += [(row.conv, b["part"], b["seq"], piece, state) for b, (piece, state) in zip(row.at, found, strict=True)]
            return pd.DataFrame(out, columns=["conv", "part", "seq", "piece", "state"])

        return work

    places = sizes.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "rows", "initials"))).alias("at"))
    parts = map_rows(audits.join(places, "conv"), make_pieces, "conv string, part int, seq int, piece string, state int")

    def make_lines():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in batch.itertuples(index=False):
                lines, _ = apply_edits(row.piece, row.state, zip(row.roles, row.texts, map(int, row.copies), strict=True))
                out.append((row.conv, row.part, row.seq, "\n".join(lines) if lines else None))
            return pd.DataFrame(out, columns=["conv", "part", "seq", "lines"])

        return work

    edited = blocks.select("conv", "part", "seq", "roles", "texts", "copies").join(parts, ["conv", "part", "seq"])
    lines = map_rows(edited, make_lines, "conv string, part int, seq int, lines string")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, running, begun = None, None, False
        for batch in batches:
            out = []
            for own, text in zip(batch["conv"], batch["lines"], strict=True):
                if own != conv:
                    if conv is not None:
                        out.append((conv, running.hexdigest()))
                    conv, running, begun = own, hashlib.sha256(), False
                if text is not None:
                    running.update((("\n" if begun else "") + text).encode())
                    begun = True
            if out:
                yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, running.hexdigest())], columns=["conv", "repaired_sha256"])

    return map_frames(lines.repartition("conv").sortWithinPartitions("conv", "part", "seq"), digests, "conv string, repaired_sha256 string")


def repair_conversations(
    conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS, fan: int = FAN
) -> DataFrame:
    """One row per conversation of ``conversations(conv_id, turn, role, text)`` after damage:

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A null
    role or text is one space, as are a null id and turn where the damage is drawn. Rows stand by
    turn, nulls first; rows of one turn by role and text as they are after damage; equal rows one
    after another, so all but the first are duplicates, unless blank. Rows with a null conv_id are
    one conversation. A conversation without rows after damage has zeros, an empty audit and the
    digest of nothing; an empty table gives no rows; further columns are ignored.
    """
    made = cut(in_blocks(damaged(conversations), block_rows, block_chars), "conversations")
    names = ["conv_id", *RESULT, "repaired_sha256"]
    blocks = made.where("part is not null")
    spans = cut(cells_of(blocks), "cells")

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in batch.itertuples(index=False):
                out.append((row.conv, *result(counts_in(row), unpacked(row.cells))))
            return pd.DataFrame(out, columns=["conv", *RESULT])

        return work

    tops = cut(map_rows(joined_spans(spans, fan), make, f"conv string, {RESULT_SCHEMA}"), "repaired")
    hashed = texts_hashed(blocks, tops.select("conv", "audit"), spans.select("conv", "part", "seq", "rows", "initials"))
    long = tops.join(hashed, "conv").withColumn("conv_id", F.expr("try_cast(conv AS bigint)")).select(names)
    return made.where("part is null").select(names).unionByName(long)
