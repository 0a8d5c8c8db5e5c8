"""Best-fit packing of tokenised documents into sequences, improved by local search.

Documents are cut into pieces of at most one sequence. Pieces are dealt into groups of bounded
size, packed best fit, and improved by exchanges that raise the sum of squared fills until
bins fall empty. What underfull bins hold is dealt again into fewer groups, down to one, so a
group's rest is not wasted.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import id_and_text, map_rows, sorted_groups
from waymesh.session import cut

SEQUENCE = 4096
END_ID = 1
#: Pieces in a group: what one task packs at a time.
GROUP_PIECES = 8192
#: Groups whose underfull bins meet again in one group.
FAN_IN = 32
#: Bins less full than this share may be opened again in the next round, the least full first,
#: as many as leave the groups of that round no larger, but always one.
OPEN_BELOW = 15 / 16
#: How many of the least filled bins one pass of the search tries to empty.
TRIED_BINS = 8
REMEMBERED = 700_000
LONGEST_REMEMBERED = 48
# Fixed value: marks that the tokenizer parts from letters before them.
MARKS = ".,;:!?*&$%#|"


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Byte-level tokenizers write every byte as a letter of its own: printable ones as themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = str.maketrans({chr(b): chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)})


def byte_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def is_plain(word: str) -> bool:
    """Whether ``word`` is one run of lower-case Latin letters in composed form."""
    if not word.isalpha() or word != word.lower():
        return False
    return word.isascii() or max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)


class ChunkIds(dict):
    """Stretches between blanks -> their ids as little-endian bytes.

    The tokenizer drops white space and never merges across it, nor between a letter and a
    punctuation mark, so the ids of a text are those of its stretches in a row, and those of a
    stretch "word," are those of the word in lower case and of the mark. Each is encoded once.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def encode(self, chunk: str) -> bytes:
        if is_plain(chunk):  # nothing to normalise or split: the merges alone, in a quarter of the time
            ids = [token.id for token in self.model.tokenize(chunk if chunk.isascii() else byte_letters(chunk))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        lower = word.lower()
        if not chunk:
            ids = b""
        elif lower != chunk and word.isalpha() and len(lower) == len(word) and "Σ" not in word:
            ids = self[lower] + self[chunk[len(word) :]]
        else:
            ids = self.encode(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            self[chunk] = ids
        return ids

    def document(self, text: str | None) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""
        return ids + END_ID.to_bytes(4, "little")


_ready: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The encoder of this Python worker, kept from task to task."""
    if path not in _ready:
        _ready[path] = ChunkIds(path)
    return _ready[path]


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for every piece of every row of ``docs``."""

    def make():
        chunks = chunk_ids(tokenizer)

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_numpy(dtype=object), batch["text"], strict=True):
                ids = chunks.document(text)
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)

        return work

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_rows(id_and_text(docs, id_col, text_col), make, schema)


@dataclass
class Bin:
    """Numbers of the pieces in a bin, and their lengths together."""

    items: list[int] = field(default_factory=list)
    fill: int = 0


class Packing:
    """Bins for pieces of given lengths."""

    def __init__(self, lengths: list[int], size: int = SEQUENCE):
        self.lengths = lengths
        self.size = size
        self.bins: list[Bin] = []
        self._best_fit()

    def _best_fit(self) -> None:
        """Longest piece first, each into the fullest bin that still takes it."""
        by_room: list[list[int]] = [[] for _ in range(self.size + 1)]
        rooms = 0  # bit r is set if some bin has room r
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            need = self.lengths[i]
            fitting = rooms >> need
            if fitting:
                room = need + (fitting & -fitting).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, at = self.size, len(self.bins)
                self.bins.append(Bin())
            self.bins[at].items.append(i)
            self.bins[at].fill += need
            left = room - need
            by_room[left].append(at)
            rooms |= 1 << left

    def least(self) -> int:
        """No packing has fewer bins."""
        return -(-sum(self.lengths) // self.size)

    def improve(self) -> None:
        """Exchanges until bins are as few as possible or none of the least filled can give more."""
        while len(self.bins) > self.least():
            self.bins.sort(key=lambda b: b.fill)
            gave = False
            for giver in self.bins[:TRIED_BINS]:
                while giver.items and self._give(giver):
                    gave = True
                if not giver.items:
                    break
            self.bins = [b for b in self.bins if b.items]
            if not gave:
                return

    def _give(self, giver: Bin) -> bool:
        """Shift length from ``giver`` to a bin at least as full, which raises the sum of squares."""
        moved = False
        for taker in self.bins:
            room = self.size - taker.fill
            if taker is giver or not room or not taker.items or taker.fill < giver.fill:
                continue
            found = self._exchange(giver, taker, room)
            if found:
                out, back = found
                shift = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
                giver.items = [i for i in giver.items if i not in out] + list(back)
                taker.items = [i for i in taker.items if i not in back] + list(out)
                giver.fill -= shift
                taker.fill += shift
                moved = True
                if not giver.items:
                    break
        return moved

    def _exchange(self, giver: Bin, taker: Bin, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The move, one-for-one or two-for-one exchange that fills ``taker`` most."""
        size = self.lengths
        outs = [(i,) for i in giver.items] + [(i, j) for n, i in enumerate(giver.items) for j in giver.items[:n]]
        backs = [()] + [(i,) for i in taker.items] + [(i, j) for n, i in enumerate(taker.items) for j in taker.items[:n]]
        best, found = 0, None
        for out in outs:
            given = sum(size[i] for i in out)
            for back in backs:
                if len(out) == len(back) == 2:
                    continue
                shift = given - sum(size[i] for i in back)
                if best < shift <= room:
                    best, found = shift, (out, back)
                    if shift == room:
                        return found
        return found


def packer(size: int, number: int, opened: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the pieces of one group and marks at most ``opened`` pieces of underfull bins as open.

    The least full bin is opened whatever it holds, unless ``opened`` is 0. ``number`` is the round, part of the sequence's number.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        packing = Packing(rows["length"].tolist(), size)
        packing.improve()
        sequence = np.zeros(len(rows), dtype=np.int64)
        offset = np.zeros(len(rows), dtype=np.int64)
        again = np.zeros(len(rows), dtype=bool)
        first = (number << 58) + (int(rows["group"].iloc[0]) << 24)
        left = opened
        for b, held in enumerate(sorted(packing.bins, key=lambda x: x.fill)):
            if opened and held.fill < size * OPEN_BELOW and (b == 0 or len(held.items) <= left):
                left -= len(held.items)
                again[held.items] = True
            at = 0
            for i in held.items:
                sequence[i], offset[i] = first + b, at
                at += packing.lengths[i]
        return rows.drop(columns="group").assign(sequence_id=sequence, offset=offset, again=again)

    return work


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (as :func:`cut_pieces` gives them, written) with ``sequence_id`` and ``offset``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean"
    whole = pieces.where(F.col("length") == size).select(
        *COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done = [whole]
    rest = pieces.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group_pieces))
    number = 0
    while True:
        dealt = rest.select(*COLUMNS, F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("group"))
        opened = group_pieces // FAN_IN if groups > 1 else 0
        packed = cut(sorted_groups(dealt, "group", packer(size, number, opened), schema), "packed")
        done.append(packed.where("not again").drop("again"))
        if groups == 1:
            break
        rest = packed.where("again")
        # Bins of many short pieces hand on more than a share; half the groups hold what any bins do.
        groups = max(1, min(-(-rest.count() // group_pieces), -(-groups // 2)))
        number += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file. A null text is packed as an empty one: its
    end id alone. Repeated rows and null ids are packed like any other; an empty table gives no
    rows; further columns are ignored.
    """
    pieces = cut(cut_pieces(docs, tokenizer or public_tokenizer(), size, id_col, text_col), "pieces")
    return pack_pieces(pieces, size)
