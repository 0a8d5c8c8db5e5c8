"""Quartile bucket digests of texts, and how alike two digests are.

Byte triplets inside a window of five bytes are hashed into buckets; a bucket's code says which
quartile of the bucket counts it lies above. Codes and the logarithm of the length are the
fingerprint. Two fingerprints are compared by a difference score with an upper bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import bounded_batches, id_and_text, map_frames, map_rows

BUCKETS = 256
# Places of the triplets in a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Score for codes that differ by 0, 1, 2, 3; for each step of the length beyond the first; and at most.
CODE_SCORE = np.array([0, 1, 2, 6])
LENGTH_SCORE = 12
BOUND = 2 * BUCKETS
LENGTH_BASE = 1.1
#: Ranges of ids for every shuffle partition.
RANGES = 4


def bucket_counts(raw: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    data = np.frombuffer(raw, dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), 1 << 20):  # long texts in stretches that overlap by a window
        x = data[at : at + (1 << 20) + 4].astype(np.uint32)
        for salt, (i, j, k) in enumerate(TRIPLETS):
            n = min(len(x) - k, 1 << 20)
            if n > 0:
                h = x[i : i + n] | x[j : j + n] << np.uint32(8) | x[k : k + n] << np.uint32(16)
                h = (h ^ np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
                h = ((h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77)) >> np.uint32(24)
                counts += np.bincount(h, minlength=BUCKETS)
    return counts


def fingerprint(raw: bytes) -> bytes:
    """The length step, then two bits for each bucket, lowest bucket first."""
    counts = bucket_counts(raw)
    ordered = np.sort(counts)
    quarter = BUCKETS // 4
    codes = sum((counts > ordered[q * quarter - 1]).astype(np.uint8) for q in (1, 2, 3))
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    step = min(255, int(math.log(len(raw) + 1) / math.log(LENGTH_BASE)))
    return bytes([step]) + packed.tobytes()


def codes_of(print_: bytes) -> np.ndarray:
    packed = np.frombuffer(print_, dtype=np.uint8, offset=1)
    return np.stack([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=1).ravel().astype(np.int8)


def difference(a: bytes, b: bytes) -> int:
    """0 for equal fingerprints, ``BOUND`` at most."""
    steps = abs(a[0] - b[0])
    score = int(CODE_SCORE[np.abs(codes_of(a) - codes_of(b))].sum()) + LENGTH_SCORE * max(0, steps - 1) + (steps > 0)
    return min(BOUND, score)


def likeness(a: bytes, b: bytes) -> float:
    return 1 - difference(a, b) / BOUND


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (hex); a null text counts as empty."""

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [fingerprint((t or "").encode()).hex() for t in batch["text"]]})

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, fingerprint string")


def with_next(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` dealt into ranges of ids, every range with a look at what comes after.

    Gives ``doc_id, text, ord, range, ahead``; rows with ``ahead`` are the first of the next
    range (of the first range after the last). A range starts at an id that exists, so the
    row to look at is known without another pass.
    """
    spark = texts.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63))))
    least, cuts = ordered.agg(
        F.min("ord"), F.percentile_approx("ord", [i / ranges for i in range(1, ranges)], 20 * ranges)
    ).first()
    starts = np.array(sorted({least, *(cuts or [])} - {None}), dtype=np.int64)

    def deal(batches):
        for batch in batches:
            own = batch.column("ord").to_numpy(zero_copy_only=False)
            place = np.searchsorted(starts, own, side="right") - 1
            first = np.flatnonzero(starts[place] == own) if len(own) else np.zeros(0, dtype=np.int64)
            for rows, range_, ahead in ((None, place, False), (first, (place[first] - 1) % max(1, len(starts)), True)):
                part = batch if rows is None else batch.take(pa.array(rows))
                columns = [*part.columns, pa.array(range_, pa.int32()), pa.array(np.full(len(range_), ahead))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "ord", "range", "ahead"])

    bounded_batches(spark)
    dealt = ordered.select("doc_id", "text", "ord").mapInArrow(deal, "doc_id long, text string, ord long, range int, ahead boolean")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "ord", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. The edited form ends with the beginning of the
    next document by id. Null texts count as empty. Rows of equal id follow one another by text;
    null ids come first; an only row follows itself. An empty table gives no rows; further
    columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # range, id, text, fingerprint of the row that waits for its next
        for batch in batches:
            out = []
            ids = batch["doc_id"].to_numpy(dtype=object)
            for doc_id, text, range_, ahead in zip(ids, batch["text"], batch["range"], batch["ahead"], strict=True):
                if ahead and (held is None or held[0] != range_):
                    continue
                text = text or ""
                print_ = fingerprint(text.encode())
                if held is not None and held[0] == range_:
                    _, own_id, own, own_print = held
                    quarter = len(own) // 4
                    edited = (own[: len(own) - quarter] + text[:quarter]).encode()
                    edited_print = fingerprint(edited)
                    out.append(
                        (own_id, len(own), hashlib.sha256(edited).hexdigest(), own_print.hex(), edited_print.hex(), likeness(own_print, edited_print), likeness(own_print, print_))
                    )
                held = None if ahead else (range_, doc_id, text, print_)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_frames(with_next(id_and_text(docs, id_col, text_col)), run, schema)
