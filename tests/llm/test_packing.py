import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from waymesh.llm import packing as pk


def ids_of(tokenizer, text):
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def check(rows, texts, size=pk.SEQUENCE):
    tokenizer = Tokenizer.from_file(pk.public_tokenizer())
    want = {}
    for doc_id, text in texts.items():
        ids = ids_of(tokenizer, text)
        for piece, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            want[doc_id, piece] = (at, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    gapless(rows, size)
    return -(-sum(v[1] for v in want.values()) // size)


def gapless(rows, size=pk.SEQUENCE):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pk.pack_documents(docs).collect()
    least = check(rows, texts)
    assert gapless(rows) <= least + 1


def test_odd_texts(docs_of):
    texts = {
        0: None, 1: "", 2: "word,", 3: "İstanbul, ΣΑΣ. don't DON'T x1y2 <|endoftext|> é a\tb c", 4: "word " * 30000,
        5: "x" * 20000, 6: "  \n\n  ", 7: "Thnd*** iner&&& ÉÈ! ét! ΟΔΟΣ",
    }
    rows = pk.pack_documents(docs_of(list(texts.items()))).collect()
    check(rows, texts)
    twice = pk.pack_documents(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(twice) == 3 and gapless(twice) == 1


def test_empty_table(docs_of):
    assert pk.pack_documents(docs_of([])).count() == 0


def test_search_empties_bins():
    rng = random.Random(5)
    for _ in range(20):
        packing = pk.Packing([rng.randint(1, 60) for _ in range(120)], 100)
        before = len(packing.bins)
        packing.improve()
        assert packing.least() <= len(packing.bins) <= before
        assert sorted(i for b in packing.bins for i in b.items) == list(range(120))
        assert all(b.fill == sum(packing.lengths[i] for i in b.items) <= 100 for b in packing.bins)
    spread = pk.Packing([1], 10)
    spread.lengths = [4, 3, 3, 5, 2, 3, 6, 4]
    spread.bins = [pk.Bin([0, 1], 7), pk.Bin([2, 3], 8), pk.Bin([4, 5], 5), pk.Bin([6, 7], 10)]
    spread.improve()
    assert len(spread.bins) == spread.least() == 3


def test_groups_meet_again(spark):
    rows = [(i, 0, 0, 10 + i * 7 % 40, i) for i in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pk.pack_pieces(pieces, 100, group_pieces=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert gapless(got, 100) <= 1.1 * sum(r[3] for r in rows) / 100


def test_groups_of_short_pieces_meet_again(spark):
    rows = [(i, 0, 0, 1 + i % 3, i) for i in range(16000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pk.pack_pieces(pieces, 1000, group_pieces=800).collect()
    assert sorted(r.doc_id for r in got) == list(range(16000))
    assert gapless(got, 1000) <= sum(r[3] for r in rows) // 1000 + 1
