import hashlib

from waymesh.llm import fingerprint as fp


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        edited = (text[: len(text) - quarter] + after[:quarter]).encode()
        own, changed, follows = fp.fingerprint(text.encode()), fp.fingerprint(edited), fp.fingerprint(after.encode())
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), changed.hex(), fp.likeness(own, changed), fp.likeness(own, follows)))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = fp.fingerprint_edits(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert sum(r.near_edited > r.near_next for r in got) > 0.99 * len(got)


def test_odd_rows(docs_of):
    cases = [[(5, None)], [(5, "abcdefgh")], [(1, ""), (2, "é" * 9), (None, "none"), (-4, "x" * 300), (2, "é" * 9), (2, "aa bb cc dd")]]
    cases.append([(i * i, f"text {i} " * (i % 5)) for i in range(60)] + [(10**17 + i, "big") for i in range(3)] + [(None, None), (None, "b")])
    cases.append([(1, "long word " * 150000), (2, "short")])
    for rows in cases:
        got = fp.fingerprint_edits(docs_of(rows)).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute(rows)))
    assert fp.fingerprint_edits(docs_of([])).count() == 0


def test_score_is_bounded():
    a, b, c = (fp.fingerprint(t.encode()) for t in ("the cat sat on the mat " * 20, "the cat sat on the rug " * 20, "0123456789" * 900))
    assert fp.difference(a, a) == 0 and fp.likeness(a, a) == 1.0
    assert fp.difference(a, b) == fp.difference(b, a) < fp.difference(a, c) <= fp.BOUND
    assert len(a) == 1 + fp.BUCKETS // 4
    long = bytes(range(256)) * 9000
    whole = fp.bucket_counts(long)
    assert whole.sum() == sum(len(long) - k for _, _, k in fp.TRIPLETS)
