import gzip
import io

from waymesh.llm import warc

PAGE = '<html><head><title>A &amp; b</title></head><body><nav>menu</nav><p>one<p>two <a href="/x y">x</a> <a href=\'http://o.example/\'>o</a><script>no</script></body></html>'


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, record string, block string")


def by_type(rows):
    return {(r.page_id, r.record_type): r for r in rows}


def test_links_headers_and_digests(spark):
    rows = [(1, "http://h.example/a/", PAGE), (2, None, None), (None, "", ""), (3, "http://h.example/long", "<p>word " * 100000)]
    responses = warc.responses_of_pages(pages_of(spark, rows)).collect()
    sources = {r.page_id: next(warc.read_records(io.BytesIO(r.record))) for r in responses}
    got = warc.derive(warc.responses_of_pages(pages_of(spark, rows))).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 8
    for row in got:
        source = sources[row.page_id]
        made = next(warc.read_records(io.BytesIO(row.record)))
        assert made.block == row.block.encode() and int(made.get("Content-Length")) == row.content_length == len(made.block)
        assert row.refers_to == made.get("WARC-Refers-To") == source.get("WARC-Record-ID")
        assert row.target_uri == source.get("WARC-Target-URI") and row.date == source.get("WARC-Date")
        assert row.block_digest == warc.digest(made.block) and row.payload_digest == source.get("WARC-Payload-Digest")
    meta = by_type(got)[1, "metadata"].block
    assert "source-header-content-type: text/html; charset=utf-8\r\n" in meta and "source-digest-check: ok\r\n" in meta
    assert "title: A & b\r\n" in meta and "outlink: http://h.example/x y\r\n" in meta and "outlink: http://o.example/\r\n" in meta
    assert by_type(got)[1, "conversion"].block == "menu\none\ntwo x o"
    assert by_type(got)[2, "conversion"].block == ""
    assert by_type(got)[3, "conversion"].block.split() == ["word"] * 100000


def test_round_trip_through_a_file(spark, tmp_path):
    responses = warc.responses_of_pages(pages_of(spark, [(1, "http://h.example/", PAGE), (2, "http://h.example/2", "<p>b")])).collect()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in responses))
    (tmp_path / "b.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + bytes(responses[0].record))
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.record) for r in read) == sorted([bytes(r.record) for r in responses] + [bytes(responses[0].record)])


def response(head, body):
    return warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], head.encode() + b"\r\n\r\n" + body)


def test_codings():
    html = "<p>café".encode("latin-1")
    packed = gzip.compress(html)
    chunked = b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip"
    meta, text = warc.derivatives(response(head, chunked))
    assert text.block.decode() == "café" and f"source-payload-digest: {warc.digest(packed)}" in meta.block.decode()
    assert warc.derivatives(response("HTTP/1.1 200 OK\r\nContent-Type: image/png", b"\x89PNG"))[1].block == b""
    assert warc.derivatives(response("HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=nope", b"a  b"))[1].block == b"a  b"
    wrong = response("HTTP/1.1 200 OK", b"<p>a")
    wrong.headers.append(("WARC-Payload-Digest", "sha1:NO"))
    assert b"source-digest-check: mismatch" in warc.derivatives(wrong)[0].block


def test_odd_records(spark):
    frame = spark.createDataFrame([(1, None), (2, b""), (2, b"junk"), (None, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab")], "page_id long, record binary")
    assert warc.derive(frame).count() == 8
    assert warc.derive(warc.responses_of_pages(pages_of(spark, []))).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = warc.derive(warc.responses_of_pages(pages)).collect()
    assert len(got) == 2 * pages.count() and all("source-digest-check: ok" in r.block for r in got if r.record_type == "metadata")


def test_malformed_lengths_links_bases_and_codings(spark):
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: abc\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<p>one\r\n\r\n"
    good = response("HTTP/1.1 200 OK", b"<p>two").to_bytes()
    read = list(warc.read_records(io.BytesIO(bad + good)))
    assert [r.sound for r in read] == [False, True] and read[1].block.endswith(b"<p>two")
    frame = spark.createDataFrame([(1, bad), (2, b"WARC/1.1\r\nContent-Length: -5\r\n\r\nx")], "page_id long, record binary")
    rows = by_type(warc.derive(frame).collect())
    assert rows[1, "conversion"].block == "one" and "source-header-check: no content length" in rows[1, "metadata"].block
    page = '<base href="/d/"><!-- <a href="c">--><a href="?a=1&amp;b=2">x</a><a data-href="n">y</a><script>"<a href=\'s\'>"</script><a href="?a=1&b=2">'
    assert warc.title_and_links(page, "http://h.example/a/b") == ("", ["http://h.example/d/?a=1&b=2"])
    meta, text = warc.derivatives(response("HTTP/1.1 200 OK\r\nContent-Encoding: br", b"\x0b\x02\x80<p>no"))
    assert text.block == b"" and b"source-coding-check: not decoded" in meta.block
    assert meta.get("WARC-Payload-Digest") == warc.digest(meta.block)
    deep = pages_of(spark, [(1, "u", "<div>" * 30_000 + "x"), (1, "u", "other")])
    got = warc.derive(warc.responses_of_pages(deep)).collect()
    assert sorted(r.block for r in got if r.record_type == "conversion") == ["other", "x"] and len({r.refers_to for r in got}) == 2
