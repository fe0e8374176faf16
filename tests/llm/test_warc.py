"""WARC derivatives: links, digests, kept headers, odd responses, files written and read again."""

import base64
import gzip
import hashlib
import html
import re
import time
from html.parser import HTMLParser

from tidemark.llm import queries, warc


def _sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Plain(HTMLParser):
    """Words of a page as the standard library's parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template", "svg", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template", "svg", "head") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_every_page_has_linked_records(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = queries.op2_warc(spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    by = {(r.refers_to, r.warc_type): r for r in rows}
    agree = 0
    for p in pages:
        refers = warc.record_name("page", str(p.page_id), p.url or "")
        meta, text = by[refers, "metadata"], by[refers, "conversion"]
        body = (p.html or "").encode()
        for r, other in ((meta, text), (text, meta)):
            head, _, block = r.record.partition("\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            assert fields["WARC-Refers-To"] == refers and fields["WARC-Concurrent-To"] == other.record_id
            assert fields["WARC-Block-Digest"] == _sha1(block.encode()) == r.block_digest
            assert int(fields["Content-Length"]) == len(block.encode()) == r.content_length
            assert r.source_payload_digest == _sha1(body) and fields["WARC-Target-URI"] == p.url
        assert "source-status: HTTP/1.1 200 OK" in meta.record and "source-header-content-type: text/html" in meta.record
        seen = _Plain()
        seen.feed(p.html or "")
        agree += "".join(seen.words) == "".join(text.record.partition("\r\n\r\n")[2].split())
    assert agree >= 0.95 * len(pages)


def test_odd_responses(spark):
    page = "<html><head><title>A &amp; B</title><script>x</script></head><body><p>One<br>two &lt;3</p><a href='/l?a=1&amp;b'>é</a></body></html>"
    squeezed = gzip.compress(page.encode("latin-1", "xmlcharrefreplace"))
    cases = [
        ("WARC-Type: request", b"GET /"), (None, None), ("", b""), ("WARC-Type: response\r\nWARC-Record-ID: <x>", b"just text"),
        ("WARC-Record-ID: <gz>", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + squeezed),
        ("WARC-Record-ID: <bad>", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nno gzip"),
        ("WARC-Record-ID: <img>", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"),
        ("WARC-Record-ID: <ch>\r\nWARC-Payload-Digest: sha1:OWN", b"HTTP/1.1 404 No\r\nTransfer-Encoding: chunked\r\nContent-Type: text/plain\r\n\r\n4\r\nab c\r\n2\r\nde\r\n0\r\n\r\n"),
    ]
    rows = warc.derivatives(spark.createDataFrame(cases, "headers string, block binary")).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.refers_to, {})[r.warc_type] = r
    block = lambda r: r.record.partition("\r\n\r\n")[2]
    assert block(kinds["<gz>"]["conversion"]) == "One\ntwo <3\né" and "title: A & B\r\n" in block(kinds["<gz>"]["metadata"])
    assert "outlink: /l?a=1&b\r\n" in block(kinds["<gz>"]["metadata"])
    assert set(kinds["<bad>"]) == set(kinds["<img>"]) == {"metadata"} and "error: " in block(kinds["<bad>"]["metadata"])
    assert block(kinds["<ch>"]["conversion"]) == "ab cde" and kinds["<ch>"]["metadata"].source_payload_digest == "sha1:OWN"
    assert block(kinds["<x>"]["conversion"]) == "just text" and len(kinds) == 6
    assert warc.derivatives(spark.createDataFrame([], "headers string, block binary")).count() == 0


def test_null_pages_and_files(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<p>x</p>\r\n\r\nWARC/1.1\r\n", 5), (2, None, None, 6), (None, "http://b/", "é " * 9000, 7), (1, "http://a/", "<p>x</p>", 8)],
        "page_id long, url string, html string, block long")
    made = warc.derivatives(warc.page_responses(pages))
    want = sorted((r.record_id, r.block_digest) for r in made.collect())
    assert len(want) == 8
    for codec in ("gzip", "none"):
        path = str(tmp_path / codec)
        warc.write_records(made, path, compression=codec)
        again = warc.read_records(spark, path).collect()
        named = [(dict(warc.header_lines(r.headers)), r.block) for r in again]
        assert sorted((h["WARC-Record-ID"], _sha1(bytes(b))) for h, b in named) == want
    assert html.unescape(re.sub("<[^>]*>", "", "<p>x</p>")) == warc.plain_text("<p>x</p>")


def test_open_heads_and_closed_svgs_keep_the_text(spark):
    pages = {
        "<html><head><title>t</title><body><p>text</p>": "text",
        "<head>\n<meta charset=utf-8><!-- <p> --><script>'<body><p>x'</script><title>t</title><link rel=a><h1>One</h1>two": "One\ntwo",
        "<head><title>a <b> c</title>first <b>words</b><p>text": "first words\ntext",
        "<head><title>t<body>text": "text",
        "<head><title>a</title><body><p>one</p><head><title>b</title></head><p>two</p>": "one\ntwo",
        "<head><script>'<body>'</script><title>t</title></head><body>text": "text",
        "<p>a</p><svg width='1' /><p>b</p><svg><path d='M0'/><text>no</text></svg><p>c</p>": "a\nb\nc",
        "<head><title>t</title></head><header>top</header><p>text</p>": "top\ntext",
    }
    for page, text in pages.items():
        assert warc.plain_text(page) == text
    frame = spark.createDataFrame([(i, f"http://{i}/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    made = warc.derivatives(warc.page_responses(frame)).filter("warc_type = 'conversion'").collect()
    assert sorted(r.record.partition("\r\n\r\n")[2] for r in made) == sorted(pages.values())


def test_unclosed_tags_take_linear_time():
    for part in ("<a ", "<title>", "<head ", "<head><title>", "<svg ", "<p ", "</p", "<!-- ", "<a href='", "<script", "<head><meta "):
        page = part * (1_000_000 // len(part))
        for text in (page, "<head>" + page, page + ">", "</title></head><body>" + page):
            start = time.process_time()
            warc.plain_text(text), warc.page_title(text), warc.page_links(text)
            assert time.process_time() - start < 1, part


def test_odd_charsets_and_chunks_end_no_job():
    for name in ("idna", "undefined", "punycode", "rot13", "hex", "utf-99", "latin-1", "unicode_escape", "utf-16"):
        for headers, body in (([("Content-Type", f"text/html; charset={name}")], b"<p>a\xff</p>"),
                              ([], b"<meta charset=" + name.encode() + b"><p>a\xff</p>")):
            text, charset, error = warc.decoded_body(headers, body)
            assert error == "" and (charset == name if name in ("latin-1", "utf-16") else charset == "utf-8" and "a\ufffd" in text)
    for body in (b"-5\r\nabc", b"+3\r\nabc", b"0x3\r\nabc", b"\r\nabc", b"3\r\nab", b"zz\r\n", b"3", b"99999999999999999999\r\nx"):
        text, _, error = warc.decoded_body([("Transfer-Encoding", "chunked")], body)
        assert error or text == "ab"


def _record(n, block):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{n}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_damaged_files_are_read_on(spark, tmp_path):
    blocks = [b"block %d " % n * 50 for n in range(6)]
    members = [gzip.compress(_record(n, b)) for n, b in enumerate(blocks)]
    hurt = bytearray(members[2])
    hurt[20:60] = b"\xff" * 40
    files = {
        "good.gz": b"".join(members), "one.gz": gzip.compress(b"".join(_record(n, b) for n, b in enumerate(blocks))),
        "hurt.gz": b"".join([*members[:2], bytes(hurt), *members[3:]]), "cut.gz": b"".join(members)[:-30], "plain": b"junk" + _record(0, blocks[0]),
        "short": _record(0, blocks[0])[:-80], "headless": b"WARC/1.1\r\nWARC-Type: response", "empty": b"", "tail.gz": members[0] + b"no member"}
    got = {}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows = warc.read_records(spark, str(tmp_path / name))
        got[name] = [(dict(warc.header_lines(r.headers)).get("WARC-Record-ID"), bytes(r.block), r.error) for r in rows.collect()]
        assert warc.derivatives(rows).count() >= sum(x[0] is not None for x in got[name])
    whole = [(f"<r{n}>", b, None) for n, b in enumerate(blocks)]
    assert got["good.gz"] == got["one.gz"] == whole and got["plain"] == whole[:1] and got["empty"] == []
    assert [x for x in got["hurt.gz"] if not x[2]] == whole[:2] + whole[3:] and sum(bool(x[2]) for x in got["hurt.gz"]) == 1
    assert [x for x in got["cut.gz"] if not x[2]] == whole[:5] and got["cut.gz"][-1][2]
    assert got["short"][0][0] == "<r0>" and got["short"][0][2] == "a record is cut off" and got["headless"][0][2]
    assert got["tail.gz"][0] == whole[0] and got["tail.gz"][1][2] == "no gzip member"


def test_many_members_take_linear_time():
    data = b"".join(gzip.compress(_record(n, b"x" * 2000), 1) for n in range(20_000))
    start = time.process_time()
    assert sum(1 for r in warc._records(warc._members(memoryview(data))) if not r[2]) == 20_000
    assert time.process_time() - start < 10
