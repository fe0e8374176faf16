"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Both name the response in WARC-Refers-To, keep its URI, date and digests, and name each other in
WARC-Concurrent-To; the metadata block keeps the HTTP status and headers. Records are built row by
row, so nothing is shuffled. As a record ends with two line ends, Spark's text writer with that
separator writes WARC files.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Where a page's own character set is looked for, as browsers do; and the bytes of a file that are held at once.
META_BYTES, PIECE_BYTES = 4096, 1 << 20
VERSION, END = "WARC/1.1", "\r\n\r\n"
UNDATED = "1970-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--|<(head|svg|script|style|noscript|template)\b", re.I)
_HIDDEN_ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("svg", "script", "style", "noscript", "template")}
_HEAD_END = re.compile(r"(</head\s*>)|<body\b", re.I)
_HEAD_START = re.compile(r"<head\b", re.I)
_HEAD_PART = re.compile(r"\s+|</?(?:meta|link|base)\b[^>]*>|(<title\b[^>]*>)", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|section|article|header|footer|nav|aside|main|h[1-6]|pre|blockquote|form|title|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_TITLE_START = re.compile(r"<title(?=[\s/>])", re.I)
_LINK_START = re.compile(r"<a(?=[\s/>])", re.I)
_HREF = re.compile(r"""(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CHARSET = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?([\w-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts: str) -> str:
    """A record id that is the same each time it is derived from the same parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+\s*", " ", value).strip()


def record_text(headers: list[tuple[str, str]], block: str) -> str:
    """A record without its closing line ends."""
    return "\r\n".join([VERSION, *(f"{k}: {one_line(v)}" for k, v in headers if v)]) + END + block


def header_lines(raw: str) -> list[tuple[str, str]]:
    """Names and values; folded lines continue the one before, lines without a colon are passed over."""
    lines = re.sub(r"\r?\n[ \t]+", " ", raw).splitlines()
    return [(k.strip(), v.strip()) for k, c, v in (line.partition(":") for line in lines) if c]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; a block without a status line is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    parts = re.split(rb"\r?\n\r?\n", block, maxsplit=1)
    first, _, rest = parts[0].decode("latin-1").partition("\n")
    return first.strip(), header_lines(rest), parts[1] if len(parts) > 1 else b""


def _unchunked(body: bytes) -> bytes:
    """The body of its chunks; a size that is no plain hexadecimal number is an error."""
    out, at = [], 0
    while at < len(body):
        end = body.index(b"\n", at)
        digits = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,16}", digits):
            raise ValueError(f"chunk size {digits[:20]!r}")
        size = int(digits, 16)
        if not size:
            break
        out.append(body[end + 1:end + 1 + size])
        at = end + 1 + size + (2 if body[end + 1 + size:end + 3 + size] == b"\r\n" else 1)
    return b"".join(out)


def _text_codec(name: str) -> str | None:
    """The name if it is a character set that text can be read in; codecs for other ends, and unknown names, are none."""
    try:
        info = codecs.lookup(name)
    except (LookupError, ValueError):
        return None
    return name if info._is_text_encoding and info.name.replace("-", "_") not in ("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape") else None


def decoded_body(headers: list[tuple[str, str]], body: bytes) -> tuple[str, str, str]:
    """(text, charset, error) of a body after its transfer and content codings.

    The character set is the header's, else that of a ``<meta>`` in the first ``META_BYTES``, else UTF-8; one that
    is unknown, or no character set of text, counts as UTF-8. Bytes that cannot be read are replaced.
    """
    named = {k.lower(): v for k, v in headers}
    try:
        if "chunked" in named.get("transfer-encoding", "").lower():
            body = _unchunked(body)
        coding = named.get("content-encoding", "").lower()
        if coding in ("gzip", "x-gzip", "deflate"):
            body = zlib.decompressobj(47).decompress(body)
        elif coding not in ("", "identity"):
            return "", "", f"content coding {coding}"
    except (ValueError, zlib.error) as problem:
        return "", "", one_line(str(problem))
    found = re.search(r"charset\s*=\s*[\"']?([\w-]+)", named.get("content-type", ""), re.I)
    inside = _CHARSET.search(body[:META_BYTES])
    asked = (found[1] if found else inside[1].decode("ascii", "replace") if inside else "utf-8").lower()
    charset = _text_codec(asked) or "utf-8"
    try:
        return body.decode(charset, "replace"), charset, ""
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace"), "utf-8", ""


def _tags(text: str, start: re.Pattern) -> Iterator[str]:
    """What stands in each of a kind of tags, in one pass; a tag that is never closed ends the search."""
    at = 0
    while (found := start.search(text, at)) is not None:
        at = text.find(">", found.end())
        if at < 0:
            return
        yield text[found.end():at]


def page_title(text: str) -> str:
    start = _TITLE_START.search(text)
    begin = text.find(">", start.end()) if start else -1
    end = _TITLE_END.search(text, begin) if begin >= 0 else None
    return " ".join(html.unescape(text[begin + 1:end.start()]).split()) if end else ""


def page_links(text: str) -> list[str]:
    found = (_HREF.search(tag) for tag in _tags(text, _LINK_START))
    return [html.unescape(next(filter(None, m.groups()), "")) for m in found if m]


class _Ahead:
    """The next match of a pattern from places that only move on; each stretch of text is searched once."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.found, self.at = pattern, text, None, -1

    def after(self, place: int) -> re.Match | None:
        if self.at < 0 or self.found is not None and self.found.start() < place:
            self.found, self.at = self.pattern.search(self.text, place), place
        return self.found


def _without_hidden(text: str) -> str:
    """Comments, scripts, styles and closed heads replaced by a blank; what is not closed goes to the end, heads do not."""
    out, kept, at = [], 0, 0
    heads = _Ahead(_HEAD_END, text)
    while (found := _HIDDEN.search(text, at)) is not None:
        name, begin = (found[1] or "").lower(), found.start()
        if not name:
            end = text.find("-->", begin + 4)
            end = len(text) if end < 0 else end + 3
        elif name == "head":
            close = heads.after(found.end())
            if close is None or close[1] is None:
                at = found.end()
                continue
            end = close.end()
        else:
            tag = text.find(">", found.end())
            if name == "svg" and tag > 0 and text[tag - 1] == "/":
                end = tag + 1
            else:
                close = _HIDDEN_ENDS[name].search(text, found.end())
                end = close.end() if close else len(text)
        out += (text[kept:begin], " ")
        kept = at = end
    return "".join(out) + text[kept:]


def _without_open_heads(text: str) -> str:
    """A head without end tag ends before the first thing that cannot be in a head."""
    out, kept, last = [], 0, text.rfind(">")
    titles = _Ahead(_TITLE_END, text)
    while (found := _HEAD_START.search(text, kept)) is not None and found.end() <= last:
        at = text.find(">", found.end()) + 1
        while at <= last and (part := _HEAD_PART.match(text, at)) is not None:
            at = part.end()
            if part[1] is not None:
                close = titles.after(at)
                after = text.find("<", at)
                at = close.end() if close else len(text) if after < 0 else after
        out += (text[kept:found.start()], " ")
        kept = at
    return "".join(out) + text[kept:]


def plain_text(markup: str) -> str:
    """The text of a page, a line for each block; scripts, styles, comments and the head are left out."""
    text = _without_open_heads(_without_hidden(markup))
    # Behind the last ">" there are no tags, so that unclosed ones are not looked for again and again.
    last = text.rfind(">") + 1
    text = _TAG.sub("", _BLOCK.sub("\n", text[:last])) + text[last:]
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


_OUT = pa.schema([(n, pa.string()) for n in (
    "record_id", "warc_type", "refers_to", "target_uri", "content_type", "block_digest", "source_block_digest",
    "source_payload_digest", "record")] + [("content_length", pa.int64())])


def derive(source: list[tuple[str, str]], block: bytes, damage: str = "") -> list[dict]:
    """The metadata record, and the conversion record if the response holds text; ``damage`` is noted as an error."""
    named = {k.lower(): v for k, v in source}
    status, headers, body = http_parts(block)
    block_digest = named.get("warc-block-digest") or digest(block)
    payload_digest = named.get("warc-payload-digest") or digest(body)
    refers = named.get("warc-record-id") or record_name("response", block_digest)
    uri, date = named.get("warc-target-uri", ""), named.get("warc-date") or UNDATED
    kind = {k.lower(): v for k, v in headers}.get("content-type", "").split(";")[0].strip().lower()
    text, charset, error = decoded_body(headers, body)
    markup = kind in ("", "text/html", "application/xhtml+xml")
    readable = not error and (markup or kind.startswith("text/"))
    ids = {k: record_name(k, refers) for k in ("metadata", "conversion")}

    fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers),
              ("source-content-length", str(len(block))), ("source-block-digest", block_digest),
              ("source-payload-digest", payload_digest), ("charset", charset), ("error", error or damage)]
    if readable and markup:
        fields.append(("title", page_title(text)))
        fields += [("outlink", link) for link in page_links(text)]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields if v), "conversion" if readable else "")]
    if readable:
        made.append(("conversion", "text/plain; charset=utf-8", plain_text(text) if markup else text, "metadata"))
    out = []
    for name, content_type, content, beside in made:
        data = content.encode("utf-8", "replace")
        head = [
            ("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", ids.get(beside, "")), ("Content-Type", content_type),
            ("WARC-Block-Digest", digest(data)), ("WARC-Source-Block-Digest", block_digest),
            ("WARC-Source-Payload-Digest", payload_digest), ("Content-Length", str(len(data)))]
        out.append({
            "record_id": ids[name], "warc_type": name, "refers_to": refers, "target_uri": uri, "content_type": content_type,
            "block_digest": digest(data), "source_block_digest": block_digest, "source_payload_digest": payload_digest,
            "record": record_text(head, data.decode()), "content_length": len(data)})
    return out


def page_responses(pages: DataFrame, *, date: str = UNDATED) -> DataFrame:
    """(headers, block) response records of a (page_id, url, html) table; a null page is an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, blocks = [], []
            for page_id, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = body.as_py() or b""
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body)
                head = [("WARC-Type", "response"), ("WARC-Record-ID", record_name("page", str(page_id), url or "")),
                        ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"),
                        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)), ("Content-Length", str(len(block)))]
                heads.append("\r\n".join(f"{k}: {one_line(v)}" for k, v in head if v))
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["headers", "block"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("binary")).mapInArrow(run, "headers string, block binary")


def _members(data: memoryview) -> Iterator[tuple[bytes, str]]:
    """Pieces of a file's content with an error or none; gzip members are read by a moving offset, one after the other."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from ((bytes(data[at:at + PIECE_BYTES]), "") for at in range(0, len(data), PIECE_BYTES))
        return
    at, member = 0, None
    while at < len(data):
        if member is None:
            if bytes(data[at:at + 2]) != b"\x1f\x8b":
                yield b"", "no gzip member"
                return
            member = zlib.decompressobj(31)
        piece = data[at:at + PIECE_BYTES]
        at += len(piece)
        try:
            while True:
                got = member.decompress(piece, PIECE_BYTES)
                if got:
                    yield got, ""
                piece = member.unconsumed_tail
                if not piece and (not got or len(got) < PIECE_BYTES):
                    break
        except zlib.error as problem:
            # What follows a damaged member is taken up at the next one.
            yield b"", one_line(str(problem))
            at = _next_member(data, at - len(piece) + 1)
            member = None
            continue
        if member.eof:
            at -= len(member.unused_data)
            member = None
    if member is not None:
        yield b"", "the last gzip member is cut off"


def _next_member(data: memoryview, at: int) -> int:
    for start in range(at, len(data), PIECE_BYTES):
        found = bytes(data[start:start + PIECE_BYTES + 2]).find(b"\x1f\x8b\x08")
        if found >= 0:
            return start + found
    return len(data)


def _records(pieces: Iterator[tuple[bytes, str]]) -> Iterator[tuple[str, bytes, str]]:
    """(headers, block, error) of each record; no more than one record and one piece are held."""
    held, problem = bytearray(), ""
    ended = False

    def more(wanted: int) -> None:
        nonlocal problem, ended
        while len(held) < wanted and not ended and not problem:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                held.extend(piece[0])
                problem = problem or piece[1]

    while True:
        more(PIECE_BYTES)
        start = held.find(b"WARC/")
        if start < 0:
            if problem:
                yield "", b"", problem
                held.clear()
                problem = ""
                continue
            if ended:
                return
            del held[:max(0, len(held) - 4)]
            more(len(held) + 1)
            continue
        del held[:start]
        more(PIECE_BYTES)
        end = held.find(b"\r\n\r\n")
        if end < 0:
            # Headers that do not end within a piece are no record; reading goes on behind its version line.
            yield "", b"", problem or "a record's headers do not end"
            del held[:5]
            problem = ""
            continue
        raw = held[:end].decode("utf-8", "replace").partition("\r\n")[2]
        size = dict((k.lower(), v) for k, v in header_lines(raw)).get("content-length", "0")
        wanted = end + 4 + (int(size) if re.fullmatch("[0-9]{1,15}", size) else 0)
        more(wanted)
        block = bytes(held[end + 4:wanted])
        missing = wanted - end - 4 - len(block)
        yield raw, block, (problem or "a record is cut off") if missing else ""
        if missing and problem:
            problem = ""
        del held[:wanted]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block, error) of the records in WARC files, plain or gzip, one task a file.

    A record is cut by its Content-Length; what does not begin with a version line is skipped to the next one.
    A damaged or cut-off part gives a row with ``error`` (and what there is of its record), and reading goes on
    behind it. Files are read by Spark as one value each, so at most 2 GB; besides the file one record is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] or None for r in rows], pa.string())], ["headers", "block", "error"])

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in _records(_members(memoryview(content.as_buffer()))):
                    rows.append(row)
                    size += len(row[1])
                    if size >= PIECE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers string, block binary, error string")


def derivatives(records: DataFrame) -> DataFrame:
    """Derivative records of (headers, block) records; those that are no responses are passed over.

    Columns: record_id, warc_type, refers_to, target_uri, content_type, block_digest, source_block_digest,
    source_payload_digest, record (the whole record as text), content_length. Every response gives a
    metadata record; a conversion follows if its body is HTML or other text that can be decoded. Digests
    are the source's own where it has them. An ``error`` of a record (``read_records``) is noted in its metadata; a damaged
    part of a file that is no record is passed over. Null headers count as those of a response, null blocks as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, block, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                source = header_lines(raw or "")
                if error and not source:
                    continue
                if next((v for k, v in source if k.lower() == "warc-type"), "response").lower() == "response":
                    rows += derive(source, block.as_py() or b"", error or "")
            yield pa.RecordBatch.from_pylist(rows, _OUT)

    error = F.col("error") if "error" in records.columns else F.lit(None)
    return records.select(F.col("headers").cast("string"), F.col("block").cast("binary"), error.cast("string").alias("error")).mapInArrow(
        run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _OUT))


def write_records(records: DataFrame, path: str, *, compression: str = "gzip") -> None:
    """Write the ``record`` column as WARC files."""
    records.select(F.col("record").alias("value")).write.option("lineSep", END).option("compression", compression).text(path)
