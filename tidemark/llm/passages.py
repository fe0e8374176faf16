"""Windows of a fixed length that occur in more than one place, over all documents.

What the byte and the word operator share. Windows are keyed by their smallest gram hash, and
neighbouring windows with one key are one piece, so equal windows always meet under one key and only
keys seen at least twice are looked at. Pieces of one key are compared as text. Documents with equal
content are compared once: their copies repeat them whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.skew import join_by_key
from tidemark.session import checkpointed
from tidemark.streaming.runner import scratch_dir

# Keys with more pieces are compared by a digest of each window, as one task could not hold them.
KEY_PIECES = 4096
# Pieces (and their bytes) that are compared at once.
CHUNK_PIECES, CHUNK_BYTES = 20_000, 2 << 20


class Units:
    """How a text is cut: into the units windows are made of. See the subclasses."""

    window: int
    gram: int

    def content(self, text: bytes) -> bytes:
        raise NotImplementedError

    def runs(self, content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, windows) of the pieces of a content."""
        raise NotImplementedError

    def keys(self, content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, pieces, grams) of a content."""
        raise NotImplementedError

    def slicer(self, content: bytes) -> Callable[[int, int], bytes]:
        """A function that gives the text of units [start, end)."""
        raise NotImplementedError

    def size(self, content: bytes) -> int:
        raise NotImplementedError


def content_digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def document_key(doc_id: int | None, digest: bytes) -> bytes:
    return hashlib.blake2b(repr(doc_id).encode() + digest, digest_size=16).digest()


def row_key(doc_id: int | None, digest: bytes) -> int:
    """A never-null stand-in for the id; rows that share it only share the list of keys to look at."""
    return doc_id if doc_id is not None else int.from_bytes(digest[:8], "little", signed=True)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _mapped(docs: DataFrame, schema: str, of_batch: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """A frame of columns that ``of_batch`` gives as lists or arrays, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(of_batch(batch), types)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def _digests(docs: DataFrame, units: Units) -> DataFrame:
    def of(batch):
        out = [[], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            digest = content_digest(units.content(text.as_py()))
            for c, v in zip(out, (doc_id, document_key(doc_id, digest), row_key(doc_id, digest), digest)):
                c.append(v)
        return out

    return _mapped(_read(docs), "doc_id long, doc binary, row long, digest binary", of)


def _keys(docs: DataFrame, units: Units) -> DataFrame:
    """(key, row, pieces, grams) of each row."""
    def of(batch):
        parts = [[np.empty(0, np.int64)] for _ in range(4)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = units.content(text.as_py())
            key, pieces, grams = units.keys(content)
            row = row_key(doc_id, content_digest(content) if doc_id is None else b"")
            for part, v in zip(parts, (key, np.full(len(key), row, np.int64), pieces, grams)):
                part.append(v)
        return [np.concatenate(p) for p in parts]

    return _mapped(_read(docs), "key long, row long, pieces int, grams int", of)


def _packed(docs: DataFrame, units: Units) -> DataFrame:
    """Texts as they are shuffled: compressed content with the keys of its document."""
    def of(batch):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        out = [[], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = units.content(text.as_py())
            digest = content_digest(content)
            for c, v in zip(out, (doc_id, document_key(doc_id, digest), row_key(doc_id, digest), pack(content))):
                c.append(v)
        return out

    return _mapped(_read(docs), "doc_id long, doc binary, row long, packed binary", of)


def unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _copies(docs: DataFrame, units: Units) -> DataFrame:
    """(doc_id, doc, row, copies, first) of each row: rows with its content, and whether it is the first of them.

    First is the smallest doc_id, nulls before others.
    """
    rows = checkpointed(_digests(docs, units))
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "doc")).alias("least"))
    return checkpointed(join_by_key(rows, groups, ["digest"], F.col("doc"), sizes="copies").select(
        "doc_id", "doc", "row", "copies", (F.col("least.doc") == F.col("doc")).alias("first")))


def _recurring(docs: DataFrame, units: Units, copies: DataFrame) -> DataFrame:
    """(key, row, all_pieces): keys whose gram is there twice, among the first documents of each content."""
    def seen(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.groupBy("key").agg(
            F.sum("grams").alias("all_grams"), F.sum("pieces").alias("all_pieces"), F.count(F.lit(1)).alias("rows"),
        ).filter("all_grams > 1").drop("all_grams"))

    # Hashing all texts costs far more than writing their keys once and reading them twice.
    path = scratch_dir(docs.sparkSession, "all-keys")
    _keys(docs, units).write.parquet(path)
    keys = docs.sparkSession.read.schema("key long, row long, pieces int, grams int").parquet(path)
    met = join_by_key(keys, seen(keys).drop("all_pieces"), ["key"], F.col("row"), sizes="rows").drop("rows")
    firsts = copies.filter("first").select("row").distinct()
    path = scratch_dir(docs.sparkSession, "recurring-keys")
    met.join(firsts, "row", "left_semi").write.parquet(path)
    kept = docs.sparkSession.read.schema("key long, row long, pieces int, grams int").parquet(path)
    return join_by_key(kept, seen(kept), ["key"], F.col("row"), sizes="rows").select("key", "row", "all_pieces")


def _pieces(texts: DataFrame, units: Units) -> DataFrame:
    """(key, doc_id, doc, start, windows, piece, digest) of the pieces with a listed key.

    A window of a frequent key is a row of its own, with a digest in place of text, and a key that
    only spreads such rows.
    """
    def of_batch(batch):
        out = [[] for _ in range(7)]
        for doc_id, doc, packed, listed, frequent in zip(*(c.to_pylist() for c in batch.columns)):
            content = unpack(packed)
            keys, starts, counts = units.runs(content)
            often = np.isin(keys, np.array(frequent, np.int64))
            chosen = np.flatnonzero(often | np.isin(keys, np.array(listed, np.int64)))
            part = units.slicer(content)
            for at, key, start, count in zip(*(x[chosen].tolist() for x in (often, keys, starts, counts))):
                if at:
                    rows = []
                    for s in range(start, start + count):
                        digest = content_digest(part(s, s + units.window))
                        rows.append((int.from_bytes(digest[:4] + doc[:4], "little", signed=True), doc_id, doc, s, 1, None, digest))
                else:
                    rows = [(key, doc_id, doc, start, count, part(start, start + count + units.window - 1), None)]
                for row in rows:
                    for c, v in zip(out, row):
                        c.append(v)
        return out

    return _mapped(texts, "key long, doc_id long, doc binary, start long, windows long, piece binary, digest binary", of_batch)


Piece = tuple[int, int | None, bytes, int, int, bytes, None]
Compare = Callable[[list[Piece]], list[tuple[int, int, int]]]


def _in_chunks(compare: Compare):
    """Whole keys, as many as fit a chunk, go through ``compare``: (piece, from, to) runs of windows.

    Rows of single windows are passed on with their digest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Piece] = []
        size = 0

        def spans(rows):
            found = compare(rows) if rows else []
            return [(rows[i][1], rows[i][2], rows[i][3] + a, rows[i][3] + b, None) for i, a, b in found]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "doc", "begin", "end", "digest"])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[6] is not None:
                    out.append((row[1], row[2], row[3], row[3] + 1, row[6]))
                    continue
                if held and row[0] != held[-1][0] and (len(held) >= CHUNK_PIECES or size >= CHUNK_BYTES):
                    out += spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
            yield batch_of(out)
        yield batch_of(spans(held))

    return run


def repeated_windows(docs: DataFrame, units: Units, compare: Compare, *, first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """Two frames: (doc_id, doc, row, copies, first) of each row, and (doc, begin, end) runs of repeated windows.

    A window is repeated if its text starts anywhere else, or with ``first_stays`` if it starts earlier
    (in a smaller doc_id, or earlier in the document). The runs are those of the first document of
    each content; its copies are not listed.
    """
    copies = _copies(docs, units)
    frequent = F.col("all_pieces") > KEY_PIECES
    listed = _recurring(docs, units, copies).groupBy("row").agg(
        F.collect_list(F.when(~frequent, F.col("key"))).alias("keys"), F.collect_list(F.when(frequent, F.col("key"))).alias("frequent"))
    of_doc = copies.filter("first").select("row", "doc").distinct().join(listed, "row").drop("row")
    texts = _packed(docs, units).join(of_doc, "doc").dropDuplicates(["doc"]).select("doc_id", "doc", "packed", "keys", "frequent")
    found = checkpointed(_pieces(texts, units).repartition("key").sortWithinPartitions("key", "doc_id", "doc", "start").mapInArrow(
        _in_chunks(compare), "doc_id long, doc binary, begin long, end long, digest binary"))
    runs = found.filter(F.col("digest").isNull()).select("doc", "begin", "end")
    windows = found.filter(F.col("digest").isNotNull())
    least = windows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("doc_id", "doc", "begin")).alias("least")).filter("places > 1")
    again = join_by_key(windows, least, ["digest"], F.struct("doc", "begin"), sizes="places")
    if first_stays:
        again = again.filter((F.col("least.doc") != F.col("doc")) | (F.col("least.begin") != F.col("begin")))
    return copies, runs.unionByName(again.select("doc", "begin", "end"))


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal runs of half-open runs; touching ones are joined."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1])) if len(begins) else np.empty(0, bool)
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begins) - 1])) if len(begins) else np.empty(0, np.int64)
    return begins[new], ends[last]


def cut_documents(docs: DataFrame, units: Units, compare: Compare, schema: str,
                  finish: Callable[[bytes, np.ndarray, np.ndarray], tuple], *, first_stays: bool) -> DataFrame:
    """One row per row of ``docs``: doc_id and what ``finish`` makes of (content, begins, ends).

    begins and ends are the maximal runs of units to remove. A content with copies is removed whole in
    all of them (but for the first with ``first_stays``) if it is as long as a window.
    """
    copies, runs = repeated_windows(docs, units, compare, first_stays=first_stays)
    marks = runs.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    flags = copies.groupBy("doc").agg(F.max("copies").alias("copies"), F.max("first").alias("first")).join(marks, "doc", "left")
    rows = _packed(docs, units).join(flags, "doc").select(
        "doc_id", "packed", "copies", "first", "runs", F.row_number().over(W.partitionBy("doc").orderBy("doc_id")).alias("place"))

    def of(batch):
        out = []
        for doc_id, packed, n, first, runs, place in zip(*(c.to_pylist() for c in batch.columns)):
            content = unpack(packed)
            size = units.size(content)
            if n > 1 and size >= units.window and not (first_stays and first and place == 1):
                begins, ends = np.array([0]), np.array([size])
            else:
                begins = np.array([r["begin"] for r in runs or []], np.int64)
                ends = np.array([r["end"] for r in runs or []], np.int64) - 1 + units.window
                begins, ends = merged(begins, ends)
            out.append((doc_id, *finish(content, begins, ends)))
        return list(zip(*out)) if out else [[] for _ in schema.split(", ")]

    return _mapped(rows, schema, of)
