"""Byte-pair encoding by longest matches with backtracking, and decoding through an offset table.

A vocabulary file of the tokenizers library is only read, never trained. A piece of text is a string
of symbols (a byte, or a byte that ends a word). One pass of an Aho-Corasick automaton over the piece
gives the longest token from each place. Tokens are then taken greedily from the left; a neighbour is
accepted if no merge of lower rank would have crossed the border, else a shorter token is tried, else
the one before is given up. Places that cannot be completed are remembered, so the work is linear.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.carry import carried

PIECES_KEPT, PAIRS_KEPT = 200_000, 200_000
# Bytes of text that are encoded before results are handed on.
SLICE_BYTES = 1 << 20
# White space as the pattern's \s means it.
SPACE = "\t-\r \\x85\\xa0  -     　"
# Characters whose class and case have not changed between versions of Unicode in use; texts with
# others are split by the tokenizers library's own rules.
STEADY = "\x00-ɏΑ-ΡΣ-ωЀ-џ‐-‧‰-⁞₠-₿぀-ゔァ-ヺ一-龥"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Table:
    """Strings of bytes by number, held as one array with offsets."""

    def __init__(self, parts: list[bytes]):
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    @classmethod
    def of(cls, offsets: np.ndarray, data: np.ndarray) -> Table:
        made = cls.__new__(cls)
        made.offsets, made.data = offsets, data
        return made

    def join(self, numbers: np.ndarray) -> bytes:
        """The strings of ``numbers`` one after the other."""
        starts = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
        return self.data[at].tobytes()


class Recent(dict):
    """A cache of two generations: what is not asked for while ``size`` entries come goes."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.before = size, {}

    def __missing__(self, key):
        """An entry of the generation before is taken over; else None, which is not kept."""
        got = self.before.get(key)
        return got if got is None else self.put(key, got)

    def put(self, key, value):
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encode and decode with a BPE vocabulary whose tokens may carry a word-end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        if model["type"] != "BPE" or model["byte_fallback"] or not self.suffix:
            raise ValueError("a byte-level BPE vocabulary with word ends is needed")
        self.pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        symbols = byte_symbols()
        text = {vocab[c]: chr(b) for c, b in symbols.items()}
        text |= {vocab[c + self.suffix]: chr(256 + b) for c, b in symbols.items()}
        self.base = {s: token for token, s in text.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {token: -1 for token in text}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = token
            self.halves[token], self.rank[token] = (left, right), rank
            text[token] = text[left] + text[right]
        self.text = text
        self.lengths = {token: len(s) for token, s in text.items()}
        # A token that does not stand can be in no encoding, as parts of an encoding encode to themselves.
        self.by_text = by_text = {s: token for token, s in text.items() if self._stands(token)}
        self.shorter = {
            token: next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1)
            for s, token in by_text.items()}
        shown = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        size = max(shown) + 1
        self.shown = Table([shown.get(i, "").encode() + b" " for i in range(size)])
        self.digits = Table([b"%d " % i for i in range(size)])

    def _stands(self, token: int) -> bool:
        """Whether encoding a token's own text gives the token back."""
        if token not in self.halves:
            return True
        parts = [self.base[c] for c in self.text[token]]
        while len(parts) > 1:
            ranked = [(self.rank[self.pairs[p]], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pairs]
            if not ranked:
                return False
            at = min(ranked)[1]
            parts[at:at + 2] = [self.pairs[parts[at], parts[at + 1]]]
        return parts == [token]

    def plain(self) -> dict:
        """What the encoder is made of, without instances of this package's classes."""
        return {k: (v.offsets, v.data) if isinstance(v, Table) else v for k, v in self.__dict__.items() if not k.startswith("_")}

    @classmethod
    def of(cls, plain: dict) -> Encoder:
        made = cls.__new__(cls)
        for name, value in plain.items():
            setattr(made, name, Table.of(*value) if name in ("shown", "digits") else value)
        return made

    def _prepare(self) -> None:
        import ahocorasick
        import re
        import regex

        self._matches = ahocorasick.Automaton()
        for s, token in self.by_text.items():
            self._matches.add_word(s, (len(s) - 1, token))
        self._matches.make_automaton()
        self._split = regex.compile(self.pattern.replace("\\s", SPACE))
        self._unsteady = re.compile(f"[^{STEADY}]")
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fits: Recent[int, bool] = Recent(PAIRS_KEPT)
        self._pieces: Recent[str, list[int]] = Recent(PIECES_KEPT)

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: no merge across their border comes first.

        The later of the two border tokens is taken apart again and again; at each step a merge
        across the border that ranks before what was taken apart would have happened instead.
        """
        a, b, limit, rank = left, right, (1 << 60, 0), self.rank
        while True:
            across = self.pairs.get((a, b))
            if across is not None and (rank[across], 0) < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = (rank[a], 0), self.halves[a][1]
            else:  # equal merges run left to right, so the border's merge wins a tie against the right token
                limit, b = (rank[b], 1), self.halves[b][0]

    def piece(self, piece: str) -> list[int]:
        """Token ids of one piece: a run of characters that the pattern keeps together."""
        raw = piece.encode()
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        whole = self.by_text.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        longest = [-1] * n
        # Matches come by their ends, so the last one from a place is its longest.
        for end, (back, token) in self._matches.iter(symbols):
            longest[end - back] = token
        fits, lengths, shorter = self._fits, self.lengths, self.shorter
        closed: set[int] = set()
        out: list[int] = []
        pos, left, token = 0, -1, longest[0]
        while pos < n:
            end = pos + lengths[token]
            good = end not in closed
            if good and left >= 0:
                pair = left << 32 | token
                good = fits[pair]
                if good is None:
                    good = fits.put(pair, self.fits(left, token))
            if good:
                out.append(token)
                pos, left = end, token
                token = longest[pos] if pos < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(pos)
                token = out.pop()
                pos, left = pos - lengths[token], out[-1] if out else -1
        return out

    def _split_text(self, text: str) -> list[str]:
        import unicodedata

        if self._unsteady.search(text):
            from tokenizers import Regex, normalizers, pre_tokenizers

            steps = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
            split = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
            return [s for s, _ in split.pre_tokenize_str(steps.normalize_str(text))]
        return self._split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; strings of special tokens become their ids."""
        if not hasattr(self, "_matches"):
            self._prepare()
        ids: list[int] = []
        known = self._pieces
        for part in self._marks.split(text) if self._marks else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self._split_text(part):
                got = known[piece]
                if got is None:
                    got = self.piece(piece)
                    if len(piece) < 64:
                        known.put(piece, got)
                ids.extend(got)
        return np.array(ids, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens as the vocabulary writes them, with a space between."""
        return self.shown.join(ids)[:-1].decode()


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part holds about ``SLICE_BYTES`` of text (one row at least)."""
    for batch in batches:
        first, held = 0, 0
        for i, x in enumerate(batch.column(column)):
            held += len(x.as_buffer())
            if held >= SLICE_BYTES:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def _shared(docs: DataFrame, path: str):
    """A function that gives a task the encoder, built once in each worker from plain tables."""
    return carried(docs.sparkSession, Encoder(path).plain(), Encoder.of)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row: the ids of its whole text; a null or empty text has none."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            ids = [shared().encode(x.as_py()).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def token_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids (decimal ids joined by a space) for every row."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            ids = [shared().encode(x.as_py()) for x in batch.column(2)]
            texts = [shared().digits.join(x)[:-1].decode() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "source", "n_tokens", "token_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, token_ids string")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared().decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes within the task, so that ids are not carried from one worker to another.
    """
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = shared().encode(text.as_py())
                digits = shared().digits.join(ids)[:-1]
                decoded = shared().decode(ids).encode()
                rows.append({"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(digits).hexdigest(),
                             "decoded_sha256": hashlib.sha256(decoded).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
