"""Chat formatting: records of many layouts become turns, and turns become marked-up text.

A record's layout is known by a fingerprint, the hash of its nested field paths. Each known layout
has a declarative mapping to canonical turns (number, role, text). Turns are written with control
strings around them; the same strings inside a text are broken by a backslash, which can be undone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The template's own marks, and marks of other common templates that texts may hold.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (
    OPEN, BODY, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TRAINED_ROLE = "assistant"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# A mapping has its layout's paths and either ``each`` (the list of turns, and the fields of one) or
# ``turns`` (roles with the fields whose texts they join by an empty line; empty ones are passed over),
# or ``turn`` (the fields of a record that is one turn).
LAYOUTS = (
    {"name": "turn", "paths": ("role", "text", "turn"), "turn": ("turn", "role", "text")},
    {"name": "messages", "paths": ("messages[].content", "messages[].role"), "each": ("messages", "role", "content")},
    {"name": "shared", "paths": ("conversations[].from", "conversations[].value"), "each": ("conversations", "from", "value")},
    {"name": "prompt", "paths": ("prompt", "response"), "turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "completion", "paths": ("completion", "prompt"), "turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "system prompt", "paths": ("prompt", "response", "system"),
     "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "instruction", "paths": ("instruction", "output"), "turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"name": "instruction with input", "paths": ("input", "instruction", "output"),
     "turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "question", "paths": ("answer", "question"), "turns": (("user", ("question",)), ("assistant", ("answer",)))},
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of a record's leaves; every item of a list has the path of the list."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(layout["paths"]): layout for layout in LAYOUTS}
# Only paths that some mapping names make the fingerprint; a record may have any others besides.
NAMED = frozenset(p for layout in LAYOUTS for p in layout["paths"])
_LONE = re.compile("[\ud800-\udfff]")


def layout_of(record) -> dict | None:
    """The layout of a record, or None if it has none, or a turn number that is no whole number of 64 bits."""
    if not isinstance(record, dict):
        return None
    layout = MAPPINGS.get(fingerprint(field_paths(record) & NAMED))
    if layout and "turn" in layout:
        number = record[layout["turn"][0]]
        if number is not None and (type(number) is not int or not -(1 << 63) <= number < 1 << 63):
            return None
    return layout


def _text(value) -> str:
    """A text as it is, other values as JSON; halves of surrogate pairs cannot be written and are replaced."""
    return _LONE.sub("\ufffd", value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False))


def turns_of(record: dict, layout: dict) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of each turn of a record with a known layout."""
    if "turn" in layout:
        number, role, text = (record[f] for f in layout["turn"])
        return [(number, _text(role), _text(text))]
    if "each" in layout:
        items, role, text = layout["each"]
        return [(n, ROLE_NAMES.get(_text(x.get(role)), _text(x.get(role))), _text(x.get(text))) for n, x in enumerate(record[items])]
    parts = [(role, "\n\n".join(t for t in (_text(record[f]) for f in fields) if t)) for role, fields in layout["turns"]]
    return [(n, role, text) for n, (role, text) in enumerate(p for p in parts if p[1] or p[0] != "system")]


def turn_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): a JSON record for each row of a (conv_id, turn, role, text) table."""
    return conversations.select("conv_id", F.to_json(
        F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))


_TURNS = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("record", pa.string())])


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                record = json.loads(raw.as_py() or "")
                layout = layout_of(record)
                found = turns_of(record, layout) if layout else []
            except (ValueError, RecursionError):  # no JSON, numbers too long to read, or nested too deeply
                layout, found = None, []
            if not found:
                rows.append((conv_id, None, None, None, None, raw.as_py()))
            rows.extend((conv_id, layout["name"], *turn, None) for turn in found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TURNS)], schema=_TURNS)


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, layout, turn, role, text, record) from (conv_id, record) with JSON records.

    A layout is known by the paths its mapping names; other fields are passed over. A record that is no JSON object,
    is nested too deeply, has no layout, no turns, or a turn number that is no 64-bit integer, gives one row with
    nothing but its conv_id and the record (``unformatted``); for others record is null. Null roles and texts count as empty.
    """
    return records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")).mapInArrow(
        _canonical, "conv_id long, layout string, turn long, role string, text string, record string")


def unformatted(turns: DataFrame) -> DataFrame:
    """(conv_id, record) of the records that no mapping fits, as they came; ``formatted_turns`` has all others."""
    return turns.filter(F.col("layout").isNull()).select("conv_id", "record")


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of each control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    starts = "|".join(re.escape(c) for c in CONTROL)
    return F.regexp_replace(doubled, f"(?=(?:{starts}))(.)", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, chunk, loss_start, loss_end): each turn's part of its conversation's text.

    The chunks of a conversation by turn (ties by chunk) are its formatted text. The offsets (in code
    points of the chunk) bound what the loss is taken on: texts of the assistant; else they are null. Records
    without a layout are not in it, see ``unformatted``.
    """
    known = turns.filter(F.col("layout").isNotNull())
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(BODY))
    trained = F.col("role") == TRAINED_ROLE
    return known.select(
        "conv_id", "turn", head.alias("head"), text.alias("body"), trained.alias("trained"),
    ).select(
        "conv_id", "turn", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("chunk"),
        F.when(F.col("trained"), F.length("head")).alias("loss_start"),
        F.when(F.col("trained"), F.length("head") + F.length("body")).alias("loss_end"))


_CHUNK = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}\n", re.DOTALL)
_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose chunks come in order; only running digests are held."""
    now: dict | None = None

    def closed(c: dict) -> tuple:
        return c["id"], c["n"], c["turns"].hexdigest(), c["loss_chars"], c["loss"].hexdigest(), c["chars"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_READ)], schema=_READ)

    for batch in batches:
        done = []
        for conv_id, chunk, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now["id"] != conv_id:
                if now is not None:
                    done.append(closed(now))
                now = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            parts = _CHUNK.fullmatch(chunk)
            if parts is None:
                raise ValueError(f"conversation {conv_id}: no formatted turn: {chunk[:80]!r}")
            role, text = map(unescaped, parts.groups())
            now["n"] += 1
            now["chars"] += len(chunk)
            now["turns"].update(f"{role}\n{text}\n".encode())
            if start is not None:
                trained = unescaped(chunk[start:end])
                now["loss_chars"] += len(trained)
                now["loss"].update(trained.encode())
        yield batch_of(done)
    if now is not None:
        yield batch_of([closed(now)])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted text: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    A conversation is one running digest, so its chunks pass through one task in order, but they are
    streamed: memory does not grow with the conversation. Rows with a null conv_id are one conversation.
    """
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "chunk").select(
        "conv_id", "chunk", "loss_start", "loss_end").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
