"""Chat records of odd layouts: none is lost, none ends the job."""

import json

import pytest

from tidemark.llm import chat

SAY = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]
KNOWN = [
    {"messages": SAY, "id": 7, "meta": {"source": "x", "tags": []}},
    {"messages": [m | {"name": "n", "weight": 1.5} for m in SAY]},
    {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho", "extra": None}], "split": "train"},
    {"prompt": "hi", "response": "ho", "score": [1, 2]},
    {"turn": None, "role": "user", "text": "\ud800 half", "source": "s"},
    {"messages": [{"role": "user"}, {"role": "assistant", "content": {}}]},
]
UNKNOWN = [
    {"messages": []}, {"messages": ["hi"]}, {"messages": [], "turn": 1}, {"turn": "1", "role": "user", "text": "x"},
    {"turn": 1 << 64, "role": "user", "text": "x"}, {"turn": True, "role": "user", "text": "x"}, {"turn": 1.5, "role": "user", "text": "x"},
    {"messages": SAY, "prompt": "and more"}, {"something": "else"}, {}, [], "text", None, 5,
]
RAW = ["", "{", "[" * 100_000, '{"a":' * 100_000 + "1" + "}" * 100_000, '{"turn": ' + "9" * 5000 + ', "role": "user", "text": "x"}']


@pytest.fixture(scope="module")
def turns(spark):
    records = [json.dumps(r) for r in KNOWN + UNKNOWN] + RAW + [None]
    return chat.canonical_turns(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).cache()


def test_every_record_is_formatted_or_returned(turns):
    formatted = {r.conv_id for r in chat.formatted_turns(turns).collect()}
    rest = {r.conv_id: r.record for r in chat.unformatted(turns).collect()}
    assert formatted == set(range(len(KNOWN)))
    assert set(rest) == set(range(len(KNOWN), len(KNOWN) + len(UNKNOWN) + len(RAW) + 1))
    assert rest[len(KNOWN)] == '{"messages": []}' and rest[max(rest)] is None


def test_extra_fields_are_passed_over(turns):
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in turns.filter("conv_id < 4").collect())
    assert [r[1:] for r in rows] == [(0, "user", "hi"), (1, "assistant", "ho")] * 4
    assert {r.conv_id for r in chat.read_back(chat.formatted_turns(turns)).collect()} == set(range(len(KNOWN)))
    assert [r.text for r in turns.filter("conv_id = 4").collect()] == ["� half"]
