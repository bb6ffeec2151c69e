from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stallwise.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, parts string"
NASTY = st.text(alphabet=st.sampled_from(list("\\<|>en d:0\n/image") + ["é", "\U0001f600", "\x00"]), max_size=30)


def turns(spark, rows):
    return spark.createDataFrame([(*r, None)[:5] for r in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=4))
def test_reading_back_is_exact(pairs):
    formatted = "".join(C.format_turn(role, text)["formatted"] for role, text in pairs)
    assert C.read_back(formatted) == pairs


@settings(max_examples=200, deadline=None)
@given(NASTY)
def test_marks_cannot_be_forged(text):
    assert C.read_back(C.format_turn("user", text)["formatted"] + C.format_turn("assistant", "x")["formatted"]) == [("user", text), ("assistant", "x")]


def test_long_text():
    text = "<|end|>\n\\" * 100_000
    assert C.read_back(C.format_turn("user", text)["formatted"]) == [("user", text)]


PARTS = [
    {"type": "text", "text": "see <|end|>"},
    {"type": "image", "ref": "s3://a/b.png", "width": 600, "height": 512},
    {"type": "document", "ref": "d.pdf", "parts": [{"type": "text", "text": "in\\side"}, {"type": "audio", "ref": "x.wav", "seconds": 1.5}]},
    {"type": "text", "text": None},
    {"type": "image"},
]


def test_parts_become_placeholders_in_order(spark):
    df = turns(spark, [(1, 0, "user", "unused", json.dumps(PARTS)), (1, 1, "assistant", "ok", None), (1, 2, "user", "x", "[]")])
    first, second, third = C.format_conversations(df, parts="parts").orderBy("turn").collect()
    assert first["formatted"] == (
        "<|user|>\nsee \\<|end|><|image:0|><|document:1|>in\\\\side<|audio:2|><|/document|><|image:3|><|end|>\n"
    )
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [
        ("image", "s3://a/b.png", 512), ("document", "d.pdf", 0), ("audio", "x.wav", 38), ("image", "", 256),
    ]
    for a, mark in zip(first["attachments"], ("<|image:0", "<|document:1", "<|audio:2", "<|image:3")):
        assert first["formatted"][a["place"] :].startswith(mark)
    assert first["attachment_tokens"] == 806 and first["loss_start"] == first["loss_end"]
    assert second["offset"] == len(first["formatted"])
    whole = first["formatted"] + second["formatted"] + third["formatted"]
    assert whole[second["loss_start"] : second["loss_end"]] == "ok"
    assert C.read_back(whole) == [("user", "see <|end|>in\\side"), ("assistant", "ok"), ("user", "")]


def test_unknown_part():
    with pytest.raises(ValueError, match="unknown content part"):
        C.format_turn("user", None, '[{"type": "video"}]')


def digest(rows):
    role_text = "".join(f"{role}\n{text}\n" for role, text in rows)
    learned = "".join(text for role, text in rows if role == "assistant")
    formatted = "".join(C.format_turn(*row)["formatted"] for row in rows)
    return len(rows), hashlib.sha256(role_text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)


def test_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, None, "é"), (2, None, "assistant", "first"),
        (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, None, "c"), (4, 5, "assistant", "twice"), (4, 5, "assistant", "twice"),
        (None, 0, "user", "no conversation"),
    ]
    df = turns(spark, rows).selectExpr("*", "'x' AS formatted", "1 AS offset", "2 AS chars")
    found = {r["conv_id"]: tuple(r)[1:] for r in C.conversation_digests(C.format_conversations(df)).collect()}
    assert found == {
        1: digest([("user", ""), ("assistant", "")]),
        2: digest([("assistant", "first"), ("", "é")]),
        3: digest([("", "c"), ("assistant", "a"), ("assistant", "b")]),
        4: digest([("assistant", "twice")] * 2),
        None: digest([("user", "no conversation")]),
    }
    assert C.conversation_digests(C.format_conversations(turns(spark, []))).collect() == []


def test_a_gap_is_noticed(spark):
    formatted = C.format_conversations(turns(spark, [(1, i, "user", "x") for i in range(3)])).filter("turn <> 1")
    with pytest.raises(Exception, match="gap"):
        C.conversation_digests(formatted).collect()
