from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import TESTDATA
from corpus import EDGES, documents, rng
from tokenizers import Tokenizer

from stallwise.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pack(rows, capacity):
    """No sequence is too long, places are gapless; gives the number of sequences."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_given_documents(spark):
    folder = str(TESTDATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = P.op7_packing(spark, folder).collect()
    total = sum(r["length"] for r in rows)
    assert check_pack(rows, 2048) <= -(-total // 2048) * 1.01
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    tokenizer = Tokenizer.from_file(PATH)
    for doc, encoding in zip(docs, tokenizer.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)):
        ids = np.array([*encoding.ids, 0], "<u4")
        found = sorted(pieces[doc["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert [(r["start"], r["length"]) for r in found] == P.piece_bounds(len(ids), 2048)
        for r in found:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(pieces) == len(docs)


def test_pieces():
    assert P.piece_bounds(1, 4) == [(0, 1)]
    assert P.piece_bounds(4, 4) == [(0, 4)]
    assert P.piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert P.piece_bounds(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("shape", ["uniform", "short", "long", "few", "full", "empty"])
@pytest.mark.parametrize("capacity", [7, 64, 512])
def test_plans_hold_every_piece_once(shape, capacity):
    draw = np.random.default_rng(len(shape) * capacity)
    high = {"short": capacity // 4 + 1, "full": capacity}.get(shape, capacity)
    low = {"long": capacity // 2 + 1, "full": capacity}.get(shape, 1)
    lengths = draw.integers(low, high + 1, {"few": 9, "empty": 0}.get(shape, 3000))
    histogram = np.bincount(lengths, minlength=capacity + 1)
    groups = P.plan_groups(histogram, capacity)
    held = np.zeros(capacity + 1, np.int64)
    for group in groups:
        assert sum(group.lengths) <= capacity and group.count > 0
        for n in group.lengths:
            held[n] += group.count
    assert (held == histogram).all()
    used = sum(g.count for g in groups)
    bound = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    assert used <= bound * 1.02 + 1
    plan = P.make_plan(groups, capacity)
    rank = np.concatenate([np.arange(c) for c in histogram]) if len(lengths) else np.zeros(0, np.int64)
    length = np.repeat(np.arange(capacity + 1), histogram)
    sequence, offset = plan.place(length, rank)
    check_pack([{"sequence_id": s, "offset": o, "length": n} for s, o, n in zip(sequence, offset, length)], capacity)
    assert len(set(sequence.tolist())) == used


def test_repeats_are_fitted_by_patterns():
    histogram = np.zeros(65, np.int64)
    histogram[[40, 24, 32]] = [1000, 1000, 600]
    groups = P.plan_groups(histogram, 64)
    assert sum(g.count for g in groups) == 1300
    assert any(g.lengths == (40, 24) and g.count > 900 for g in groups)


def test_salts_number_each_length_once(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_SALT", 10)
    draw = rng(3)
    rows = [(i, "word " * draw.choice([3, 3, 3, 9])) for i in range(300)]
    found = P.pack_documents(documents(spark, rows), PATH, capacity=16).collect()
    assert check_pack(found, 16) and len(found) == 300


def test_edges(spark):
    rows = [*EDGES, (8, "<|endoftext|>"), (9, "word " * 5000)]
    found = P.pack_documents(documents(spark, rows, id=1, length=2, rank=3), PATH, keep_ids=True).collect()
    check_pack(found, 2048)
    assert sorted(r["ids"] for r in found if r["doc_id"] in (1, 2)) == [[0], [0]]
    assert sum(r["doc_id"] == 5 for r in found) == 3 and sum(r["doc_id"] is None for r in found) == 2
    ids = Tokenizer.from_file(PATH).encode("<|endoftext|>", add_special_tokens=False).ids
    assert len(ids) == 1 and next(r["ids"] for r in found if r["doc_id"] == 8) == [*ids, 0]
    assert [r["length"] for r in sorted(found, key=lambda r: r["piece"]) if r["doc_id"] == 9][1:] == [2048, 2048]
    assert P.pack_documents(documents(spark, []), PATH).collect() == []


def test_ids_are_those_of_the_default_call():
    """Texts with strings of added tokens, whole, in part and beside others, by tokenizers with its own settings."""
    tokenizer = Tokenizer.from_file(PATH)
    encode = P.byte_level_encoder(PATH)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    assert added
    draw = rng(5)
    pieces = [*added, "<|", "|>", " ", "  \n", "word", " it's", "é", "\U0001f600", "<|endoftext", "endoftext|>", "\x00", "12 345"]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(9))) for _ in range(400)] + ["a <|endoftext|> b"]
    assert sum(any(a in t for a in added) for t in texts) > 100
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
