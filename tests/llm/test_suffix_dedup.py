from __future__ import annotations

import hashlib

import numpy as np
import pytest
from corpus import EDGES, documents, repeated_bytes, rng, runs

from stallwise.llm import suffix_dedup as S
from stallwise.llm.deep_shallow import common_prefixes, sorted_order


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
@pytest.mark.parametrize("count", [0, 1, 3, 30, 700])
def test_deep_shallow_order(letters, count):
    draw = np.random.default_rng(letters * 1000 + count)
    rows = draw.integers(0, letters, (count, 100)).astype(np.uint8)
    rows[: count // 2, :60] = 7 % letters  # long common prefixes
    if count > 10:
        rows[count // 3 : count // 3 + 5] = rows[0]
    order = sorted_order(rows)
    strings = [r.tobytes() for r in rows]
    assert sorted(order.tolist()) == list(range(count))
    assert [strings[i] for i in order] == sorted(strings)
    common = common_prefixes(rows, order)
    for k in range(1, count):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert common[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def check(spark, rows):
    """Against all windows; ids are distinct."""
    found = {r["row"]["doc_id"]: r for r in S.cut_repeats(documents(spark, rows)).collect()}
    again = repeated_bytes([(i, (t or "").encode()) for i, t in rows])
    assert len(found) == len(rows)
    for i, text in rows:
        raw = (text or "").encode()
        assert [(r["begin"], r["end"]) for r in found[i]["removed"]] == runs(again[i]), i
        assert bytes(found[i]["kept"]) == bytes(b for b, gone in zip(raw, again[i]) if not gone)
        assert found[i]["n_bytes"] == len(raw)
    return sum(map(sum, again.values()))


def letters(draw, n, alphabet="abcdefghij éü\n"):
    return "".join(draw.choice(alphabet) for _ in range(n))


def test_passages_with_other_neighbours(spark):
    draw = rng(1)
    passages = [letters(draw, n) for n in (60, 99, 100, 101, 140, 300, 900)]
    rows = []
    for i in range(120):
        parts = [letters(draw, draw.randrange(120))]
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            begin = draw.randrange(3) * 10
            parts += [p[begin : len(p) - draw.randrange(2) * 7], letters(draw, draw.choice([0, 1, 50]))]
        rows.append((draw.randrange(10**6) * 1000 + i, "".join(parts)))
    assert check(spark, rows) > 1000


def test_copies_and_hot_passages(spark):
    draw = rng(2)
    text, line = letters(draw, 700), letters(draw, 130)
    rows = [(i, text) for i in range(40)] + [(100 + i, text[:350] + str(i) + text[350:]) for i in range(40)]
    rows += [(200 + i, letters(draw, 80) + line + letters(draw, 80)) for i in range(150)]
    check(spark, rows)


def test_runs_of_one_letter_and_periods(spark):
    draw = rng(3)
    rows = [(1, "a" * 99), (2, "a" * 100), (3, "a" * 101), (4, "a" * 400), (5, "ab" * 150), (6, "b" + "ab" * 120), (7, letters(draw, 30) + "abc" * 90)]
    rows += [(8, "THE!! END!! " * 40), (9, "x" * 50 + "THE!! END!! " * 10)]
    check(spark, rows)


def test_few_letters(spark):
    draw = rng(4)
    check(spark, [(i, letters(draw, draw.randrange(300), "ab")) for i in range(40)] + [(99, letters(draw, 20000, "abc"))])


def test_sorting_in_small_blocks(spark, monkeypatch):
    """Blocks are cut between anchors; here by calling the partition's function on one stream."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    draw = rng(5)
    line = letters(draw, 110)
    texts = [letters(draw, 90) + line + letters(draw, 90) for _ in range(60)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(60)), "text": pa.array(texts)})
    found = pa.Table.from_batches(S._anchor_batch(batch)).to_pylist()
    wanted = {}
    for r in found:
        wanted.setdefault(r["id"], []).append({"lot": r["anchor"], "split": False, "place": r["place"]})
    kind = pa.list_(pa.struct([("lot", pa.int64()), ("split", pa.bool_()), ("place", pa.int32())]))
    rows = pa.RecordBatch.from_pydict({"id": pa.array(list(wanted)), "text": pa.array([texts[i] for i in wanted]), "found": pa.array(list(wanted.values()), kind)})
    pieces = pa.Table.from_batches(S._piece_batch(rows)).sort_by("lot")
    spans = [r for size in (7,) for b in S._sort_partition(iter(pieces.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    again = {i: [False] * len(t.encode()) for i, t in enumerate(texts)}
    for r in spans:
        again[r["id"]][r["low"] : r["high"]] = [True] * (r["high"] - r["low"])
    assert again == repeated_bytes([(i, t.encode()) for i, t in enumerate(texts)])


@pytest.mark.parametrize("one_in", [1, 1 << 40])
def test_hot_anchors_are_split(spark, monkeypatch, one_in):
    """Anchors of a passage in most texts go in lots and, where the sample shows them, in parts."""
    monkeypatch.setattr(S, "SPLIT_ROWS", 12)
    monkeypatch.setattr(S, "SAMPLE_ONE_IN", one_in)
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    draw = rng(9)
    line, other = letters(draw, 160), letters(draw, 110)
    contexts = [letters(draw, 40) for _ in range(25)]  # some stand in several texts, before or after the passage
    rows = [(i, draw.choice(contexts) + letters(draw, draw.randrange(60)) + line + draw.choice(contexts)) for i in range(200)]
    rows += [(300 + i, draw.choice(contexts) + line[: 100 + i % 50] + letters(draw, 30) + other) for i in range(100)]
    rows += [(500 + i, line + line) for i in range(20)]
    assert check(spark, rows) > 10_000
    keyed, keys = S._keys(documents(spark, rows), "doc_id", "text")
    schema = "id bigint, place int, anchor bigint, around bigint, part int"
    hot = S._hot_anchors(keyed, keys, schema)
    assert bool(hot) == (one_in == 1)
    found = S.map_batches(keyed, S._anchor_batch, schema).filter("part = 0")
    lots = S._in_lots(found.select("id", "place", "anchor"), keys)
    held = [r["count"] for r in lots.filter("split").groupBy("lot").count().collect()]
    assert held and max(held) < 4 * S.SPLIT_ROWS < max(r["count"] for r in found.groupBy("anchor").count().collect())


def test_edges(spark):
    long = letters(rng(6), 300)
    rows = [*EDGES, (7, long), (7, long), (8, long + "!"), (None, long), (7, "z" + long)]
    df = documents(spark, rows, row="r", kept=1, whole=2, spans="s", body=3)
    cut = S.remove_repeats(df)
    assert cut.columns == df.columns
    found = sorted((str(r["doc_id"]), r["text"]) for r in cut.collect())
    gone = {(7, long): "", (8, long + "!"): "!", (7, "z" + long): "z"}
    assert found == sorted((str(i), gone.get((i, t), t or "")) for i, t in rows)
    assert S.remove_repeats(documents(spark, [])).collect() == []


def test_kept_text_is_valid_where_a_run_cuts_a_letter(spark):
    draw = rng(7)
    shared = letters(draw, 120, "abcdef")
    a, b = "é" + shared, "è" + shared  # the letters share their first byte, and end in different ones
    found = {r["doc_id"]: r["text"] for r in S.remove_repeats(documents(spark, [(1, a + "é"), (2, b + "è")])).collect()}
    assert found[1] == a + "é" and found[2] == "è"


def test_query_digests(spark, tmp_path):
    text = letters(rng(8), 250)
    documents(spark, [(1, text), (2, text + "tail"), (3, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: tuple(r)[1:] for r in S.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    n = len(text.encode())
    assert found[1] == (n, 0, 0, hashlib.sha256(text.encode()).hexdigest())
    assert found[2] == (n + 4, n, 1, hashlib.sha256(b"tail").hexdigest())
    assert found[3] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
