from __future__ import annotations

import numpy as np
import pytest
from conftest import TESTDATA
from corpus import EDGES, bag, classes, documents, rng, sentence, similarity

from stallwise.llm import near_dedup as N
from stallwise.llm.components import components


@pytest.mark.parametrize("same", [40, 70, 95])
def test_signatures_estimate_weighted_jaccard(same):
    draw = rng(same)
    a = {i: draw.randrange(1, 12) for i in range(100)}
    b = {i: a[i] + (3 if i % 9 == 0 else 0) for i in range(same)} | {i: 2 for i in range(200, 220)}
    keys = a.keys() | b.keys()
    truth = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    estimates = []
    for turn in range(60):
        hashed = [N.mix(np.array(list(d), np.uint64) + np.uint64(1000 * turn)) for d in (a, b)]
        signature = N.bag_minhash(
            np.repeat([0, 1], [len(a), len(b)]), np.concatenate(hashed), np.array([*a.values(), *b.values()]), 2
        )
        estimates.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(estimates) - truth) < 4 * np.sqrt(truth * (1 - truth) / (60 * N.SLOTS))


def found_classes(spark, rows, **options):
    df = documents(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    return {r["id"]: r for r in N.near_duplicate_classes(df, **options).collect()}


def check(spark, texts, **options):
    rows = [(i, t) for i, t in enumerate(texts)]
    found, expected = found_classes(spark, rows, **options), classes(rows)
    for i, members in enumerate(expected):
        assert (found[i]["class_id"], found[i]["class_size"], found[i]["stays"]) == (members[0], len(members), members[0] == i)


def edited(draw, text, edits):
    w = text.split()
    for place in draw.sample(range(5, len(w) - 5, 10), edits):
        w[place] = f"x{draw.randrange(10**9)}"
    return " ".join(w)


def test_star_of_copies_that_are_not_alike(spark, monkeypatch):
    """Copies are near the original only, so links hang on finding it; blocks are split as well."""
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 7)
    draw = rng(3)
    original = sentence(draw, 150)
    copies = [edited(draw, original, 3) for _ in range(40)]
    assert similarity(bag(copies[0]), bag(copies[1])) < 0.8 <= similarity(bag(copies[0]), bag(original))
    chain = [sentence(draw, 120)]
    for _ in range(6):
        chain.append(edited(draw, chain[-1], 2))
    check(spark, copies[:20] + [original] + copies[20:] + chain + [sentence(draw, 100) for _ in range(20)])


def test_no_original_among_the_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 5)
    draw = rng(5)
    original = sentence(draw, 150)
    check(spark, [edited(draw, original, draw.randrange(1, 4)) for _ in range(50)])


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet")).select("doc_id", "text").collect()]
    check(spark, [text for _, text in sorted(rows)])


def test_edges(spark):
    found = N.near_duplicate_classes(documents(spark, EDGES)).collect()
    assert len(found) == len(EDGES)
    assert sum(r["stays"] for r in found if r["id"] == 5) == 3  # a repeated row stays as often as it stands
    assert all(r["class_size"] == 1 and not r["has_words"] for r in found if r["id"] in (1, 2, 3))
    assert {r["class_size"] for r in found if r["id"] == 5} == {1, 2}
    assert N.near_duplicate_classes(documents(spark, [])).collect() == []


def test_one_of_each_is_kept_with_its_columns(spark):
    rows = [(9, "a b c d e f g"), (7, "A B C d e f g!"), (8, "other words"), (2, None), (2, None)] + EDGES
    df = documents(spark, rows, id="x", row=1, nth=2, body=None or "b", has_words=False)
    kept = N.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in kept.collect())
    expected = [r for r in rows if r[0] != 9]
    expected.remove((5, "the same row twice over and again"))
    assert ids == sorted((i is not None, i, t or "") for i, t in expected)


def test_components(spark):
    draw = rng(8)
    links = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5)]
    draw.shuffle(links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: i // 20 * 20 for i in range(60)} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("size", [1, 8, 25, 300])
def test_a_text_has_one_signature_in_any_chunk(size):
    """Whatever texts are signed with it, and so however many points are drawn at once."""
    draw = np.random.default_rng(size)
    element, weight = draw.integers(0, 1 << 63, size).astype(np.uint64), draw.integers(1, 6, size)
    alone = N.bag_minhash(np.zeros(size, np.int64), element, weight, 1)[0]
    for others in (1, 30, 2000):
        more = draw.integers(0, 1 << 63, others * 10).astype(np.uint64)
        text = np.concatenate([np.zeros(size, np.int64), 1 + np.repeat(np.arange(others), 10)])
        signed = N.bag_minhash(text, np.concatenate([element, more]), np.concatenate([weight, np.ones(others * 10, np.int64)]), others + 1)
        assert (signed[0] == alone).all()


def test_complementary_sequences_are_two_nodes(spark):
    """Sequences over two words that agree in any polynomial modulo 2 ** 64 are still different texts."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = [" ".join("xy"[b ^ turned] for b in bits) for turned in (0, 1, 0)]
    nodes = N._signed(N._rows(documents(spark, list(enumerate(texts))), "doc_id", "text")).collect()
    by_id = {row["id"]: row["node"] for row in nodes}
    assert by_id[0] == by_id[2] != by_id[1]
    check(spark, texts)
