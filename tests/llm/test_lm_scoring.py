from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import TESTDATA
from corpus import EDGES, SPACED, documents, lower, rng
from pyspark.sql import functions as F

from stallwise.llm import lm_scoring as L
from stallwise.llm.registry import QUERIES
from stallwise.llm.tables import held_out

END, BEGIN = "</s>", "<s>"


def tokens(text):
    return SPACED.findall(lower(text)) + [END]


def corpus_rows(seed=6, count=300):
    draw = rng(seed)
    names = [f"n{i}" for i in range(30)]
    rows = []
    for i in range(count):
        text, word = [], draw.choice(names)
        for _ in range(draw.randrange(60)):
            text.append(word)
            word = names[(names.index(word) * 7 + draw.randrange(3)) % 30] if draw.random() < 0.9 else f"R{draw.randrange(2000)}"
            if word not in names:
                text.append(word)
                word = draw.choice(names)
        rows.append((i, " ".join(text)))
    return rows


class Plain:
    """The model by definition, from counted words; production settings."""

    def __init__(self, texts):
        self.one, self.two, self.three, self.texts = Counter(), Counter(), Counter(), len(texts)
        for text in texts:
            t = [BEGIN, *tokens(text)]
            self.one.update(t[1:])
            self.two.update(zip(t, t[1:]))
            self.three.update(zip(t, t[1:], t[2:]))
        self.total, self.distinct = sum(self.one.values()), len(self.one)

    def p1(self, w):
        return (self.one[w] + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def p2(self, u, w):
        whole = self.texts if u == BEGIN else self.one[u]
        return (self.two[u, w] + L.STRENGTH * self.p1(w)) / (whole + L.STRENGTH)

    def p3(self, u, v, w):
        return (self.three[u, v, w] + L.STRENGTH * self.p2(v, w)) / (self.two[u, v] + L.STRENGTH)

    def base(self, text):
        return sum(math.log10(self.p1(w)) for w in tokens(text))

    def score(self, text):
        s = [BEGIN, *tokens(text)]
        return math.log10(self.p2(s[0], s[1])) + sum(math.log10(self.p3(*s[i : i + 3])) for i in range(len(s) - 2))


def learns(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 != 0


def expected(rows):
    model = Plain([text for i, text in rows if learns(i)])
    known = lambda text: sum(model.one[w] > 0 for w in tokens(text))
    return sorted(
        ((i, not learns(i), len(tokens(t)), known(t), model.total, model.base(t), model.score(t)) for i, t in rows), key=lambda r: (str(r[0]), r[5])
    )


def check(found, rows):
    found = sorted((tuple(r) for r in found), key=lambda r: (str(r[0]), r[5]))
    wanted = expected(rows)
    assert len(found) == len(wanted)
    for mine, right in zip(found, wanted):
        assert mine[:5] == right[:5]
        assert math.isclose(mine[5], right[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(mine[6], right[6], rel_tol=1e-9, abs_tol=1e-9)


def learn():
    return ~held_out("doc_id", 10, 0)


@pytest.mark.parametrize("partitions", ["3", "17"])
def test_scores_by_definition(spark, setting, partitions):
    """All n-grams of all training texts, at the settings that the query runs with."""
    setting("spark.sql.shuffle.partitions", partitions)
    rows = corpus_rows() + EDGES + [(77, "n1 n2 " * 900), (78, "same " * 1500), (900, "n3 n4"), (901, "\x00 \x00x é É")]
    check(L.score_corpus(documents(spark, rows).repartition(4), learn()).collect(), rows)


def test_parts_groups_and_pieces_do_not_matter(spark, tmp_path, setting):
    """Small groups and parts (set where the tasks see them), files read in other splits, and batches of few rows."""
    rows = corpus_rows(7, 120) + EDGES + [(500, "n1 n2 n3 " * 300)]
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "t"))
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    setting("spark.sql.files.maxPartitionBytes", "2000")
    check(L.score_corpus(spark.read.parquet(str(tmp_path / "t")), learn()).collect(), rows)


def _table(rows, bunch=None):
    return pa.RecordBatch.from_pydict(
        {
            "file": pa.array([5] * len(rows), pa.int64()),
            "bunch": pa.array(bunch or [0] * len(rows), pa.int64()),
            "place": pa.array(range(len(rows)), pa.int64()),
            "text": pa.array(rows, pa.string()),
            "learn": pa.array([True] * len(rows)),
            "id": pa.array(range(len(rows)), pa.int64()),
        }
    )


@pytest.mark.parametrize("size", [1, 40, 1000, 1 << 24])
@pytest.mark.parametrize("piece", [1, 2, 5, 512])
def test_in_one_process_with_small_parts_and_pieces(monkeypatch, size, piece):
    monkeypatch.setattr(L, "PART_BYTES", size)
    monkeypatch.setattr(L, "PIECE", piece)
    texts = [t for _, t in corpus_rows(8, 40)] + [None, "", "unseen words", "n1 " * 50]
    batch = _table(texts, [i // 9 for i in range(len(texts))])
    asked = [row for part in L._ask_partition(iter([batch.slice(0, 13), batch.slice(13)]), 5) for row in part.to_pylist()]
    asked.sort(key=lambda r: (r["block"], r["kind"]))
    blocks = pa.RecordBatch.from_pylist(asked)
    answers = [row for part in L._answer_partition(iter([blocks])) for row in part.to_pylist()]
    model = Plain(texts)
    assert (sum(r["tokens"] for r in answers), sum(r["distinct"] for r in answers)) == (model.total, model.distinct)
    rows = [{**r, "side": 0, "place": r["first"]} for r in answers] + [{**r, "side": 1} for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["file"], r["bunch"], r["side"], r["place"]))
    schema = pa.schema(
        [(n, pa.int64()) for n in ("file", "bunch", "place", "last", "id")] + [(n, pa.int32()) for n in ("side", "kind", "block")]
        + [("counts", pa.binary()), ("text", pa.string()), ("learn", pa.bool_())]
    )
    met = pa.RecordBatch.from_pylist(rows, schema)
    scored = [r for part in L._score_partition(iter([met.slice(0, 31), met.slice(31)]), 5, model.total, model.distinct) for r in part.to_pylist()]
    assert [r["id"] for r in scored] == list(range(len(texts)))
    for row, text in zip(scored, texts):
        assert math.isclose(row["score"], model.score(text), rel_tol=1e-9) and math.isclose(row["base_score"], model.base(text), rel_tol=1e-9)


def test_next_tokens_sum_to_one():
    model = Plain([t for _, t in corpus_rows(9, 60)])
    words, unknown = list(model.one), "never seen"
    assert math.isclose(sum(map(model.p1, words)) + model.p1(unknown), 1.0)
    for u in [BEGIN, unknown, *words[:8]]:
        assert math.isclose(sum(model.p2(u, w) for w in [*words, unknown]), 1.0)
        for v in words[:8]:
            assert math.isclose(sum(model.p3(u, v, w) for w in [*words, unknown]), 1.0)


def test_packed_blocks_round_trip():
    draw = np.random.default_rng(3)
    for size, most in [(1, 2), (9, 2**56 - 1), (5000, 2**56 - 1), (5000, 6000)]:
        keys = np.unique(draw.integers(0, most, size))
        assert (L.unpack_keys(L.pack_keys(keys)) == keys).all()
        counts = draw.choice([0, 1, 1, 2, 254, 255, 256, 2**40], len(keys))
        assert (L.unpack_counts(L.pack_counts(counts), len(counts)) == counts).all()


def test_words_made_to_collide_are_two_words(spark):
    """Words of which one is the other's complement in the Thue-Morse sequence, equal under polynomials modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    x, y = ("".join(pair[b] for b in bits) for pair in ("xy", "yx"))
    rows = [(i, x) for i in range(1, 6)] + [(i, y) for i in range(6, 9)]
    found = {r.doc_id: r for r in L.score_corpus(documents(spark, rows), F.col("doc_id") <= 5).collect()}
    assert found[1].n_known == 2 and found[7].n_known == 1 and found[7].base_score < found[1].base_score


def test_the_model_fits_better_than_unigrams(spark):
    rows = QUERIES["op5_lm_scoring"](spark, str(TESTDATA / "sf0.01")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


def test_query_by_definition_on_all_documents(spark):
    folder = str(TESTDATA / "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op5_lm_scoring"](spark, folder).collect(), rows)


def test_empty_training_and_empty_table(spark):
    found = L.score_corpus(documents(spark, [(1, "a b")], row=3, n=1, learn=True, place=4), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found] == [(3, 0, 0, 0.0, 0.0)]
    assert L.score_corpus(documents(spark, []), F.lit(True)).collect() == []
    nothing = L.score_corpus(documents(spark, [(None, None)], id="x", text_2="y"), F.lit(None).cast("boolean")).collect()
    assert [(r["doc_id"], r["held_out"], r["n_tokens"]) for r in nothing] == [(None, True, 1)]
