"""Each stage on its predecessor's rows, against brute force."""

from __future__ import annotations

import pytest
from conftest import TESTDATA
from corpus import EDGES, classes, documents, repeated_bytes, rng, sentence, words
from pyspark.sql import functions as F

import corpus_pipeline
from stallwise.llm import quality as Q
from stallwise.llm.tables import materialise
from test_decontaminate import brute
from test_packing import check_pack

FOLDER = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("row", F.lit("clash")).withColumn("kept", F.lit(1))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER))
        out.append(docs.collect())
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "decontaminate", "packing"]


def test_columns_stay(stages):
    for rows in stages[1:-1]:
        assert rows[0].__fields__ == stages[0][0].__fields__ and all(r["row"] == "clash" for r in rows)


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = Q.fit_quality_model(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r["doc_id"] for r in Q.judge_quality(docs, model).filter("kept").select("row.doc_id").collect()}
    assert {r["doc_id"] for r in stages[1]} == kept
    assert 0.6 * len(stages[0]) < len(kept) < len(stages[0])


def test_near_dedup(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted({rows[members[0]][0] for members in classes(rows)})


def test_suffix_dedup(stages):
    again = repeated_bytes([(r["doc_id"], r["text"].encode()) for r in stages[2]])
    texts = {r["doc_id"]: r["text"].encode() for r in stages[2]}
    assert len(stages[3]) == len(stages[2])
    for r in stages[3]:
        kept = bytes(b for b, gone in zip(texts[r["doc_id"]], again[r["doc_id"]]) if not gone)
        assert r["text"] == kept.decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])


def test_decontaminate(spark, stages):
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    verdicts = brute([(r["doc_id"], r["text"]) for r in stages[3]], bench)
    assert sorted(str(r["doc_id"]) for r in stages[4]) == sorted(doc for doc, *_, bad in verdicts if not bad)


def test_packing(stages):
    assert {r["doc_id"] for r in stages[5]} == {r["doc_id"] for r in stages[4]}
    total = sum(r["length"] for r in stages[5])
    assert check_pack(stages[5], 2048) <= -(-total // 2048) + 1
    assert total >= sum(len(words(r["text"])) for r in stages[4])


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in found) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[5])


def test_nulls_repeats_and_clashing_names(spark):
    draw = rng(11)
    good = [sentence(draw, 60) for _ in range(6)]
    rows = [(900000 + i, t) for i, t in enumerate(good)] + [(900000, good[0]), (None, good[1] + " more"), (None, sentence(draw, 40)), *EDGES]
    rows.append((900099, good[2] + " " + sentence(draw, 3000)))
    docs = documents(spark, rows, id=1, body="b", row=None, kept=False, length=2, text_2="t")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, FOLDER))
        assert name == "packing" or docs.columns == before.columns
    found = docs.collect()
    assert check_pack(found, 2048) == len({r["sequence_id"] for r in found})
    ids = [r["doc_id"] for r in found if r["piece"] == 0]
    # the near copy with the NULL id comes first, so it is the one of its class that stays
    assert sorted(i for i in ids if i is not None) == [900000, 900002, 900003, 900004, 900005, 900099]
    assert ids.count(None) == 2


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER))
    assert docs.count() == 0
