from __future__ import annotations

import numpy as np
from conftest import TESTDATA
from corpus import EDGES, documents, rng, sentence
from pyspark.sql import functions as F

from stallwise.llm import toxicity as X

LABELS = "doc_id bigint, quality int, toxic int"


def test_folding():
    assert X.fold("Yоu 1D10T, tr@sh! ＩＤＩＯＴ f​ool 100%") == " you idiot trash idiot fool ioo "
    assert X.fold("") == "  " and X.fold("$$$ !!!") == "  "


def test_exceptions_and_heaviest_entry():
    model = X.Toxicity({" trash ": 3.0, " tras": 2.0, " idio": 1.5}, ("trash can",))
    assert list(model.hits(X.fold("trash")).values()) == [3.0]
    assert model.hits(X.fold("the trash can stands")) == {}
    assert list(model.hits(X.fold("trash can, trash, idiots, trasher")).values()) == [3.0, 1.5, 2.0]
    assert X.Toxicity({}, ()).features("any text") == (0.0, 0.0, 0.0, 0.0)


def small_corpus():
    draw = rng(4)
    rows, labels = [], []
    for i in range(400):
        text = sentence(draw, 30)
        if i % 4 == 0:
            text += draw.choice([" you moron", " a MORON.", " mоr0n here"])
        elif i % 4 == 1:
            text += " morons lake"  # another word
        rows.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_learned_words_and_evasions(spark):
    rows, labels = small_corpus()
    model = X.fit_toxicity(documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (9999, 1, 1)], LABELS))
    assert max(model.lexicon, key=model.lexicon.get) == " moron "
    tests = [(101, "quiet words here"), (102, "what a m0rоn"), (103, "MORON"), (104, None), *EDGES]
    found = X.score_toxicity(documents(spark, tests, score=1, id=2), model).collect()
    scores = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == len(tests) and all(0 <= r["score"] <= 1 for r in found)
    assert scores[102] > 0.7 and scores[103] > 0.7 > max(scores[101], scores[104], scores[6])
    assert X.score_toxicity(documents(spark, []), model).collect() == []


def test_without_labels_all_score_the_prior(spark):
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (2, 0, 0)]):
        model = X.fit_toxicity(documents(spark, [(1, "a b"), (2, "c d")]), spark.createDataFrame(labels, LABELS))
        assert {round(r["score"], 6) for r in X.score_toxicity(documents(spark, EDGES), model).collect()} == {X.PRIOR}


def test_held_out_fold_of_the_test_tables(spark):
    folder = str(TESTDATA / "sf0.1")
    found = X.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    found = found[found.held_out]
    assert set(found.doc_id) == {i for i in found.doc_id if __import__("zlib").crc32(str(i).encode()) % 3 == 1}
    toxic, clean = found[found.toxic == 1].score.values, found[found.toxic == 0].score.values
    auc = np.mean([(s > clean).mean() + 0.5 * (s == clean).mean() for s in toxic])
    assert auc > 0.88
    assert (found[found.toxic == 0].predicted == 0).mean() > 0.99
    assert (found[found.toxic == 1].predicted == 1).mean() > 0.75


def test_labels_of_the_held_out_fold_are_not_read(spark, tmp_path):
    """Turning those labels round changes nothing."""
    folder = TESTDATA / "sf0.001"
    results = []
    for turned in (False, True):
        target = tmp_path / str(turned)
        spark.read.parquet(str(folder / "documents.parquet")).write.parquet(str(target / "documents.parquet"))
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
        toxic = F.when(held & F.lit(turned), 1 - F.col("toxic")).otherwise(F.col("toxic"))
        spark.read.parquet(str(folder / "labels.parquet")).withColumn("toxic", toxic).write.parquet(str(target / "labels.parquet"))
        results.append(sorted(tuple(r) for r in X.op4_toxicity(spark, str(target)).collect()))
    assert results[0] == results[1]


def test_copies_of_a_labelled_document_do_not_weigh(spark):
    rows, labels = small_corpus()
    labels = spark.createDataFrame(labels, LABELS)
    once, often = (X.fit_toxicity(documents(spark, rows + more), labels) for more in ([], rows[:3] * 40))
    assert once.lexicon == often.lexicon and (once.slopes == often.slopes).all()


def plain_hits(model, folded):
    """Every entry and phrase looked for at every place."""
    places = lambda entry: [p for p in range(len(folded)) if folded.startswith(entry, p)]
    found = {}
    for entry, weight in model.lexicon.items():
        for p in places(entry):
            found[p] = max(found.get(p, 0.0), weight)
    for phrase in map(X.fold, model.exceptions):
        for begin in places(phrase):
            for p in [p for p in found if begin <= p < begin + len(phrase) - 1]:
                del found[p]
    return found


def test_hits_equal_a_plain_search():
    draw = rng(12)
    words = ["tra", "trash", "trasher", "can", "ca", "a", "clown", "clowns", "class", "é"]
    for _ in range(60):
        entries = {f" {draw.choice(words)}{draw.choice([' ', ''])}": draw.choice([0.5, 1.0, 2.5]) for _ in range(draw.randrange(6))}
        phrases = tuple(" ".join(draw.choices(words, k=draw.randrange(1, 4))) for _ in range(draw.randrange(4)))
        model = X.Toxicity(entries, phrases)
        for _ in range(20):
            folded = X.fold(" ".join(draw.choices(words, k=draw.randrange(12))))
            assert model.hits(folded) == plain_hits(model, folded)


def test_the_lexicon_has_no_cap(spark):
    """Entries beyond any fixed number stay: as many as the labelled texts tell apart."""
    toxic = [(i, " ".join(f"bad{k}x" for k in range(30 * (i % 10), 30 * (i % 10) + 30))) for i in range(200)]
    toxic, clean = (documents(spark, rows).select("text") for rows in (toxic, [(i, "fine words only here") for i in range(4000)]))
    assert sum(entry.endswith("x ") for entry in X.learn_lexicon(toxic, clean)) == 300
