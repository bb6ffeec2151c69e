from __future__ import annotations

import numpy as np
from conftest import TESTDATA
from corpus import EDGES, SPACED, documents, rng, sentence
from pyspark.sql import functions as F

from stallwise.llm import quality as Q

LABELS = "doc_id bigint, quality int, toxic int"


def base(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    draw = rng(1)
    rows = [(i, sentence(draw, draw.randrange(80), 12) + draw.choice(["", "\n a\n a \n a", " #$%&|<>*", "\n\n"])) for i in range(60)]
    rows += [(100 + i, f"{sentence(draw, 20)}\n" * 3) for i in range(4)] + EDGES
    model = Q._fit(_no_rows())
    found = Q.judge_quality(documents(spark, rows), model).select("row.*", "*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(base(t) for _, t in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"]) and r["probability"] == Q.PRIOR


def _no_rows():
    import pyarrow as pa

    return pa.table({"label": pa.array([], pa.int32()), "numbers": pa.array([], pa.list_(pa.int32())), "amounts": pa.array([], pa.list_(pa.float32()))})


def test_held_out_accuracy(spark):
    folder = TESTDATA / "sf0.01"
    docs, labels = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "labels"))
    test = F.xxhash64("doc_id") % 2 == 0
    model = Q.fit_quality_model(docs, labels.filter(~test))
    judged = Q.judge_quality(docs, model).select("row.doc_id", "probability", "base_failed").join(labels.filter(test), "doc_id").toPandas()
    judged = judged[~judged.base_failed]
    right = (judged.probability >= Q.KEEP_PROBABILITY) == (judged.quality == 1)
    assert right.mean() > 0.95 and right[judged.quality == 1].mean() > 0.98


def test_calibration_gives_probabilities():
    draw = np.random.default_rng(0)
    margin = draw.normal(size=4000) * 3
    label = (draw.random(4000) < 1 / (1 + np.exp(-(0.7 * margin - 0.5)))).astype(float)
    slope, shift = Q._calibrate(margin, label)
    assert abs(slope - 0.7) < 0.06 and abs(shift + 0.5) < 0.15


def test_kept_rows_keep_their_columns(spark):
    good = sentence(rng(2), 50)
    df = documents(spark, [(1, good), (2, "too short"), (None, good), *EDGES], kept=False, row="r", text_2=None or 1, n_words="x")
    kept = Q.keep_good(df, spark.createDataFrame([(None, 1, 0), (7, None, 0), (99, 1, 1)], LABELS))
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
    empty = Q.keep_good(documents(spark, []), spark.createDataFrame([], LABELS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text"]


def test_copies_of_a_labelled_document_do_not_weigh(spark):
    """A labelled id is one row of the fit, however often it is repeated and whatever other texts it has."""
    draw = rng(4)
    rows = [(i, sentence(draw, 30)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)
    fitted, models = [], []
    for more in ([], [rows[3]] * 40 + [(3, "~ another text")]):
        docs = documents(spark, rows + more)
        features = Q.training_features(docs, labels).select("draw", "label", "numbers", "amounts")
        fitted.append(sorted(tuple(r) for r in features.collect()))
        models.append(Q.fit_quality_model(docs, labels))
    assert len(fitted[0]) == 20 and fitted[0] == fitted[1]
    assert (models[0].weights == models[1].weights).all() and models[0].slope == models[1].slope
    table = Q.training_features(docs, labels).toArrow().sort_by([("draw", "ascending"), ("label", "ascending")])
    assert (Q._fit(table).weights == models[0].weights).all()
