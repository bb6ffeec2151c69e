from __future__ import annotations

import hashlib

import pytest
from corpus import EDGES, documents, rng, sentence, words

from stallwise.llm import decontaminate as D


def items(spark, rows):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def brute(docs, bench, width=13):
    windows = {}
    for item, text in bench:
        w = words(text)
        if item is None or not w:
            continue
        n = min(width, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((str(doc), len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def judged(spark, docs, bench):
    found = D.judge_contamination(*D.find_contamination(documents(spark, docs), items(spark, bench))).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found for _ in range(r["copies"]))


@pytest.mark.parametrize("short", [False, True])
def test_equals_all_windows(spark, short):
    draw = rng(7)
    passages = [sentence(draw, 40) for _ in range(5)]
    bench = [(i, p) for i, p in enumerate(passages)] + [(11, passages[0]), (3, passages[3]), (None, "x y"), (12, None), (13, "... !")]
    if short:
        bench += [(20, "w1 w2"), (21, "w7"), (22, sentence(draw, 12))]
    docs = []
    for i in range(60):
        text = sentence(draw, draw.randrange(1, 200)).split()
        for _ in range(draw.randrange(3)):
            w = draw.choice(passages).upper().split()
            begin = draw.randrange(30)
            place = draw.randrange(len(text))
            text[place:place] = w[begin : begin + draw.choice([10, 12, 13, 14, 25])]
        docs.append((i, ", ".join(text)))
    docs += EDGES
    assert judged(spark, docs, bench) == brute(docs, bench)


def test_without_benchmark(spark):
    docs = [(1, "some words"), *EDGES]
    assert judged(spark, docs, []) == brute(docs, [])
    assert judged(spark, [], [(1, "a b c")]) == []


def test_large_benchmark_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    draw = rng(9)
    bench = [(1, sentence(draw, 30))]
    docs = [(1, "before " + bench[0][1] + " after"), (2, sentence(draw, 50))]
    assert judged(spark, docs, bench) == brute(docs, bench)


def test_removal_keeps_columns_and_clean_documents(spark):
    draw = rng(10)
    passage = sentence(draw, 20)
    rows = [(1, passage), (2, sentence(draw, 30)), (None, passage), (None, "clean"), (3, passage + " " + sentence(draw, 600)), *EDGES]
    df = documents(spark, rows, row=1, id=2, body="b", bad_id=3)
    kept = D.remove_contaminated(df, items(spark, [(1, passage)]))
    assert kept.columns == df.columns
    gone = [(1, passage), (None, passage)]
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(str(r) for r in rows if r not in gone)


def test_query_digest_of_items(spark, tmp_path):
    documents(spark, [(1, "a b c"), (2, "z")]).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, [(10, "a b"), (9, "b c")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in D.op6_decontaminate(spark, str(tmp_path)).collect()}
    assert found[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and found[1]["n_items"] == 2
    assert found[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not found[2]["contaminated"]


def test_main_path_has_no_python(spark):
    docs, bench = documents(spark, [(1, "a b c")]), items(spark, [(1, "a b c")])
    plan = D.judge_contamination(*D.find_contamination(docs, bench))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
