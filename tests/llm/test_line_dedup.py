from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from corpus import EDGES, documents, rng
from pyspark.sql import functions as F

from stallwise.llm import line_dedup
from stallwise.llm.line_dedup import decode_keep, drop_lines, encode_keep, keep_bitmaps, line_key, number_rows, remove_repeated_lines


def brute(rows, min_docs, min_chars=1, keep_first=False):
    """(lines, dropped flags) of each row, in the order given."""
    split = [[line for line in (text or "").split("\n")] for _, text in rows]
    places = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for i in order:
        for k, line in enumerate(split[i]):
            key = line_key(line.encode())
            if len(key.decode()) >= min_chars:
                places[key].append((i, k))
    gone = [[False] * len(lines) for lines in split]
    for found in places.values():
        if len({i for i, _ in found}) >= min_docs:
            for i, k in found[1:] if keep_first else found:
                gone[i][k] = True
    return split, gone


def result(spark, rows, partitions, **rules):
    docs = documents(spark, rows).withColumn("at", F.monotonically_increasing_id()).repartition(3)
    numbered = number_rows(docs)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    cut = drop_lines(numbered, keep_bitmaps(numbered, **rules)).select("row.doc_id", "n_lines", "n_dropped", "keep", "kept").collect()
    return sorted(((r[0], r[1], r[2], tuple(decode_keep(r[3]).tolist()), r[4]) for r in cut), key=str)


def corpus_rows():
    r = rng(3)
    lines = [f"Line {k} of text" for k in range(30)] + ["  ALL have this ", "all HAVE this", "\tall have this\r", "", " ", "é", "x"]
    rows = []
    for i in range(120):
        mine = r.choices(lines, k=r.randrange(1, 12)) + ([lines[30 + i % 3]] * (i % 4) if i % 3 else [])
        rows.append((i // 2 if i % 7 else None, "\n".join(mine)))
    return rows + EDGES


@pytest.mark.parametrize("partitions", [1, 4, 40])
@pytest.mark.parametrize("min_docs", [1, 2, 10, 25, 1000])
def test_equals_brute_force(spark, setting, partitions, min_docs):
    setting("spark.sql.shuffle.partitions", "4")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = corpus_rows()
    split, gone = brute(rows, min_docs)
    expected = []
    for (doc, text), lines, flags in zip(rows, split, gone):
        kept = None if text is None and not any(flags) else "\n".join(line for line, g in zip(lines, flags) if not g)
        expected.append((doc, len(lines), sum(flags), tuple(not g for g in flags), kept))
    assert result(spark, rows, partitions, min_docs=min_docs) == sorted(expected, key=str)


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_first_one_stays(spark, setting, partitions):
    setting("spark.sql.shuffle.partitions", "4")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(i, text) for i, (_, text) in enumerate(corpus_rows())]
    split, gone = brute(rows, 3, keep_first=True)
    expected = [(doc, len(lines), sum(flags), tuple(not g for g in flags)) for (doc, _), lines, flags in zip(rows, split, gone)]
    assert [r[:4] for r in result(spark, rows, partitions, min_docs=3, keep_first=True)] == sorted(expected, key=str)


def test_one_line_in_all_documents_over_many_partitions_and_batches(spark, setting):
    setting("spark.sql.shuffle.partitions", "4")
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(i, f"common\n  own {i}\ncommon") for i in range(3000)]
    found = result(spark, rows, 16, min_docs=10)
    assert len(found) == 3000 and all(r[2] == 2 and r[4] == f"  own {r[0]}" for r in found)
    streamed = number_rows(documents(spark, rows))
    order = ["h1", "h2", "doc", "number", "line"]
    hashed = line_dedup.map_batches(
        streamed.select("doc", "number", "text"), lambda b: line_dedup._hash_batch(b, 1), "h1 bigint, h2 bigint, doc bigint, number bigint, line bigint"
    )
    sizes = [r[0] for r in hashed.repartitionByRange(16, *order).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 9000 / 16


def test_code_points_not_bytes_are_counted(spark, setting):
    setting("spark.sql.shuffle.partitions", "4")
    rows = [(i, "éé\nabc\n\U0001f600") for i in range(12)]
    kept = {r[4] for r in result(spark, rows, 4, min_docs=10, min_chars=3)}
    assert kept == {"éé\n\U0001f600"}


def test_bitmaps_round_trip():
    r = np.random.default_rng(1)
    for n in [1, 2, 7, 300, 70000]:
        for share in (0, 0.01, 0.5, 1):
            dropped = np.flatnonzero(r.random(n) < share)
            flags = np.ones(n, bool)
            flags[dropped] = False
            assert (decode_keep(encode_keep(n, dropped)) == flags).all()
    assert len(encode_keep(70000, np.array([], np.int64))) == 3


def test_clashing_columns_and_an_empty_table(spark):
    docs = documents(spark, [(i, "same\nown %d" % i) for i in range(12)], number=1, row="r", keep="k", line=2, h1="h", lines="z")
    out = remove_repeated_lines(docs)
    assert out.schema.names == docs.schema.names
    assert {(r.doc_id, r.text, r.number, r.row, r.keep, r.line, r.h1, r.lines) for r in out.collect()} == {
        (i, f"own {i}", 1, "r", "k", 2, "h", "z") for i in range(12)
    }
    assert remove_repeated_lines(docs.limit(0)).count() == 0
