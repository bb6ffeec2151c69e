from __future__ import annotations

from corpus import EDGES, documents, rng, words

from stallwise.llm.license_scan import NOTICES, Template, notices, phrases, scan_licenses

TEMPLATES = [
    Template("a", ("common", "w1", "w2", "rare", "common")),
    Template("b", ("w3", "w4", "w5", "w6", "w7", "w8"), 0.5),
    *phrases([("p", "w1 w2 w1"), ("q", "rare")]),
]


def blocks(text):
    w = words(text)
    out = []
    for number, t in enumerate(TEMPLATES):
        n = len(t.words)
        for start in range(len(w)):
            block = w[start : start + n]
            if t.phrase:
                if tuple(block) == t.words:
                    out.append((number, start, 1.0))
            elif len(set(block) & set(t.words)) >= t.need:
                out.append((number, start, len(set(block) & set(t.words)) / len(t.distinct)))
    return sorted(out)


def test_every_block_is_found(spark):
    draw = rng(1)
    names = ["common"] * 6 + [f"w{i}" for i in range(10)] + ["rare"]
    rows = [(i, " ".join(draw.choice(names) for _ in range(draw.randrange(40)))) for i in range(60)]
    found = scan_licenses(documents(spark, rows + EDGES), TEMPLATES).collect()
    expected = sorted((i if i is not None else -1, len(words(t)), blocks(t)) for i, t in rows + EDGES)
    got = sorted(
        (r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], sorted((b["template"], b["first_word"], b["containment"]) for b in r["blocks"]))
        for r in found
    )
    assert got == expected
    assert any(blocks(t) for _, t in rows)


def test_notices_with_other_words_and_line_breaks(spark):
    text = "Intro.\nLicensed under the GNU\nApache License, Version\t2.0. Outro"
    (row,) = scan_licenses(documents(spark, [(1, text)]), notices(NOTICES)).collect()
    assert {NOTICES[b["template"]][0] for b in row["blocks"]} == {"apache-2"}


def test_empty_table_and_extra_columns(spark):
    assert scan_licenses(documents(spark, []), TEMPLATES).collect() == []
    (row,) = scan_licenses(documents(spark, [(1, "rare")], id=1, blocks="x", n_words=0), TEMPLATES).collect()
    assert row["doc_id"] == 1 and [b["template"] for b in row["blocks"]] == [3]
