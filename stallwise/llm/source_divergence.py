"""Divergence of sources within each language, with duplicate texts collapsed first.

Terms are runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased. A language keeps the V terms that at least
``MIN_DOCS`` of its documents have. A group, (lang, source) or a whole lang, gives a kept term with ``count`` occurrences the
share ``p = 1 + floor(SCALE (count + 1) / (N + V))``, N the sum of its counts over kept terms. The divergence
of p from q at a term is ``f = floor((p - q)^2 / q)``. All of it is whole numbers, and exact.

How the work is spread:

* Equal texts of a language become one (by 128 bits of hash), with the number of copies that each source has. Both
  steps combine before the exchange, so a text that a third of all rows hold travels once per task.
* Each distinct text is tokenised once. Its term counts are multiplied by the copies of each source and
  added up per block of texts, per task and then by (lang, source, term): occurrences, and documents.
* Pairs of sources are evaluated sparsely. With p0 the share of a term that a source lacks, the sum over all
  kept terms is ``V f(p0, q0)``, plus what the terms of one source add against q0, plus what those of the other
  add against p0, plus a correction at terms that both have. The first three need only how many terms a source
  has at each share; the last is added up inside the tasks, over the sources of one term at a time, so neither
  absent terms nor term-wise pairs become rows.
* Shares meet the totals of their group in a join that Spark may broadcast by its own size check or split where a source is hot.

Defined results: NULL text, lang and source are ``''``; rows are documents, so repeated rows and ids count each; a
group without terms has its pairs, and no terms; a language without kept terms has V = 0, and pairs of value 0; one
with a single source has no pairs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.llm.tables import map_batches, materialise, read
from stallwise.llm.words import find_words, text_chunks

# Documents that make a term kept, shares to a whole, term ranks listed.
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

BLOCK_BYTES = 1 << 22  # of texts whose terms are counted together
BLOCK_CELLS = 1 << 20  # pairs evaluated, or held, together

_NOT_LETTERS = np.ones(256, bool)
_NOT_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after lower-casing A-Z
LETTERS_LOWER = np.arange(1, 257, dtype=np.uint16)
LETTERS_LOWER[0x41:0x5B] += 0x20
LETTERS_LOWER[_NOT_LETTERS] = 0


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(distinct texts by ``lang, k1, k2`` with their ``copies``: one (source, number) each; all groups ``lang, source``)."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    keyed = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text", F.length("text"))})
    copies = materialise(keyed.groupBy("lang", "k1", "k2", "source").agg(F.count("*").alias("n")))
    by_text = copies.groupBy("lang", "k1", "k2").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = keyed.groupBy("lang", "k1", "k2").agg(F.first("text").alias("text"))
    return texts.join(by_text, ["lang", "k1", "k2"]).select("lang", "text", "copies"), copies.select("lang", "source").distinct()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, int, int]]:
    """(terms, the text each is in, first text, number of texts) of about ``BLOCK_BYTES`` of texts at a time."""
    data, ends, texts, size, first, count = [], [], [], 0, 0, 0

    def block() -> tuple[pa.Array, np.ndarray, int, int]:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(ends))])
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])
        return terms, np.concatenate(texts), first, count

    for chunk in text_chunks(batch.column("text")):
        words = find_words(chunk, LETTERS_LOWER)
        folded = LETTERS_LOWER[chunk.data]
        data.append((folded[folded > 0] - 1).astype(np.uint8))
        ends.append(words.end - words.start)
        texts.append(words.text + count)
        count += len(chunk)
        size += len(chunk.data)
        if size >= BLOCK_BYTES:
            yield block()
            first, count = first + count, 0
            data, ends, texts, size = [], [], [], 0
    if count:
        yield block()


def _grouped(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sum of each weight by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *[np.add.reduceat(weight[order], first) for weight in weights]


def _count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), added up over each block of texts."""
    copies = batch.column("copies")
    bounds = copies.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    held = copies.flatten()
    source, number = held.field("source").dictionary_encode(), held.field("n").to_numpy(zero_copy_only=False)
    langs = batch.column("lang").dictionary_encode()
    lang_of = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
    group = lang_of * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    for terms, text, first, _ in _blocks(batch):
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        width = len(coded.dictionary)
        key, times = _grouped(text * width + coded.indices.to_numpy(zero_copy_only=False), np.ones(len(text), np.int64))
        row, term = key // width + first, key % width
        sizes = np.diff(bounds)[row]
        entry = np.repeat(bounds[row] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        weight = number[entry]
        key, n, docs = _grouped(group[entry] * width + np.repeat(term, sizes), np.repeat(times, sizes) * weight, weight)
        where, term = key // width, key % width
        yield pa.RecordBatch.from_pydict(
            {
                "lang": langs.dictionary.take(pa.array(where // len(source.dictionary))),
                "source": source.dictionary.take(pa.array(where % len(source.dictionary))),
                "term": pc.cast(coded.dictionary.take(pa.array(term)), pa.large_string()).cast(pa.string()),
                "n": pa.array(n),
                "docs": pa.array(docs),
            }
        )


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    rows = map_batches(texts, _count_batch, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; NULL without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.floor(F.try_divide((wide(count) + 1) * SCALE, wide(total) + wide(kept)))
    # the quotient is rounded to its scale: exact floors need the remainder's sign
    over = whole.cast("decimal(38,0)") * (wide(total) + wide(kept)) > (wide(count) + 1) * SCALE
    return (whole - F.when(over, 1).otherwise(0)).cast("bigint") + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class _Sums:
    """Values by (lang, source, other), merged now and then so that few are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.parts.append(_grouped(key, value))
        self.held += len(self.parts[-1][0])
        if self.held > BLOCK_CELLS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, value = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = [_grouped(key, value)]
        self.held = len(self.parts[0][0])
        return self.parts[0]


_PAIR = "lang string, source string, other string, value bigint"


def _shared_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At terms that several sources have: what both shares add beyond each against the other's p0."""
    members = batch.column("members")
    bounds = members.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    held = members.flatten()
    source = held.field("source").dictionary_encode()
    code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p, p0 = (held.field(name).to_numpy(zero_copy_only=False) for name in ("p", "p0"))
    langs = batch.column("lang").dictionary_encode()
    lang, sizes, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds), len(source.dictionary)
    sums = _Sums()
    for k in np.unique(sizes[sizes > 1]).tolist():
        rows = np.flatnonzero(sizes == k)
        step = max(BLOCK_CELLS // (k * k), 1)
        for part in np.split(rows, range(step, len(rows), step)):
            # one member against all others at a time where a single term passes the block
            width = k if k * k <= BLOCK_CELLS else max(BLOCK_CELLS // k, 1)
            for a in range(0, k, width):
                mine = bounds[part][:, None] + np.arange(a, min(a + width, k))
                theirs = bounds[part][:, None] + np.arange(k)
                ps, qs, p0s, q0s = p[mine][:, :, None], p[theirs][:, None, :], p0[mine][:, :, None], p0[theirs][:, None, :]
                value = _divergence(ps, qs) - _divergence(ps, q0s) - _divergence(p0s, qs) + _divergence(p0s, q0s)
                key = (lang[part][:, None, None] * names + code[mine][:, :, None]) * names + code[theirs][:, None, :]
                apart = mine[:, :, None] != theirs[:, None, :]
                sums.add(key[apart], value[apart])
    key, value = sums.merge()
    if len(key):
        yield pa.RecordBatch.from_pydict(
            {
                "lang": langs.dictionary.take(pa.array(key // (names * names))),
                "source": source.dictionary.take(pa.array(key // names % names)),
                "other": source.dictionary.take(pa.array(key % names)),
                "value": pa.array(value),
            }
        )


def _lone_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For a source and each other one: V f(p0, q0), and what its own terms add against absent ones, either way."""
    for row in batch.to_pylist():
        names = [other["source"] for other in row["others"]]
        apart = np.array([name != row["source"] for name in names])
        value = [np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)]
        if row["kept"]:
            q0 = np.array([other["p0"] for other in row["others"]], np.int64)
            p0 = np.int64(row["p0"])
            value[0] += row["kept"] * _divergence(p0, q0)
            shares = row["shares"] or []
            p, times = (np.array([share[name] for share in shares], np.int64) for name in ("p", "terms"))
            step = max(BLOCK_CELLS // max(len(names), 1), 1)
            for a in range(0, len(p), step):
                some, many = p[a : a + step, None], times[a : a + step, None]
                value[0] += (many * (_divergence(some, q0) - _divergence(p0, q0))).sum(0)
                value[1] += (many * (_divergence(q0, some) - _divergence(q0, p0))).sum(0)
        others = pa.array([name for name in names if name != row["source"]], pa.string())
        mine = pa.array([row["source"]] * len(others), pa.string())
        lang = pa.array([row["lang"]] * len(others), pa.string())
        for pair, amount in (((mine, others), value[0]), ((others, mine), value[1])):
            yield pa.RecordBatch.from_pydict({"lang": lang, "source": pair[0], "other": pair[1], "value": pa.array(amount[apart])})


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    """Ranks within each group: value falling, item rising by its bytes."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    named = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value")
    return named.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources of a language by divergence, and each source's own terms."""
    texts, groups = collapse(docs, text, lang, source)
    counts = materialise(term_counts(texts))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    kept = materialise(counts.select("lang", "source", "term", "n").join(by_term.select("lang", "term", "lang_n"), ["lang", "term"]))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(vocabulary, "lang")
    zero = F.lit(0).cast("bigint")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(name, zero).alias(name) for name in ("total", "kept", "lang_total")])
    groups = materialise(groups.withColumn("p0", _share(zero, F.col("total"), F.col("kept"))))

    shares = kept.join(groups, ["lang", "source"]).withColumns(
        {"p": _share(F.col("n"), F.col("total"), F.col("kept")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}
    )
    shares = materialise(shares.select("lang", "source", "term", "p", "p0", "q"))
    apart = F.col("p") - F.col("q")
    terms = shares.filter(apart > 0).select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    members = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("members")).filter(F.size("members") > 1)
    shared = map_batches(members.select("lang", "members"), _shared_batch, _PAIR)
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    histogram = histogram.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("shares"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    lone = groups.select("lang", "source", "kept", "p0").join(histogram, ["lang", "source"], "left").join(others, "lang")
    pairs = map_batches(lone, _lone_batch, _PAIR).unionByName(shared).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    return _ranked(pairs.withColumnRenamed("other", "item"), "pair").unionByName(_ranked(terms, "term").filter(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of documents, and of their terms."""
    return source_divergence(read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS number, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT number, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT number) >= 3
), vocabulary AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), sources AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), shares AS (
  SELECT sources.lang, sources.source, kept.term, coalesce(counts.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(counts.n, 0) + 1) // (coalesce(totals.total, 0) + v))::HUGEINT AS p,
    (1 + 1000000000::HUGEINT * (kept.n + 1) // (vocabulary.total + v))::HUGEINT AS q
  FROM sources JOIN vocabulary USING (lang) JOIN kept USING (lang)
    LEFT JOIN counts ON counts.lang = sources.lang AND counts.source = sources.source AND counts.term = kept.term
    LEFT JOIN totals ON totals.lang = sources.lang AND totals.source = sources.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""
