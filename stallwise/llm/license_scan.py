"""License scan: an exact set-similarity join of text blocks with license templates.

A template is a run of words and a share of its distinct words that a text block must hold
(containment). The blocks of a text are all runs of as many words as the template has; what
stands fewer words before the end of the text is a shorter block. Every block that meets the
threshold is found, by filters that lose none:

* the template's distinct words are ordered by their count over the whole table, rarest first;
* prefix filter: a block with ``need`` of ``n`` words holds one of the ``n - need + 1`` rarest,
  so only blocks around those words are looked at;
* length filter: a text, and a block cut by the text's end, needs ``need`` words at least;
* positional filter: where the rarest word found is the i-th of the template, only ``n - i``
  can be there.

Blocks that pass are counted in full. A ``phrase`` template asks for its words in order without
gaps; there ``need = n`` and only its rarest word is looked up.

Defined results: NULL and empty texts have no words and no blocks; a template met more than once
gives a block for each place; repeated rows are scanned each; an empty table gives an empty
result; NULL ids pass through; other columns are not read. Templates are few (at most
``MAX_TEMPLATE_WORDS`` words each); the counts brought to the driver are one per template word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import map_batches, read
from stallwise.llm.words import ALNUM_LOWER, Words, find_words, text_chunks

MAX_TEMPLATE_WORDS = 63
CONTAINMENT = 0.8

# Phrases and labels that a license scan must report.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Sentences of well-known public license notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced without prior written permission"),
]


@dataclass(frozen=True)
class Template:
    """Words of a license notice; ``phrase`` asks for them in order, without gaps."""

    label: str
    words: tuple[str, ...]
    containment: float = CONTAINMENT
    phrase: bool = False

    def __post_init__(self):
        if not 1 <= len(self.words) <= MAX_TEMPLATE_WORDS:
            raise ValueError(f"a template has 1 to {MAX_TEMPLATE_WORDS} words")

    @property
    def distinct(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        share = 1.0 if self.phrase else self.containment
        return max(1, ceil(share * len(self.distinct) - 1e-9))


def phrases(pairs: Sequence[tuple[str, str]]) -> list[Template]:
    return [Template(label, tuple(text.split()), 1.0, True) for label, text in pairs]


def notices(pairs: Sequence[tuple[str, str]], containment: float = CONTAINMENT) -> list[Template]:
    return [Template(label, tuple(text.split()), containment) for label, text in pairs]


class _Vocabulary:
    """Numbers of the template words, found by hash; a small table rules most words out."""

    def __init__(self, words: Sequence[str]):
        hashes = self._hash(words)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _hash(words: Sequence[str]) -> np.ndarray:
        (chunk,) = text_chunks(pa.array([" ".join(words)]))
        found = find_words(chunk, ALNUM_LOWER)
        if len(found.hash) != len(words):
            raise ValueError("template words must be words of the scan")
        return found.hash

    def find(self, hashes: np.ndarray) -> np.ndarray:
        numbers = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self._maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        numbers[maybe[hit]] = self.numbers[at[hit]]
        return numbers


def _count_batch(batch: pa.RecordBatch, vocabulary: _Vocabulary, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size + 1, np.int64)
    for chunk in text_chunks(batch.column(0)):
        total += np.bincount(vocabulary.find(find_words(chunk, ALNUM_LOWER).hash) + 1, minlength=size + 1)
    yield pa.RecordBatch.from_pydict({"number": pa.array(range(size), pa.int32()), "n": pa.array(total[1:])})


def word_counts(docs: DataFrame, text: str, words: Sequence[str]) -> list[int]:
    """How often each of a few words stands in the whole table."""
    rows = map_batches(
        docs.select(F.col(text).cast("string")),
        partial(_count_batch, vocabulary=_Vocabulary(words), size=len(words)),
        "number int, n bigint",
    )
    counts = {r["number"]: r["n"] for r in rows.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    return [counts.get(i, 0) for i in range(len(words))]


@dataclass(frozen=True)
class _Plan:
    """A template in numbers: its words by place, and its distinct words rarest first."""

    template: Template
    places: np.ndarray
    ordered: np.ndarray

    @property
    def prefix(self) -> np.ndarray:
        return self.ordered[: len(self.ordered) - self.template.need + 1]


def _blocks(plan: _Plan, numbers: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, distinct template words) of the blocks that meet the threshold."""
    width, need, n = len(plan.places), plan.template.need, len(plan.ordered)
    rank = np.full(size + 1, -1, np.int64)
    rank[plan.ordered] = np.arange(n)
    ranks = rank[numbers]  # -1, also where numbers is -1: the last entry
    rare = np.flatnonzero((ranks >= 0) & (ranks < n - need + 1))
    first = words.firsts()
    rare = rare[words.counts[words.text[rare]] >= need]  # length filter on the text
    if not len(rare):
        return rare, rare
    if plan.template.phrase:
        spots = np.flatnonzero(plan.places == plan.ordered[0])
        starts = (rare[:, None] - spots[None, :]).ravel()
        text = np.repeat(words.text[rare], len(spots))
    else:
        starts = (rare[:, None] - np.arange(width)[None, :]).ravel()
        text = np.repeat(words.text[rare], width)
    inside = starts >= first[text]
    starts, picked = np.unique(starts[inside], return_index=True)
    text = text[inside][picked]
    left = np.minimum(first[text] + words.counts[text] - starts, width)
    enough = left >= (width if plan.template.phrase else need)  # length filter on the block
    starts, left = starts[enough], left[enough]
    reach = starts[:, None] + np.arange(width)[None, :]
    within = np.arange(width)[None, :] < left[:, None]
    reach[~within] = 0
    if plan.template.phrase:
        same = (numbers[reach] == plan.places[None, :]).all(axis=1)
        return starts[same], np.full(int(same.sum()), n)
    held = np.where(within, ranks[reach], -1)
    lowest = np.where(held >= 0, held, n).min(axis=1)
    possible = n - lowest >= need  # positional filter
    starts, held = starts[possible], held[possible]
    bits = np.where(held >= 0, np.uint64(1) << held.clip(0).astype(np.uint64), np.uint64(0))
    found = np.bitwise_count(np.bitwise_or.reduce(bits, axis=1)).astype(np.int64)
    met = found >= need
    return starts[met], found[met]


_BLOCK = pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())])
_BLOCKS_SQL = "array<struct<template:int,first_word:bigint,words:int,containment:double>>"


def _scan_batch(batch: pa.RecordBatch, plans: list[_Plan], vocabulary: _Vocabulary, size: int) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batch.column("text")):
        words = find_words(chunk, ALNUM_LOWER)
        numbers = vocabulary.find(words.hash)
        found: list[list[dict]] = [[] for _ in range(len(chunk))]
        first = words.firsts()
        for number, plan in enumerate(plans):
            starts, held = _blocks(plan, numbers, words, size)
            for start, count in zip(starts.tolist(), held.tolist()):
                text = int(words.text[start])
                found[text].append(
                    {"template": number, "first_word": start - int(first[text]), "words": len(plan.places), "containment": count / len(plan.ordered)}
                )
        keys = batch.column("id").slice(chunk.first, len(chunk))
        yield pa.RecordBatch.from_pydict({"id": keys, "n_words": pa.array(words.counts), "blocks": pa.array(found, pa.list_(_BLOCK))})


def scan_licenses(docs: DataFrame, templates: Sequence[Template], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, and ``blocks``, every text block that
    meets a template's threshold (template number, first word from 0, words, containment)."""
    templates = list(templates)
    vocabulary_words = sorted({word for t in templates for word in t.words})
    counts = word_counts(docs, text, vocabulary_words)
    number = {word: i for i, word in enumerate(vocabulary_words)}
    plans = [
        _Plan(
            t,
            np.array([number[w] for w in t.words], np.int32),
            np.array(sorted((number[w] for w in t.distinct), key=lambda i: (counts[i], i)), np.int64),
        )
        for t in templates
    ]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scan = partial(_scan_batch, plans=plans, vocabulary=_Vocabulary(vocabulary_words), size=len(vocabulary_words))
    found = map_batches(rows, scan, f"id {kind}, n_words bigint, blocks {_BLOCKS_SQL}")
    return found.withColumnRenamed("id", doc_id)


def _joined_labels(numbers, labels: Sequence[str]):
    """Distinct labels of template numbers, sorted and comma-joined."""
    names = F.array(*[F.lit(label) for label in labels])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(numbers, lambda i: F.get(names, i)))), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in all documents: the base phrases' places, and labels of all templates."""
    base = phrases(BASE_PHRASES)
    templates = base + notices(NOTICES)
    labels = [t.label for t in templates]
    scanned = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), templates)
    base_blocks = F.filter("blocks", lambda b: b["template"] < len(base))
    places = F.transform(base_blocks, lambda b: b["first_word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base_blocks).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _joined_labels(F.transform(base_blocks, lambda b: b["template"]), labels).alias("base_labels"),
        _joined_labels(F.transform("blocks", lambda b: b["template"]), labels).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)).alias("score"),
    )


def _template_rows() -> str:
    """The templates as SQL rows: number, label, word, width, distinct words, words needed, phrase."""
    templates = phrases(BASE_PHRASES) + notices(NOTICES)
    return ",\n".join(
        f"({i}, '{t.label}', '{' '.join(t.words)}', {t.need}, {str(t.phrase).lower()})" for i, t in enumerate(templates)
    )


OP1_SQL = f"""
WITH templates(t, label, phrase_text, need, is_phrase) AS (VALUES
{_template_rows()}
), shapes AS (
  SELECT *, string_split(phrase_text, ' ') AS ws, len(string_split(phrase_text, ' ')) AS width,
    len(list_distinct(string_split(phrase_text, ' '))) AS n FROM templates
), texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts
), template_words AS (
  SELECT DISTINCT t, width, n, need, unnest(ws) AS word FROM shapes WHERE NOT is_phrase
), starts AS (
  SELECT doc_id, t, n, need, p.word, unnest(range(greatest(pos - width + 1, 0), pos + 1)) AS start
  FROM places p JOIN template_words USING (word)
), notice_blocks AS (
  SELECT doc_id, t, start, count(DISTINCT word) / any_value(n) AS containment
  FROM starts GROUP BY doc_id, t, start HAVING count(DISTINCT word) >= any_value(need)
), phrase_blocks AS (
  SELECT doc_id, t, pos AS start, 1.0::DOUBLE AS containment
  FROM places JOIN texts USING (doc_id) JOIN shapes ON is_phrase AND word = ws[1]
  WHERE words[pos + 1:pos + width] = ws
), blocks AS (
  SELECT * FROM notice_blocks UNION ALL SELECT * FROM phrase_blocks
), labelled AS (
  SELECT doc_id, count(*) FILTER (WHERE is_phrase) AS n_base,
    min(start) FILTER (WHERE is_phrase) AS first_word, max(start) FILTER (WHERE is_phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_phrase) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
  FROM blocks JOIN shapes USING (t) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN labelled USING (doc_id)
"""
