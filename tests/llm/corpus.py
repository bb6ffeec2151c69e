"""Small document tables and brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: NULL ids, NULL and empty texts, wordless texts, repeated rows, and an id with two texts.
EDGES = [
    (None, None),
    (None, "null id with a text of its own"),
    (1, ""),
    (2, None),
    (3, "... !!! \n\t "),
    (4, "one"),
    (5, "the same row twice over and again"),
    (5, "the same row twice over and again"),
    (5, "another text under the same id here"),
    (6, "É ünïcode \U0001f600 wörds ß ǅ İ \x00 end"),
]


def documents(spark, rows, **extra):
    """A documents table; ``extra`` columns have one value each."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(rows), "doc_id bigint, text string")
    return df.withColumns({name: F.lit(value) for name, value in extra.items()}) if extra else df


def lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return WORD.findall(lower(text))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def bag(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def classes(rows, threshold=0.8):
    """Class of each row by all pairs: the least id of its component; wordless rows stand alone."""
    bags = [bag(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= threshold - 1e-12:
                parent[find(i)] = find(j)
    members: dict[int, list[int]] = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    return [sorted(members[find(i)]) for i in range(len(rows))]


def repeated_bytes(rows, length=100):
    """Bytes covered by a string that starts earlier; rows are (id, bytes) with distinct ids."""
    seen = set()
    out = {}
    for key, raw in sorted(rows):
        again = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            string = raw[i : i + length]
            if string in seen:
                again[i : i + length] = [True] * length
            seen.add(string)
        out[key] = again
    return out


def runs(flags):
    return [(m.start(), m.end()) for m in re.finditer("1+", "".join("1" if f else "0" for f in flags))]


def rng(seed=0):
    return random.Random(seed)
