"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other alphabets and full-width forms
to Latin ones, digits to the letters they stand in for, and ``@ $ !`` likewise between letters.
The folded words, with one space around each, run through the automaton once. It holds lexicon
entries (whole words and beginnings of words) and exception phrases; a hit inside an exception
phrase does not count, and of several entries in one word the heaviest counts.

A text's sums of weights are normalised by its length, and a logistic map calibrated on labelled
texts turns them into the score.

The lexicon is learned from at most ``TRAIN_ROWS`` labelled rows chosen by a hash of the id: half
of them (by that hash) give an entry's weight, the log of how much more often toxic texts hold it
than others, and the other half the calibration. An entry needs ``MIN_TOXIC`` toxic texts, and a
weight ``MIN_SIGMAS`` standard errors above zero.

Defined results: NULL and empty texts have no words and score as other texts without hits; without labels
of both kinds every text scores the prior; rows of ``labels`` with a NULL id or label, or without a
document, are not used; repeated rows are scored each; an empty table gives an empty result; NULL
ids are scored; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial
from math import log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import held_out, map_batches, read

TRAIN_ROWS = 12_000
MIN_TOXIC = 5
MIN_WEIGHT = 1.0
MIN_SIGMAS = 4.0
BEGINNINGS = range(4, 9)  # letters of a word's beginning
SAID_BY_LONGER = 0.9  # a beginning goes where one longer entry has this share of its texts
PREDICTED_FROM = 0.7
PRIOR = 0.1

# Harmless phrases of words that may be insults.
EXCEPTION_PHRASES = ("trash can", "trash bin", "trash bag", "trash collection", "class clown", "clown fish", "circus clown", "pond scum")

# Letters that look like Latin ones, and digits that stand in for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "и": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "i"}

_FOLD = {ord(a): b for a, b in (LOOK_ALIKES | DIGITS).items()}
_FOLD |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(0x5E)}  # full width
_FOLD |= {0xFF10 + int(d): letter for d, letter in DIGITS.items()}
_FOLD |= {0x200B: None, 0x200C: None, 0x200D: None, 0x00AD: None, 0xFEFF: None}  # invisible
_BETWEEN = re.compile(r"(?<=\w)[@$!](?=\w)")
_NOT_WORD = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """The folded words of a text, each with one space before and after."""
    folded = text.lower().translate(_FOLD)
    folded = _BETWEEN.sub(lambda m: SYMBOLS[m[0]], folded)
    return f" {_NOT_WORD.sub(' ', folded).strip()} "


def _terms(folded: str) -> set[str]:
    """Candidate entries of a text: ' word ' and ' beginning'."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in BEGINNINGS if n < len(word))
    return out


@dataclass
class Toxicity:
    """Lexicon weights, exception phrases and the calibrated map from features to a score."""

    lexicon: dict[str, float]
    exceptions: Sequence[str] = EXCEPTION_PHRASES
    means: np.ndarray = field(default_factory=lambda: np.zeros(4))
    spreads: np.ndarray = field(default_factory=lambda: np.ones(4))
    slopes: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0, log(PRIOR / (1 - PRIOR))]))

    def __getstate__(self):
        return {name: value for name, value in self.__dict__.items() if name != "automaton"}

    @cached_property
    def automaton(self):
        import ahocorasick

        built = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            built.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = fold(phrase)
            built.add_word(entry, (len(entry), None))
        if len(built):
            built.make_automaton()
        return built

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of the heaviest entry by the place of the word it is in."""
        if not len(self.automaton):
            return {}
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            begin = end - size + 1
            if weight is None:
                excused.append((begin, end))
            elif weight > found.get(begin, 0.0):
                found[begin] = weight
        for begin, end in excused:
            for place in [p for p in found if begin <= p < end]:
                del found[place]
        return found

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        folded = fold(text or "")
        weights = self.hits(folded)
        times = Counter((folded[p : folded.find(" ", p + 1)], weight) for p, weight in weights.items())
        # a word said again adds less and less
        total, words = sum(weight * log1p(n) for (_, weight), n in times.items()), max(folded.count(" ") - 1, 1)
        return total / sqrt(words), max(weights.values(), default=0.0), log1p(len(times)), total / words

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.means) / self.spreads
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.slopes[:-1] + self.slopes[-1], -40, 40)))


def _term_batch(batch: pa.RecordBatch, known: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch hold each term; with ``known``, only those terms."""
    counts: Counter[str] = Counter()
    for text in batch.column(0):
        terms = _terms(fold(text.as_py() or ""))
        counts.update(terms if known is None else terms & known)
    yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def _feature_batch(batch: pa.RecordBatch, shared) -> Iterator[pa.RecordBatch]:
    model: Toxicity = shared.value
    rows = np.array([model.features(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, 4)
    kept = {name: batch.column(name) for name in batch.schema.names if name != "text"}
    yield pa.RecordBatch.from_pydict(kept | {f"f{i}": pa.array(rows[:, i]) for i in range(4)})


def _score_batch(batch: pa.RecordBatch, shared) -> Iterator[pa.RecordBatch]:
    model: Toxicity = shared.value
    rows = np.array([model.features(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, 4)
    kept = {name: batch.column(name) for name in batch.schema.names if name != "text"}
    yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(model.scores(rows))})


def learn_lexicon(toxic: DataFrame, clean: DataFrame) -> dict[str, float]:
    """Weights of the terms that tell toxic texts (a column of texts) from clean ones."""
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    counted = map_batches(toxic, partial(_term_batch, known=None), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    often = {r["term"]: r["n"] for r in counted.filter(F.col("n") >= MIN_TOXIC).collect()}  # of a bounded sample
    known = frozenset(often)
    counted = map_batches(clean, partial(_term_batch, known=known), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    elsewhere = {r["term"]: r["n"] for r in counted.collect()}
    longest = Counter()
    for term, n in often.items():
        for size in BEGINNINGS:
            if size + 1 < len(term):
                longest[term[: size + 1]] = max(longest[term[: size + 1]], n)
    weights = {}
    for term, n in often.items():
        if longest[term] >= SAID_BY_LONGER * n:
            continue
        a, b = n + 0.5, elsewhere.get(term, 0) + 0.5
        weight = log(a / (n_toxic + 1)) - log(b / (n_clean + 1))
        if weight >= MIN_WEIGHT and weight >= MIN_SIGMAS * sqrt(1 / a + 1 / b):
            weights[term] = weight
    return dict(sorted(weights.items(), key=lambda item: (-item[1], item[0])))


def _calibrate(model: Toxicity, features: np.ndarray, label: np.ndarray) -> None:
    """Ridge logistic regression on the standardised features, by Newton steps.

    More of a feature never lowers the score: a feature that would get a negative slope is left out.
    """
    if len(np.unique(label)) < 2:
        return
    model.means, model.spreads = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = (features - model.means) / model.spreads
    used = list(range(x.shape[1]))
    while True:
        slopes = _logistic(np.column_stack([x[:, used], np.ones(len(label))]), label)
        if not used or slopes[:-1].min() >= 0:
            break
        del used[int(slopes[:-1].argmin())]
    model.slopes = np.zeros(x.shape[1] + 1)
    model.slopes[[*used, -1]] = slopes


def _logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    slopes = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-9]) * len(label) * 0.01
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ slopes, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - label) + ridge @ slopes)
        slopes = slopes - np.clip(step, -2, 2)
    return slopes


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    exceptions: Sequence[str] = EXCEPTION_PHRASES, train_rows: int = TRAIN_ROWS,
) -> Toxicity:
    """Learn the lexicon and its calibration from a bounded sample of labelled texts."""
    usable = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    drawn = usable.select(F.xxhash64(F.col(doc_id)).alias("draw"), F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    sample = drawn.orderBy("draw", "id", "label").limit(train_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # the sample is bounded, and so are its texts: one of each id, whatever copies there are
    joined = texts.join(F.broadcast(sample), "id").groupBy("draw", "id", "label").agg(F.min("text").alias("text")).drop("id")
    half = F.pmod(F.shiftright("draw", 20), F.lit(2))
    words = joined.filter(half == 0)
    model = Toxicity(learn_lexicon(words.filter("label = 1").select("text"), words.filter("label = 0").select("text")), exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = map_batches(joined.filter(half == 1), partial(_feature_batch, shared=shared), "draw bigint, label int, f0 double, f1 double, f2 double, f3 double")
    table = rows.toArrow().sort_by([("draw", "ascending"), ("label", "ascending")])
    features = np.column_stack([table[f"f{i}"].to_numpy() for i in range(4)])
    _calibrate(model, features, table["label"].to_numpy().astype(np.float64))
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``score``."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(rows, partial(_score_batch, shared=shared), f"id {kind}, score double").withColumnRenamed("id", doc_id)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a lexicon learned outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 3, 1)
    model = fit_toxicity(docs, read(spark, sf_dir, "labels").filter(~held))
    scored = score_toxicity(docs, model)
    predicted = F.when(F.col("score") >= PREDICTED_FROM, 1).otherwise(0)
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))
