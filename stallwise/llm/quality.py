"""Quality rules: a calibrated logistic regression on hashed n-grams, beside fixed text rules.

Features are word 1- and 2-grams and character 2- and 4-grams, hashed to ``BUCKETS`` buckets;
each family is normalised by its number of n-grams. The regression is fitted in one task on
at most ``TRAIN_ROWS`` labelled rows (chosen by a hash of the id, so the same ones at any
partitioning), and only its weights reach the driver; a quarter of the rows is held back to calibrate
its output to a probability. All texts are then scored in Arrow batches. A text is kept when no fixed rule fails and the
probability of good quality reaches ``KEEP_PROBABILITY``.

Defined results: NULL and empty texts have no words, fail the rule of fewest words and score the
model's prior; without labelled rows of both kinds the model gives ``PRIOR`` for every text, so
only the fixed rules decide; rows of ``labels`` with a NULL id or label, or without a document, are
not used; repeated rows are scored each; an empty table gives an empty result. Long texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import map_batches, read, unpacked, whole_row
from stallwise.llm.words import SPACED, Chunk, SpanHashes, Words, find_words, mix, text_chunks, window_hashes

BUCKETS = 1 << 16
TRAIN_ROWS = 2000
CALIBRATION_SHARE = 4  # one of so many training rows
KEEP_PROBABILITY = 0.5
PRIOR = 0.5
WORD_GRAMS = (1, 2)
CHAR_GRAMS = (2, 4)

# The base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_SCALE = 30.0
_FAMILIES = len(WORD_GRAMS) + len(CHAR_GRAMS)
_SHIFT = np.uint64(64 - (BUCKETS.bit_length() - 1))


@dataclass(frozen=True)
class Family:
    """Buckets of one kind of n-gram; text i has those from ``first[i]`` to ``last[i]``."""

    buckets: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _buckets(hashes: np.ndarray, family: int) -> np.ndarray:
    return (mix(hashes + np.uint64(family + 1)) >> _SHIFT).astype(np.int64)


def families(chunk: Chunk, words: Words) -> list[Family]:
    """All n-grams of a chunk; entries between two texts belong to none."""
    out = []
    begin, end = words.firsts(), words.firsts() + words.counts
    for n in WORD_GRAMS:
        hashes = np.zeros(len(words.hash), np.uint64)
        for k in range(n):
            reach = max(len(hashes) - k, 0)
            hashes[:reach] += words.hash[k : k + reach] * np.uint64(2 * k * 0x9E3779B9 + 1)
        out.append(Family(_buckets(hashes, len(out)), begin, np.maximum(end - n + 1, begin)))
    chars = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    spans = SpanHashes(chunk.data)
    bounds = np.searchsorted(chars, chunk.offsets)
    ends = np.append(chars, np.full(max(CHAR_GRAMS), len(chunk.data)))
    for n in CHAR_GRAMS:
        hashes = spans(chars, ends[n : n + len(chars)])
        out.append(Family(_buckets(hashes, len(out)), bounds[:-1], np.maximum(bounds[1:] - n + 1, bounds[:-1])))
    return out


@dataclass(frozen=True)
class Model:
    """Weights of each family, and the map from a margin to a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, found: list[Family]) -> np.ndarray:
        total = np.full(len(found[0].first), self.bias)
        for family, weights in zip(found, self.weights):
            sums = np.zeros(len(family.buckets) + 1)
            np.cumsum(weights[family.buckets], out=sums[1:])
            size = np.maximum(family.last - family.first, 1)
            total += _SCALE * (sums[family.last] - sums[family.first]) / size
        return total

    def probabilities(self, found: list[Family]) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(found) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _sample_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Sparse features of labelled texts: bucket numbers over all families, and values."""
    for chunk in text_chunks(batch.column("text")):
        found = families(chunk, find_words(chunk, SPACED))
        numbers, values = [], []
        for i in range(len(chunk)):
            at, share = [], []
            for k, family in enumerate(found):
                size = int(family.last[i] - family.first[i])
                bucket, count = np.unique(family.buckets[family.first[i] : family.last[i]], return_counts=True)
                at.append(bucket + k * BUCKETS)
                share.append(count * (_SCALE / max(size, 1)))
            numbers.append(np.concatenate(at).astype(np.int32))
            values.append(np.concatenate(share).astype(np.float32))
        rows = slice(chunk.first, chunk.first + len(chunk))
        yield pa.RecordBatch.from_pydict(
            {
                "draw": batch.column("draw").slice(rows.start, len(chunk)),
                "label": batch.column("label").slice(rows.start, len(chunk)),
                "numbers": pa.array(numbers, pa.list_(pa.int32())),
                "amounts": pa.array(values, pa.list_(pa.float32())),
            }
        )


def training_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids (draw, id, label), chosen by a hash of the id."""
    usable = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    drawn = usable.select(F.xxhash64(F.col(doc_id)).alias("draw"), F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    return drawn.orderBy("draw", "id", "label").limit(limit)


def training_features(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """(draw, label, numbers, amounts): the features of the labelled texts that the model is fitted on."""
    sample = training_rows(docs, labels, label, doc_id, train_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # the sample is bounded, and so are its texts: one of each id, whatever copies there are
    joined = texts.join(F.broadcast(sample), "id").groupBy("draw", "id", "label").agg(F.min("text").alias("text")).drop("id")
    return map_batches(joined, _sample_batch, "draw bigint, label int, numbers array<int>, amounts array<float>")


def fit_quality_model(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS
) -> Model:
    """Fit and calibrate on a bounded sample of the labelled texts, in one task."""
    rows = training_features(docs, labels, label, doc_id, text, train_rows).repartition(1).sortWithinPartitions("draw", "label")
    fitted = rows.mapInArrow(_fit_partition, "weights binary, bias double, slope double, shift double").first()
    if fitted is None:  # without labelled texts there is no task
        return _unfitted()
    weights = np.frombuffer(fitted["weights"], np.float32).reshape(_FAMILIES, BUCKETS)
    return Model(weights, fitted["bias"], fitted["slope"], fitted["shift"])


def _fit_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("draw", pa.int64()), ("label", pa.int32()), ("numbers", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float32()))])
    model = _fit(pa.Table.from_batches([batch.cast(schema) for batch in batches], schema))
    fitted = {"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}
    yield pa.RecordBatch.from_pylist([fitted])


def _unfitted() -> Model:
    return Model(np.zeros((_FAMILIES, BUCKETS), np.float32), 0.0, 0.0, float(np.log(PRIOR / (1 - PRIOR))))


def _fit(table: pa.Table) -> Model:
    label = table["label"].to_numpy().astype(np.float64)
    held = np.arange(len(label)) % CALIBRATION_SHARE == 0
    if any(len(np.unique(label[part])) < 2 for part in (held, ~held)):
        return _unfitted()
    sample = _Sample(table)
    weights, bias = _logistic(sample, label, ~held)
    margin = sample.margins(weights) + bias
    slope, shift = _calibrate(margin[held], label[held])
    return Model(weights.reshape(_FAMILIES, BUCKETS).astype(np.float32), float(bias), slope, shift)


class _Sample:
    """Sparse rows of the training table, read in blocks so that sums over them need little memory."""

    def __init__(self, table: pa.Table):
        self._blocks = []
        for batch in table.select(["numbers", "amounts"]).to_batches(max_chunksize=100):
            numbers, amounts = batch.column(0), batch.column(1)
            sizes = np.diff(numbers.offsets.to_numpy())
            self._blocks.append((numbers.flatten().to_numpy(), amounts.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), len(sizes)))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of each row's values."""
        parts = [np.bincount(row, weights=weights[index] * value, minlength=rows) for index, value, row, rows in self._blocks]
        return np.concatenate(parts)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        """Sum over rows of their values times the row's error."""
        total, begin = np.zeros(_FAMILIES * BUCKETS), 0
        for index, value, row, rows in self._blocks:
            total += np.bincount(index, weights=value * error[begin : begin + rows][row], minlength=len(total))
            begin += rows
        return total


def _logistic(sample: _Sample, label: np.ndarray, used: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam over the used rows, classes weighted alike."""
    share = np.where(label == 1, 0.5 / label[used].mean(), 0.5 / (1 - label[used].mean())) * used / used.sum()
    weights, bias = np.zeros(_FAMILIES * BUCKETS), 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, rounds + 1):
        error = share * (_sigmoid(sample.margins(weights) + bias) - label)
        slope = np.append(sample.gradient(error) + ridge * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map (Platt, with smoothed targets), by Newton steps."""
    good, bad = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    centre, spread = margin.mean(), margin.std() + 1e-9
    x = np.stack([(margin - centre) / spread, np.ones(len(margin))], axis=1)
    at = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(50):
        p = _sigmoid(x @ at)
        slope = x.T @ (p - target) + 1e-6 * at
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        at -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    a = max(at[0], 0.0) / spread
    return float(a), float(at[1] - a * centre)


def _line_copies(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeat_words(words: Words, size: int) -> np.ndarray:
    """Per text, the words that stand in a window found twice or more in the text."""
    text, first, value = window_hashes(words, REPEAT_WINDOW)
    order = np.lexsort((value, text))
    text, first, value = text[order], first[order], value[order]
    same = (text[1:] == text[:-1]) & (value[1:] == value[:-1])
    twice = np.zeros(len(text), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edges, first[twice], 1)
    np.add.at(edges, first[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(words.text[covered], minlength=size)


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _score_batch(batch: pa.RecordBatch, model: Model, keep_probability: float) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batch.column("text")):
        words = find_words(chunk, SPACED)
        characters = _sums((chunk.data & 0xC0) != 0x80, chunk.offsets)
        spaces = _sums(SPACED[chunk.data] == 0, chunk.offsets)
        raw = chunk.data.tobytes()
        copies = [_line_copies(raw[a:b]) for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())]
        repeats = _repeat_words(words, len(chunk))
        failed = (words.counts < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words.counts)
        probability = model.probabilities(families(chunk, words))
        made = {
            "n_words": words.counts,
            "word_chars": characters - spaces,
            "n_symbols": _sums(_IS_SYMBOL[chunk.data], chunk.offsets),
            "n_dup_lines": np.array(copies, np.int64),
            "n_repeat_words": repeats,
            "base_failed": failed,
            "probability": probability,
            "kept": ~failed & (probability >= keep_probability),
        }
        rows = batch.column("row").slice(chunk.first, len(chunk))
        yield pa.RecordBatch.from_pydict({"row": rows} | {name: pa.array(values) for name, values in made.items()})


_VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


def judge_quality(docs: DataFrame, model: Model, text: str = "text", keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, beside its base counts, probability and verdict ``kept``."""
    rows = docs.select(whole_row(docs), F.col(text).cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {_VERDICT}"
    return map_batches(rows, partial(_score_batch, model=model, keep_probability=keep_probability), schema)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the rules or the model reject; all columns kept."""
    model = fit_quality_model(docs, labels, doc_id=doc_id, text=text)
    return unpacked(judge_quality(docs, model, text).filter("kept"), docs)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, calibrated probability and verdict for all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_model(docs, read(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return judge_quality(docs, model).select(F.col("row.doc_id").alias("doc_id"), *names)
