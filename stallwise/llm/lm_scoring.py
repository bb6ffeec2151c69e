"""Language-model scoring by a weighted backoff automaton.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end per text. All 1-, 2- and 3-grams of the
training texts are in the model, at any corpus size. Each order is smoothed by the next shorter one, with the weight
of ``STRENGTH`` occurrences: with c(h) the occurrences of a context and c(hw) those of a token after it,

    p(w | h) = (c(hw) + STRENGTH p(w | shorter h)) / (c(h) + STRENGTH),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

so the probabilities of all next tokens sum to 1. As an automaton: a state for each context that occurs, an arc
with log p(w | h) for each n-gram that occurs, and a failure arc with log (STRENGTH / (c(h) + STRENGTH)) to the next shorter
context, which stands for all n-grams that do not. One traversal from left to right carries the state and adds
up the log-probabilities; long texts are cut into pieces that start in their right state (it depends on the last two
tokens only) and all pieces of a part take their steps together.

How the work is spread. The whole model is never in one place. Texts go in parts of about ``PART_BYTES``:

* Ask: a part packs the keys of its distinct n-grams, with their occurrences in its training texts, in one sorted, delta-coded
  block per hash range, about five bytes each. A hot n-gram is one key of a part.
* Answer: a hash range's blocks meet in one task, which adds up the occurrences and sends every part the sums of its keys, in their
  order, at a byte or less each. Numbers of tokens and of distinct ones are added up on the way.
* Score: a part's texts and its answers meet in one task, which builds the automaton of the part's n-grams and traverses its texts.

Texts are found again by file and row, so the same parts come back however the files are split: a lost task's work is
simply done again. Texts that are not rows of parquet files are stored first.

N-grams are known by 56 bits of their hash. Defined results: a NULL or empty text is one end token; without
training texts every unigram has probability 1; repeated rows are counted and scored each; NULL ids are scored;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import held_out, materialise, read
from stallwise.llm.words import SPACED_LOWER, Chunk, find_words, mix, text_chunks

SMOOTHING = 0.1
STRENGTH = 4.0  # occurrences that the next shorter context counts for
GROUP_ROWS = 2048  # rows of a file whose texts meet their answers together
PART_BYTES = 1 << 23  # of texts, at which a part of a group ends
PIECE = 512  # tokens of a text that are traversed as one piece

START = np.uint64(0)
END = np.uint64(1)
_KEY_BITS = 56
_TOKENS, _LONGER = 0, 1  # kinds of keys
_ANSWER, _TEXT = 0, 1  # sides that meet in a part


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk's texts in order, each text's end included, and texts' bounds.

    A hash is the sum of one mixed value for each byte and place, so no arithmetic relation between words makes two agree.
    """
    words = find_words(chunk, SPACED_LOWER)
    bounds = np.zeros(len(chunk) + 1, np.int64)
    np.cumsum(words.counts + 1, out=bounds[1:])
    hashes = np.full(bounds[-1], END)
    if len(words.start):
        sizes = words.end - words.start
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)
        letters = SPACED_LOWER[chunk.data[np.repeat(words.start, sizes) + place]].astype(np.uint64)
        mixed = mix(letters * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        hashes[np.arange(len(first)) + words.text] = mix(np.add.reduceat(mixed, first)) | np.uint64(2)
    return hashes, bounds


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours: of tokens, a pair's; of pairs, a triple's."""
    return mix(mix(a) * np.uint64(0x9E3779B97F4A7C15) + b)


def _unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the number of each entry's."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    ranked = hashes[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(ranked), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ranked[fresh], which


class Grams:
    """The distinct n-grams of some texts, and which of them stands at each token."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        hashes, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for chunk in text_chunks(texts):
            own, ends = token_hashes(chunk)
            hashes.append(own)
            bounds.append(ends[1:] + bounds[-1][-1])
        tokens = np.concatenate(hashes)
        del hashes
        self.bounds = np.concatenate(bounds)
        self.text = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        self.tokens, self.token = _unique(tokens)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        self.first = np.zeros(len(tokens), bool)
        self.first[self.bounds[:-1]] = True
        before[self.first] = START
        pairs = _joint(before, tokens)
        del before, tokens
        self.pairs, self.pair = _unique(pairs)
        inside = ~self.first
        triples = _joint(pairs[:-1][inside[1:]], pairs[inside])
        del pairs
        self.triples, triple = _unique(triples)
        self.triple = np.full(len(inside), -1, np.int32)
        self.triple[inside] = triple

    def keys(self, kind: int) -> np.ndarray:
        kinds = [(self.tokens, 1)] if kind == _TOKENS else [(self.pairs, 2), (self.triples, 3)]
        return np.concatenate([mix(hashes + np.uint64(salt)) >> np.uint64(64 - _KEY_BITS) for hashes, salt in kinds]).astype(np.int64)

    def occurrences(self, kind: int, learn: np.ndarray) -> np.ndarray:
        """How often each key's n-gram stands in texts to learn from."""
        at = learn[self.text]
        count = lambda which, size: np.bincount(which, minlength=size)
        if kind == _TOKENS:
            return count(self.token[at], len(self.tokens))
        return np.concatenate([count(self.pair[at], len(self.pairs)), count(self.triple[at & ~self.first], len(self.triples))])


def _blocks(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the keys, bounds of each hash range in it)."""
    order = np.argsort(keys, kind="stable")
    block = (keys[order] >> 28) * blocks >> _KEY_BITS - 28
    return order, np.searchsorted(block, np.arange(blocks + 1))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first, then differences of one width."""
    steps = np.diff(keys, prepend=keys[:1])
    width = max((int(steps.max()).bit_length() + 7) // 8, 1)
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    width = packed[0]
    steps = np.zeros(((len(packed) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel().astype(np.int64)) + int.from_bytes(packed[1:9], "little")


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, and eight more for those that do not fit it."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(packed: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(packed, np.uint8, count=size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<i8", offset=size)
    return counts


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one group (columns ``file, bunch, place``), ended at ``PART_BYTES`` of texts."""
    held: list[pa.RecordBatch] = []
    size, of = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, bunch = batch.column("file").to_numpy(), batch.column("bunch").to_numpy()
        lengths = pa.compute.binary_length(batch.column("text").cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((file[1:] != file[:-1]) | (bunch[1:] != bunch[:-1])) + 1
        for begin, end in zip([0, *changes], [*changes, batch.num_rows]):
            if held and of != (file[begin], bunch[begin]):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            of = file[begin], bunch[begin]
            while begin < end:
                total = size + np.cumsum(lengths[begin:end])
                stop = begin + int(np.searchsorted(total, PART_BYTES)) + 1
                held.append(batch.slice(begin, min(stop, end) - begin))
                size = int(total[min(stop, end) - begin - 1])
                if stop <= end:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                begin = min(stop, end)
    if held:
        yield pa.Table.from_batches(held)


_ASKED = "block int, kind int, file bigint, bunch bigint, first bigint, last bigint, keys binary, counts binary"


def _ask_partition(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        grams = Grams(part["text"])
        learn = part["learn"].to_numpy(zero_copy_only=False).astype(bool)
        where = {"file": part["file"][0].as_py(), "bunch": part["bunch"][0].as_py(), "first": part["place"][0].as_py(), "last": part["place"][-1].as_py()}
        for kind in (_TOKENS, _LONGER):
            keys, counts = grams.keys(kind), grams.occurrences(kind, learn)
            order, bounds = _blocks(keys, blocks)
            keys, counts = keys[order], counts[order]
            rows = [
                {"block": b, "kind": kind, **where, "keys": pack_keys(keys[x:y]), "counts": pack_counts(counts[x:y])}
                for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:]))
                if y > x
            ]
            if rows:
                schema = pa.schema([(n, pa.int32()) for n in ("block", "kind")] + [(n, pa.int64()) for n in where] + [(n, pa.binary()) for n in ("keys", "counts")])
                yield pa.RecordBatch.from_pylist(rows, schema)


_ANSWERED = "block int, kind int, file bigint, bunch bigint, first bigint, last bigint, counts binary, tokens bigint, distinct bigint"


def _answer(rows: list[dict]) -> pa.RecordBatch:
    """The blocks of one hash range and kind: every part gets the sums of its keys."""
    keys = [unpack_keys(row["keys"]) for row in rows]
    sizes = np.array([len(k) for k in keys])
    counts = np.concatenate([unpack_counts(row["counts"], size) for row, size in zip(rows, sizes)])
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=counts).astype(np.int64) if counts.sum() < 1 << 53 else _whole_sums(which, counts)
    sums = np.split(total[which], np.cumsum(sizes)[:-1])
    kind = rows[0]["kind"]
    facts = [(int(total.sum()), int((total > 0).sum())) if kind == _TOKENS and i == 0 else (0, 0) for i in range(len(rows))]
    columns = {name: [row[name] for row in rows] for name in ("block", "kind", "file", "bunch", "first", "last")}
    columns |= {"counts": [pack_counts(s) for s in sums], "tokens": [f[0] for f in facts], "distinct": [f[1] for f in facts]}
    kinds = [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))


def _whole_sums(which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(which.max() + 1, np.int64)
    np.add.at(total, which, counts)
    return total


def _answer_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by hash range and kind."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["block"], row["kind"]) != (rows[0]["block"], rows[0]["kind"]):
                yield _answer(rows)
                rows = []
            rows.append(row)
    if rows:
        yield _answer(rows)


@dataclass
class Automaton:
    """Arcs and states of the n-grams of some texts, as arrays by the n-gram's number in :class:`Grams`.

    ``one``, ``two``, ``three`` are the log10 probabilities on the arcs from the empty context, from a token and from a pair;
    ``has_two`` and ``has_three`` say which exist. ``after_token`` and ``after_pair`` are the weights of the failure
    arcs, and the context of a token or a pair is a state where ``is_token`` or ``is_pair``. ``begin`` is the weight at a text's start, if that is a state.
    """

    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    has_two: np.ndarray
    has_three: np.ndarray
    after_token: np.ndarray
    after_pair: np.ndarray
    is_token: np.ndarray
    is_pair: np.ndarray
    begin: float | None

    def traverse(self, grams: Grams) -> np.ndarray:
        """Sum of log10 probabilities of each text's tokens."""
        starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(grams.bounds[:-1].tolist(), grams.bounds[1:].tolist())] or [np.zeros(0, np.int64)])
        ends = np.minimum(starts + PIECE, grams.bounds[grams.text[starts] + 1]) if len(starts) else starts
        longest_first = np.argsort(starts - ends, kind="stable")
        at, size = starts[longest_first], (ends - starts)[longest_first]
        # the state is known by its length: the last pair, the last token, or nothing
        previous = np.maximum(at - 1, 0)
        state = np.where(grams.first[at], int(self.begin is not None), self._length(grams, previous))
        score = np.zeros(len(at))
        for step in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -step))
            here, length = at[:active] + step, state[:active]
            added = np.zeros(active)
            token, pair = grams.token[here], grams.pair[here]
            triple = np.where(length == 2, grams.triple[here], -1)
            taken = (length == 2) & self.has_three[triple]
            added[taken] = self.three[triple[taken]]
            failed = np.flatnonzero((length == 2) & ~taken)
            added[failed] += self.after_pair[grams.pair[here[failed] - 1]]
            from_token = ((length == 1) | (length == 2)) & ~taken
            by_pair = from_token & self.has_two[pair]
            added[by_pair] += self.two[pair[by_pair]]
            failed = np.flatnonzero(from_token & ~by_pair)
            first = grams.first[here[failed]]
            added[failed] += np.where(first, self.begin or 0.0, self.after_token[grams.token[np.maximum(here[failed] - 1, 0)]])
            empty = ~taken & ~by_pair
            added[empty] += self.one[token[empty]]
            score[:active] += added
            state[:active] = self._length(grams, here)
        return np.bincount(grams.text[at], weights=score, minlength=len(grams.bounds) - 1) if len(at) else np.zeros(len(grams.bounds) - 1)

    def _length(self, grams: Grams, at: np.ndarray) -> np.ndarray:
        """Length of the longest context that is a state after the token at a place."""
        return np.where(self.is_pair[grams.pair[at]], 2, self.is_token[grams.token[at]].astype(np.int64))


def build_automaton(grams: Grams, tokens: np.ndarray, longer: np.ndarray, total: int, distinct: int) -> Automaton:
    """From the occurrences of tokens, and of pairs and then triples, in all training texts."""
    pairs, triples = longer[: len(grams.pairs)], longer[len(grams.pairs) :]
    one = (tokens + SMOOTHING) / (total + SMOOTHING * (distinct + 1))
    ends = np.flatnonzero(grams.tokens == END)
    texts = int(tokens[ends[0]]) if len(ends) else 0  # as many as starts
    # any place of a pair or triple tells its tokens
    place = np.zeros(len(grams.pairs), np.int64)
    place[grams.pair] = np.arange(len(grams.pair))
    context = np.where(grams.first[place], texts, tokens[grams.token[np.maximum(place - 1, 0)]])
    two = (pairs + STRENGTH * one[grams.token[place]]) / (context + STRENGTH)
    place = np.zeros(len(grams.triples), np.int64)
    inside = np.flatnonzero(grams.triple >= 0)
    place[grams.triple[inside]] = inside
    three = (triples + STRENGTH * two[grams.pair[place]]) / (pairs[grams.pair[place - 1]] + STRENGTH)
    failure = lambda count: np.log10(STRENGTH / (count + STRENGTH))
    none = np.zeros(1, bool)  # what number -1 finds
    return Automaton(
        np.log10(one), np.log10(two), np.log10(three), pairs > 0, np.append(triples > 0, none), failure(tokens), failure(pairs), tokens > 0, pairs > 0,
        float(failure(texts)) if texts else None,
    )


def _score_part(part: pa.Table, answers: list[dict], blocks: int, total: int, distinct: int) -> pa.RecordBatch:
    grams = Grams(part["text"])
    found = []
    for kind in (_TOKENS, _LONGER):
        order, bounds = _blocks(grams.keys(kind), blocks)
        sums = np.zeros(len(order), np.int64)
        for row in answers:
            if row["kind"] == kind:
                x, y = bounds[row["block"]], bounds[row["block"] + 1]
                sums[order[x:y]] = unpack_counts(row["counts"], y - x)
        found.append(sums)
    model = build_automaton(grams, *found, total, distinct)
    texts = len(grams.bounds) - 1
    made = {
        "n_tokens": np.diff(grams.bounds),
        "n_known": np.bincount(grams.text, weights=found[0][grams.token] > 0, minlength=texts).astype(np.int64),
        "train_tokens": np.full(texts, total, np.int64),
        "base_score": np.bincount(grams.text, weights=model.one[grams.token], minlength=texts),
        "score": model.traverse(grams),
    }
    held = pa.compute.invert(part["learn"].combine_chunks())
    columns = {"id": part["id"].combine_chunks(), "held_out": held} | {name: pa.array(values) for name, values in made.items()}
    return pa.RecordBatch.from_pydict(columns)


def _score_partition(batches: Iterator[pa.RecordBatch], blocks: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """A group's answers come first, then its texts by place."""
    answers: dict[tuple[int, int], list[dict]] = {}
    held: list[pa.RecordBatch] = []
    of, last = None, None

    def score() -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        return _score_part(part, answers.pop((part["place"][0].as_py(), last)), blocks, total, distinct)

    for batch in batches:
        if not batch.num_rows:
            continue
        side, place = batch.column("side").to_numpy(), batch.column("place").to_numpy()
        file, bunch = batch.column("file").to_numpy(), batch.column("bunch").to_numpy()
        changes = np.flatnonzero((file[1:] != file[:-1]) | (bunch[1:] != bunch[:-1]) | (side[1:] != side[:-1])) + 1
        for begin, end in zip([0, *changes], [*changes, batch.num_rows]):
            if of != (file[begin], bunch[begin]):
                of, answers = (file[begin], bunch[begin]), {}
            if side[begin] == _ANSWER:
                for row in batch.slice(begin, end - begin).select(["place", "last", "kind", "block", "counts"]).to_pylist():
                    answers.setdefault((row["place"], row["last"]), []).append(row)
                continue
            while begin < end:
                if last is None:
                    last = next(b for a, b in answers if a <= place[begin] <= b)
                stop = begin + int(np.searchsorted(place[begin:end], last, side="right"))
                held.append(batch.slice(begin, stop - begin))
                if place[stop - 1] == last:
                    yield score()
                    held, last = [], None
                begin = stop


def _placed(docs: DataFrame, learn: Column, doc_id: str, text: str) -> DataFrame:
    """(file, bunch, place, id, learn, text): rows known by their file and place in it."""
    file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    wanted = F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).cast("string").alias("text")
    where = file.alias("file"), F.floor(row / GROUP_ROWS).alias("bunch"), row.alias("place")
    try:
        return docs.select(*where, F.col(doc_id).alias("id"), *wanted)
    except AnalysisException:
        stored = materialise(docs.select(F.col(doc_id).alias("id"), *wanted))
        return stored.select(*where, "id", "learn", "text")


def score_corpus(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All texts of ``docs`` scored by the model of those where ``learn`` holds.

    One row per row of ``docs``: its id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``. The answers are
    stored while this DataFrame is built.
    """
    blocks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _placed(docs, learn, doc_id, text)
    asked = rows.select("file", "bunch", "place", "learn", "text").mapInArrow(partial(_ask_partition, blocks=blocks), _ASKED)
    merged = asked.repartition("block").sortWithinPartitions("block", "kind")
    answers = materialise(merged.mapInArrow(_answer_partition, _ANSWERED))
    total, distinct = (n or 0 for n in answers.agg(F.sum("tokens"), F.sum("distinct")).first())

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(name) for name in names]
    kind = rows.schema["id"].dataType.simpleString()
    side = lambda number: F.lit(number).alias("side")
    texts = rows.select("file", "bunch", side(_TEXT), "place", *none("bigint", "last"), *none("int", "kind", "block"), *none("binary", "counts"), "id", "learn", "text")
    told = answers.select("file", "bunch", side(_ANSWER), F.col("first").alias("place"), "last", "kind", "block", "counts", *none(kind, "id"), *none("boolean", "learn"), *none("string", "text"))
    met = texts.unionByName(told).repartition("file", "bunch").sortWithinPartitions("file", "bunch", "side", "place", "kind", "block")
    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = met.mapInArrow(partial(_score_partition, blocks=blocks, total=total, distinct=distinct), schema)
    return scored.withColumnRenamed("id", doc_id)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    return score_corpus(read(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))
