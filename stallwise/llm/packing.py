"""Packing tokenised documents into sequences of bounded length.

Documents are tokenised and end with an end id; longer ones than a sequence are cut into full
pieces, of which the first may be shorter. What is then packed depends on lengths alone, of which
there are at most ``CAPACITY``, so the plan is made on the driver from a histogram that does
not grow with the data:

1. Patterns of one to three lengths that fill a sequence are enumerated, ``SPLITS`` ways of
   sharing what the longest leaves.
2. Repeat counts are fitted to the histogram by non-negative least squares, rounded down, and
   limited to what is there.
3. The rest is packed best fit, longest first, by whole groups of equal sequences. Holding back a
   share of the repeats leaves the rest more to fit with; of ``SHARES`` the one with fewest
   sequences counts.

The plan says for the r-th piece of each length which sequence and place it gets. Pieces are
numbered per length by a window over (length, salt), where a length has as many salts as its count
needs, and each row looks its place up; no piece passes the driver.

Defined results: a NULL or empty text is the end id alone; repeated rows are packed each; equal pieces may
swap places; NULL ids are packed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.llm.tables import map_batches, materialise, read

CAPACITY = 2048
END_ID = 0
SPLITS = 6
NNLS_ROUNDS = 300
SHARES = (1.0, 0.9, 0.75, 0.5)
ROWS_PER_SALT = 100_000
TEXTS_AT_ONCE = 64


@lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """A function from a text to its ids, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    The vocabulary of a byte-level BPE file is run by ``tiktoken``, which gives the same ids several times faster; here
    both are compared on a probe, and by the tests on whole texts. Texts that hold the string of an added token
    are left to ``tokenizers``, which makes it one id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    letters = {char: byte for byte, char in _byte_letters().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    ranks = {bytes(letters[c] for c in token): number for token, number in vocabulary.items() if token not in added}
    encoder = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(string in text for string in added):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return encoder.encode_to_numpy(text, disallowed_special=())

    probe = "Probe: it's 12 étés,\n\n  中文 <|end of text|>\t naïve ok"
    if encode(probe).tolist() != tokenizer.encode(probe, add_special_tokens=False).ids:
        raise ValueError(f"{path} is not a byte-level BPE vocabulary with the usual word pattern")
    return encode


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def _piece_batch(batch: pa.RecordBatch, path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = byte_level_encoder(path)
    ids, texts = batch.column("id"), batch.column("text")
    for begin in range(0, batch.num_rows, TEXTS_AT_ONCE):
        rows, made, kept = [], [], []
        for row, text in enumerate(texts.slice(begin, TEXTS_AT_ONCE).to_pylist(), begin):
            tokens = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
            for number, (start, length) in enumerate(piece_bounds(len(tokens), capacity)):
                piece = tokens[start : start + length]
                rows.append(row)
                made.append((number, start, length, zlib.crc32(piece.tobytes())))
                kept.append(piece.astype(np.int32))
        columns = zip(*made)
        kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        out = {"id": ids.take(pa.array(rows))} | {name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)}
        if keep_ids:
            out["ids"] = pa.array(kept, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(out)


def cut_into_pieces(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = partial(_piece_batch, path=path, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    more = ", ids array<int>" if keep_ids else ""
    return map_batches(rows, cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def patterns(capacity: int, splits: int = SPLITS) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, longest first."""
    out = {(capacity, 0, 0)}
    for longest in range(-(-capacity // 3), capacity):
        rest = capacity - longest
        if rest <= longest:
            out.add((longest, rest, 0))
        for k in range(1, splits + 1):
            small = max(1, rest * k // (2 * splits))
            if small <= rest - small <= longest:
                out.add((longest, rest - small, small))
    return np.array(sorted(out, reverse=True), np.int64)


def fit_repeats(table: np.ndarray, histogram: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns with A x near the histogram.

    Multiplicative steps x * A'h / A'A x keep x non-negative and never raise the error.
    """
    wanted = histogram.astype(np.float64)
    wanted[0] = 0.0
    usable = ((table == 0) | (wanted[table] > 0)).all(axis=1)
    table = np.where(usable[:, None], table, 0)
    aim = wanted[table].sum(axis=1)
    x = np.where(usable, 1.0, 0.0)
    for _ in range(rounds):
        filled = sum(np.bincount(table[:, k], weights=x, minlength=len(wanted)) for k in range(table.shape[1]))
        filled[0] = 0.0
        x *= aim / np.maximum(filled[table].sum(axis=1), 1e-12)
    return x


@dataclass
class Group:
    """``count`` sequences that hold pieces of the same lengths."""

    lengths: tuple[int, ...]
    count: int


def plan_groups(histogram: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Sequences for all pieces of a histogram (count by length, 0 to capacity)."""
    wanted = histogram.astype(np.int64).copy()
    wanted[0] = 0
    table = patterns(capacity)
    repeats = fit_repeats(table, wanted)
    plans = [_rounded(table, np.floor(share * repeats).astype(np.int64), wanted, capacity) for share in SHARES]
    return min(plans, key=lambda groups: sum(group.count for group in groups))


def _rounded(table: np.ndarray, repeats: np.ndarray, wanted: np.ndarray, capacity: int) -> list[Group]:
    """Whole repeats of the patterns, as far as there are pieces, and the rest best fit."""
    left = wanted.copy()
    groups: list[Group] = []
    for at in np.argsort(-repeats, kind="stable"):
        if not repeats[at]:
            break
        lengths, times = np.unique(table[at][table[at] > 0], return_counts=True)
        count = int(min(repeats[at], (left[lengths] // times).min()))
        if count:
            left[lengths] -= times * count
            groups.append(Group(tuple(int(n) for n in table[at] if n), count))
    return groups + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[Group]:
    """Best fit, longest first, moving whole groups of equal open sequences."""
    open_by_room: list[list[Group]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        room = length
        while count:
            while room <= capacity and not open_by_room[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                full, rest = divmod(count, each)
                for lengths, number in (((length,) * each, full), ((length,) * rest, 1 if rest else 0)):
                    if number:
                        open_by_room[capacity - length * len(lengths)].append(Group(lengths, number))
                break
            group = open_by_room[room][-1]
            moved = min(group.count, count)
            group.count -= moved
            if not group.count:
                open_by_room[room].pop()
            open_by_room[room - length].append(Group((*group.lengths, length), moved))
            count -= moved
            if room - length >= length:
                room = length  # what was just filled may be the best fit again
    return [group for groups in open_by_room for group in groups]


@dataclass
class Plan:
    """For each length, runs of piece numbers and the sequence and place that a run begins with."""

    first: np.ndarray  # by length: its runs' place below
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the rank-th piece (from 0) of a length."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            runs = slice(self.first[n], self.first[n + 1])
            at = np.searchsorted(self.rank[runs], rank[rows], side="right") - 1
            sequence[rows] = self.sequence[runs][at] + rank[rows] - self.rank[runs][at]
            offset[rows] = self.offset[runs][at]
        return sequence, offset


def make_plan(groups: list[Group], capacity: int = CAPACITY) -> Plan:
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    used = [0] * (capacity + 1)
    sequence = 0
    for group in groups:
        offset = 0
        for length in group.lengths:
            runs[length].append((used[length], sequence, offset))
            used[length] += group.count
            offset += length
        sequence += group.count
    first = np.cumsum([0, *map(len, runs)])
    flat = np.array([run for of_length in runs for run in of_length], np.int64).reshape(-1, 3)
    return Plan(first, flat[:, 0], flat[:, 1], flat[:, 2])


def _place_batch(batch: pa.RecordBatch, plan: Plan) -> Iterator[pa.RecordBatch]:
    sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
    kept = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
    yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``; they are read three times."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in rows:
        histogram[row["length"]] = row["n"]
    plan = make_plan(plan_groups(histogram, capacity), capacity)

    # a length has a salt for each ROWS_PER_SALT of its pieces
    salts = F.broadcast(
        pieces.sparkSession.createDataFrame(
            [(row["length"], -(-row["n"] // ROWS_PER_SALT)) for row in rows], "length bigint, salts bigint"
        )
    )
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(sizes, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("nth") - 1).cast("bigint").alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, partial(_place_batch, plan=plan), f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece, with its sequence and place."""
    pieces = materialise(cut_into_pieces(docs, path, doc_id, text, capacity, end_id, keep_ids))
    return pack_pieces(pieces, capacity).withColumnRenamed("id", doc_id)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
