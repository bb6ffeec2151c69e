"""Line dedup by range-partitioned hashes, streamed in order, with keep bitmaps as the result.

A document is a row. Its lines are the pieces between ``\\n``; a line's key is the line without
``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased. Lines whose key has at least ``min_chars`` code points
and stands in at least ``min_docs`` documents are repeated: all of them are dropped, or all but the first one
(least document id, then row, then position) with ``keep_first``.

How the work is spread:

* Every line becomes a 128-bit hash with its document and position; the text stays where it is.
* Hashes are range-partitioned and sorted by (hash, document, row, line). The bounds are drawn over all of these
  columns, so a line that a third of all documents have is cut into many partitions, each in order.
* A task streams its partition batch by batch and holds the lines of one hash only until ``min_docs`` documents
  have been seen. A run of one hash that does not touch an end of its partition is settled there. For the two that do,
  a task lists at most ``min_docs`` documents each; these lists are added up by hash, and lines of short end
  runs are settled by a join with them.
* Dropped lines are gathered by row to a keep bitmap: run lengths, kept and dropped in turn, as variable-length integers.
  Texts meet their bitmaps in one join by row.

Rows are numbered once, in a stored table, so that a lost task reads the same numbers again.

Defined results: a NULL or empty text is one empty line; a key of fewer than ``min_chars`` code points is never dropped
(with 0, empty keys count as well); repeated rows and rows with one id or without one are documents of their own;
lines are told apart by 128 bits of hash; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import map_batches, materialise, read, whole_row

# A line is repeated when so many documents have it, and it has so many code points.
MIN_DOCS = 10
MIN_CHARS = 1

EMIT_LINES = 1 << 17  # lines in an output batch, and held back while a hash is undecided

_DROP, _MAYBE, _DOCUMENT = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space and A-Z only


def _code_points(raw: bytes) -> int:
    return len(raw) - sum(0x80 <= byte < 0xC0 for byte in raw)


def _hash_batch(batch: pa.RecordBatch, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Hash, document, row and place of every line whose key is long enough."""
    digests: list[bytes] = []
    at: list[int] = []
    places: list[int] = []

    def emit() -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        taken = pa.array(at, pa.int64())
        made = {"h1": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1]), "doc": batch.column("doc").take(taken)}
        return pa.RecordBatch.from_pydict(made | {"number": batch.column("number").take(taken), "line": pa.array(places, pa.int64())})

    for i, text in enumerate(batch.column("text")):
        for place, line in enumerate((text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")):
            key = line_key(line)
            if len(key) < min_chars or (len(key) < 4 * min_chars and _code_points(key) < min_chars):
                continue
            digests.append(xxhash.xxh3_128_digest(key))
            at.append(i)
            places.append(place)
        if len(at) >= EMIT_LINES:
            yield emit()
            digests, at, places = [], [], []
    if at:
        yield emit()


class _Run:
    """The lines of one hash that a task has met so far, as they may go on in the next batch."""

    def __init__(self, key: tuple[int, int], touches_start: bool):
        self.key, self.touches_start = key, touches_start
        self.documents: list[int] = []  # the first ones, as many as decide
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.first: tuple[int, int] | None = None


class _Stream:
    """Settles the runs of a sorted partition; gives (kind, h1, h2, leads, number, line) columns."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.open: _Run | None = None
        self.out: list[tuple] = []

    def _put(self, kind: int, key: tuple[int, int], number: np.ndarray, line: np.ndarray, leads: bool = False) -> None:
        if len(number):
            self.out.append((kind, key, leads, np.asarray(number, np.int64), np.asarray(line, np.int64)))

    def _extend(self, run: _Run, number: np.ndarray, line: np.ndarray) -> None:
        if run.first is None:
            run.first = int(number[0]), int(line[0])
            number, line = number[1:], line[1:]
            run.documents.append(run.first[0])
        decided = len(run.documents) >= self.min_docs
        if not decided and len(number):
            fresh = number[np.flatnonzero(np.diff(number, prepend=run.documents[-1]))]
            run.documents.extend(fresh[: self.min_docs - len(run.documents)].tolist())
            decided = len(run.documents) >= self.min_docs
        run.held.append((number, line))
        if decided:
            for held in run.held:
                self._put(_DROP, run.key, *held)
            run.held = []

    def _close(self, run: _Run, touches_end: bool) -> None:
        decided = len(run.documents) >= self.min_docs
        lead = np.array(run.first[:1]), np.array(run.first[1:])
        if not (run.touches_start or touches_end):
            if decided and not self.keep_first:
                self._put(_DROP, run.key, *lead)
            return
        self._put(_DOCUMENT, run.key, np.array(run.documents), np.zeros(len(run.documents), np.int64))
        if decided and not self.keep_first:
            self._put(_DROP, run.key, *lead)
        else:
            self._put(_MAYBE, run.key, *lead, leads=True)
        for held in run.held:
            self._put(_MAYBE, run.key, *held)

    def feed(self, h1: np.ndarray, h2: np.ndarray, number: np.ndarray, line: np.ndarray) -> None:
        change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.append(change, len(h1))
        began = self.open is None
        if self.open is not None and self.open.key == (int(h1[0]), int(h2[0])):
            self._extend(self.open, number[: ends[0]], line[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if not len(starts):
            return
        if self.open is not None:
            self._close(self.open, touches_end=False)
        if began and len(starts) > 1:  # a partition's first run
            self._whole(h1, h2, number, line, starts[0], ends[0])
            starts, ends, began = starts[1:], ends[1:], False
        self._settle(number, line, starts[:-1], ends[:-1])
        a, b = int(starts[-1]), int(ends[-1])
        self.open = _Run((int(h1[a]), int(h2[a])), touches_start=began)
        self._extend(self.open, number[a:b], line[a:b])

    def _whole(self, h1, h2, number, line, a: int, b: int) -> None:
        run = _Run((int(h1[a]), int(h2[a])), touches_start=True)
        self._extend(run, number[a:b], line[a:b])
        self._close(run, touches_end=False)

    def _settle(self, number: np.ndarray, line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Runs that lie inside the batch, all at once."""
        if not len(starts):
            return
        a, b = int(starts[0]), int(ends[-1])
        fresh = np.ones(b - a, np.int64)
        fresh[1:] = number[a + 1 : b] != number[a : b - 1]
        fresh[starts - a] = 1
        drop = np.repeat(np.add.reduceat(fresh, starts - a) >= self.min_docs, ends - starts)
        if self.keep_first:
            drop[starts - a] = False
        self._put(_DROP, (0, 0), number[a:b][drop], line[a:b][drop])

    def finish(self) -> None:
        if self.open is not None:
            self._close(self.open, touches_end=True)
            self.open = None

    def take(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        sizes = np.array([len(x[3]) for x in self.out])
        spread = lambda values, kind: pa.array(np.repeat(np.array(values, kind), sizes))
        made = {
            "kind": spread([x[0] for x in self.out], np.int32),
            "h1": spread([x[1][0] for x in self.out], np.int64),
            "h2": spread([x[1][1] for x in self.out], np.int64),
            "leads": spread([x[2] for x in self.out], bool),
            "number": pa.array(np.concatenate([x[3] for x in self.out])),
            "line": pa.array(np.concatenate([x[4] for x in self.out])),
        }
        self.out = []
        return pa.RecordBatch.from_pydict(made)


_FOUND = "kind int, h1 bigint, h2 bigint, leads boolean, number bigint, line bigint, piece int"


def _stream_partition(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    stream, piece = _Stream(min_docs, keep_first), TaskContext.get().partitionId()

    def emitted() -> Iterator[pa.RecordBatch]:
        batch = stream.take()
        if batch is not None:
            yield batch.append_column("piece", pa.array(np.full(batch.num_rows, piece, np.int32)))

    for batch in batches:
        if batch.num_rows:
            stream.feed(*[batch.column(name).to_numpy() for name in ("h1", "h2", "number", "line")])
            yield from emitted()
    stream.finish()
    yield from emitted()


def _dropped_lines(numbered: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(number, lines): the dropped lines of each row that has any, in order."""
    kind = numbered.schema["doc"].dataType.simpleString()
    schema = f"h1 bigint, h2 bigint, doc {kind}, number bigint, line bigint"
    hashed = map_batches(numbered.select("doc", "number", "text"), partial(_hash_batch, min_chars=min_chars), schema)
    order = ["h1", "h2", "doc", "number", "line"]
    streamed = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("h1", "h2", "number", "line")
    found = materialise(streamed.mapInArrow(partial(_stream_partition, min_docs=min_docs, keep_first=keep_first), _FOUND))

    documents = found.filter(F.col("kind") == _DOCUMENT).groupBy("h1", "h2", "number").agg(F.min("piece").alias("piece"))
    ends = documents.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("piece").alias("first")).filter(F.col("docs") >= min_docs)
    settled = found.filter(F.col("kind") == _MAYBE).join(ends, ["h1", "h2"])
    if keep_first:
        settled = settled.filter(~(F.col("leads") & (F.col("piece") == F.col("first"))))
    dropped = found.filter(F.col("kind") == _DROP).select("number", "line").unionByName(settled.select("number", "line"))
    return dropped.groupBy("number").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def encode_keep(n_lines: int, dropped: np.ndarray) -> bytes:
    """Lengths of runs of kept and dropped lines in turn, kept first, each as a LEB128 integer."""
    flags = np.zeros(n_lines, bool)
    flags[dropped] = True
    change = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    runs = np.diff(np.concatenate([[0], change, [n_lines]])).tolist()
    out = bytearray()
    for run in [0, *runs] if flags[0] else runs:
        while run > 0x7F:
            out.append(run & 0x7F | 0x80)
            run >>= 7
        out.append(run)
    return bytes(out)


def decode_keep(keep: bytes) -> np.ndarray:
    """One flag per line: whether it stays."""
    runs, value, shift = [], 0, 0
    for byte in keep:
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            runs.append(value)
            value, shift = 0, 0
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs)


def _bitmap_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lines = batch.column("lines").to_pylist()
    keeps = [encode_keep(n, np.array(at or [], np.int64)) for n, at in zip(batch.column("n_lines").to_pylist(), lines)]
    yield pa.RecordBatch.from_pydict(
        {
            "number": batch.column("number"),
            "n_lines": batch.column("n_lines"),
            "n_dropped": pa.array([len(at or ()) for at in lines], pa.int64()),
            "keep": pa.array(keeps, pa.binary()),
        }
    )


def number_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of the rows: ``number``, ``doc``, ``text`` as string, and ``row`` with all but the text."""
    rest = docs.drop(text) if len(docs.columns) > 1 else docs.select(F.lit(None).cast("int").alias("none"))
    columns = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), whole_row(rest))
    return materialise(columns.withColumn("number", F.monotonically_increasing_id()))


def keep_bitmaps(numbered: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(number, n_lines, n_dropped, keep) for every row of :func:`number_rows`; ``keep`` as by :func:`encode_keep`."""
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    dropped = _dropped_lines(numbered, min_docs, min_chars, keep_first)
    rows = numbered.select("number", n_lines.alias("n_lines")).join(dropped, "number", "left")
    return map_batches(rows, _bitmap_batch, "number bigint, n_lines bigint, n_dropped bigint, keep binary")


def _keep_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column("text").to_pylist()
    for i, (n_dropped, keep) in enumerate(zip(batch.column("n_dropped").to_pylist(), batch.column("keep").to_pylist())):
        if n_dropped:
            texts[i] = "\n".join([line for line, stays in zip(texts[i].split("\n"), decode_keep(keep)) if stays])
    names = [name for name in batch.schema.names if name not in ("text", "number")]
    yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in names} | {"kept": pa.array(texts, pa.string())})


def drop_lines(numbered: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``row``, ``n_lines``, ``n_dropped``, ``keep`` and ``kept``, the text of the lines that stay (NULL stays NULL)."""
    joined = numbered.select("number", "row", "text").join(bitmaps, "number")
    kind = joined.schema["row"].dataType.simpleString()
    return map_batches(joined, _keep_batch, f"row {kind}, n_lines bigint, n_dropped bigint, keep binary, kept string")


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """``docs`` without repeated lines; all rows and other columns kept. Rules as in :func:`keep_bitmaps`."""
    numbered = number_rows(docs, doc_id, text)
    cut = drop_lines(numbered, keep_bitmaps(numbered, **rules))
    names = [F.col("kept").cast(docs.schema[text].dataType).alias(n) if n == text else F.col("row").getField(n).alias(n) for n in docs.columns]
    return cut.select(*names)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that ten or more have, dropped everywhere."""
    numbered = number_rows(read(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = drop_lines(numbered, keep_bitmaps(numbered))
    digest = F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP11_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS number, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), pieces AS (
  SELECT number, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM texts
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM pieces
), repeated AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT number) >= 10
), marked AS (
  SELECT keyed.*, repeated.key IS NOT NULL AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY number, doc_id
"""
