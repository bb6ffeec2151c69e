"""Key audits that exchange only the keys which may repeat.

Nearly all keys of a table are unique, and a plain audit exchanges them all to find the few that
are not. Here every key is first one cell of a table of 2-bit counters that stop at "twice or more".
The table has 2^48 cells and is never held whole: each task packs the cells that it has met as
sorted differences with one more bit, in blocks by hash range, a few bytes a key. The blocks meet
in an exchange, and a cell met twice, in one task or in two, is a repeated one.

Repeated cells are a superset of the repeated keys: false hits are one in 2^48 / keys. Where there are at
most ``BROADCAST_CELLS`` of them they are broadcast and filter the keys before the exact count; beyond, most
of the keys would pass, and all are counted. Results are exact either way. A key that a third of all rows
have is one cell per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import count_rows
from stallwise.session import materialise

CELL_BITS = 48
BROADCAST_CELLS = 1 << 20  # 8 bytes each
TASK_CELLS = 1 << 22  # cells that a task sorts and packs at a time
_CELL = "_cell"


def cell(keys: Sequence[str | Column], tag: str = "") -> Column:
    """Cell of a key; ``tag`` sets the keys of one audit apart from those of another."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(tag), *keys), 64 - CELL_BITS)


def pack_cells(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted distinct cells and their counter's upper bit: the first cell, then differences of one width."""
    steps = np.diff(cells, prepend=cells[0]).astype(np.uint64) << np.uint64(1) | twice.astype(np.uint64)
    width = max((int(steps.max()).bit_length() + 7) // 8, 1)
    return bytes([width]) + int(cells[0]).to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_cells(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, first = packed[0], int.from_bytes(packed[1:9], "little")
    steps = np.zeros(((len(packed) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    steps = steps.view(np.uint64).ravel()
    return np.cumsum(steps >> np.uint64(1)).astype(np.int64) + first, (steps & np.uint64(1)).astype(bool)


def _count_to_two(cells: np.ndarray, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, and whether each was met twice or more."""
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    more = np.diff(np.append(first, len(cells))) > 1
    if twice is not None:
        more |= np.logical_or.reduceat(twice[order], first)
    return cells[first], more


def _pack_partition(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Packed blocks of a task's cells."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, twice = _count_to_two(np.concatenate(held))
        block = cells * blocks >> CELL_BITS if blocks <= 1 << 15 else (cells >> 15) * blocks >> CELL_BITS - 15
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        rows = [pack_cells(cells[a:b], twice[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_pydict({"block": pa.array(block[bounds[:-1]].astype(np.int32)), "packed": pa.array(rows, pa.binary())})

    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= TASK_CELLS:
                yield packed(held)
                held = []
    if held:
        yield packed(held)


def _merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated cells, block by block; a block's packed parts come together."""

    def repeated(parts: list[bytes]) -> pa.RecordBatch:
        cells, twice = (np.concatenate(x) for x in zip(*map(unpack_cells, parts)))
        cells, twice = _count_to_two(cells, twice)
        return pa.RecordBatch.from_pydict({_CELL: pa.array(cells[twice])})

    block, parts = None, []
    for batch in batches:
        for at, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist()):
            if at != block and parts:
                yield repeated(parts)
                parts = []
            block = at
            parts.append(packed)
    if parts:
        yield repeated(parts)


def repeated_cells(cells: DataFrame) -> DataFrame:
    """A stored table of the cells that occur twice or more in a one-column DataFrame of cells."""
    blocks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = cells.mapInArrow(lambda batches: _pack_partition(batches, blocks), "block int, packed binary")
    merged = packed.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_partition, f"{_CELL} bigint")
    return materialise(merged)


def _may_repeat(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    if repeated.count() > BROADCAST_CELLS:
        return rows.drop(_CELL)
    return rows.join(F.broadcast(repeated), _CELL, "left_semi").drop(_CELL)


def rows_that_may_repeat(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without most of those whose key is the only one of its kind. Jobs run while it is built."""
    return _may_repeat(df.withColumn(_CELL, cell(keys)), repeated_cells(df.select(cell(keys))))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; as :func:`stallwise.operators.keys.duplicate_keys`."""
    few = rows_that_may_repeat(df.select(*keys), keys)
    return few.groupBy(*keys).agg(count_rows().alias("cnt")).filter(F.col("cnt") > 1)


def key_audit(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """For many keys at once, by name: how many repeat, the rows beyond the first of each, and the most rows of one.

    All keys share one counter table, one exchange of its blocks, and one of the rows that may repeat.
    """
    tagged = [
        df.select(F.lit(name).alias("audit"), F.array(*[F.col(k).cast("string") for k in keys]).alias("key"), cell(keys, name).alias(_CELL))
        for name, (df, keys) in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    counted = _may_repeat(rows, repeated_cells(rows.select(_CELL))).groupBy("audit", "key").agg(count_rows().alias("cnt"))
    found = counted.filter(F.col("cnt") > 1).groupBy("audit").agg(
        count_rows().alias("repeated_keys"), F.sum(F.col("cnt") - 1).alias("excess_rows"), F.max("cnt").alias("most_rows")
    )
    names = rows.sparkSession.createDataFrame([(name, ", ".join(keys)) for name, (_, keys) in tables.items()], "audit string, key_columns string")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("repeated_keys", "excess_rows")]
    return names.join(found, "audit", "left").select("audit", "key_columns", *counts, F.coalesce("most_rows", F.lit(1)).alias("most_rows"))
