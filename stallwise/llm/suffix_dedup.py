"""Removal of repeated passages by sorting suffixes, spread over a cluster.

Each byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a document of
smaller id, or earlier in the same one) is removed. Texts are UTF-8 bytes; strings never cross
documents, may overlap, and are judged on the input.

1. Anchors. Among the ``ANCHOR``-byte strings inside each window of ``LENGTH`` bytes, the one of least
   hash marks the window. Equal windows are marked at the same place, so they are found among the
   occurrences of one anchor; there is about one anchor for 35 windows.
2. Occurrences whose whole neighbourhood (all windows around the anchor) is equal collapse to the
   first: the others are repeated in full. That is done in each batch of texts, and then, after one
   exchange that brings the occurrences of an anchor together (anchors, not texts), for all. An anchor
   in a third of all texts so travels once a batch. Anchors found once, three quarters of ordinary
   text, end here.
3. What is left are anchors with different neighbourhoods, at the ends of repeated passages. For
   those the bytes are fetched, and each task sorts its suffixes: the bytes from the anchor on, and
   the bytes before it read backwards, by deep-shallow sorting (:mod:`deep_shallow`). Their common
   prefixes say, for each place of a window around the anchor, which windows are equal; all but the
   first are repeated.
4. An anchor with more than ``SPLIT_ROWS`` different neighbourhoods is sorted in lots of about that many.
   A window that is the first of its lot, but not of all lots, is repeated too: the lots' first windows meet
   by a 128-bit hash, so what is equal inside a lot has been combined before that exchange.
5. The repeated windows of a document meet its text again, and are cut out.

A passage in n documents gives n rows of its few anchors, never pairs. Sorting goes through a task's
lots in blocks of about ``BLOCK_ROWS`` suffixes, cut between lots, so a task holds at most some
``BLOCK_ROWS + SPLIT_ROWS`` of them, whatever share of the table one anchor has. In the exchange of step 2 the
``HOT_ANCHORS`` most frequent anchors of one text in ``SAMPLE_ONE_IN`` are dealt out by neighbourhood; that
sample only spreads the work, as what it misses is judged alike.

Ids are whole numbers. Defined results: NULL and empty texts have no bytes; NULL ids come first;
rows with equal ids are ordered by their text's hash, and repeated rows (equal id and text) are one
text judged once, each of them cut alike; an empty table gives an empty result; other columns pass through
:func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.llm.deep_shallow import SHALLOW_BYTES, common_prefixes, sorted_order
from stallwise.llm.tables import map_batches, materialise, read, whole_row
from stallwise.llm.words import SpanHashes, mix, text_chunks

LENGTH = 100
ANCHOR = 32
BLOCK_ROWS = 60_000
ROWS_PER_TASK = 150_000
SPLIT_ROWS = 20_000
HOT_ANCHORS = 1_000
SAMPLE_ONE_IN = 64
BROADCAST_ROWS = 100_000

_REACH = LENGTH - ANCHOR  # bytes of a window before the anchor, at most
_FIRST_ID = -(1 << 63)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in text, anchor hash, neighbourhood hash) of a chunk's texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    spans = SpanHashes(data)
    begins = np.arange(len(data) - ANCHOR + 1)
    hashes = spans(begins, begins + ANCHOR)
    # the order of anchors is the hash's upper half; of equal ones the first in the window counts
    rank = (hashes & np.uint64(0xFFFFFFFF00000000)) | begins.astype(np.uint64)
    least = _sliding_least(rank, _REACH + 1)
    text = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    inside = np.arange(len(least)) + LENGTH <= offsets[text + 1]
    places = np.unique(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, places, side="right") - 1
    begin = np.maximum(places - _REACH, offsets[text])
    end = np.minimum(places + LENGTH, offsets[text + 1])
    around = mix(spans(begin, end) + (places - begin).astype(np.uint64) * np.uint64(256) + (end - places).astype(np.uint64))
    return text, places - offsets[text], hashes[places].view(np.int64), around.view(np.int64)


def _anchor_batch(batch: pa.RecordBatch, hot: dict[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Anchors of a batch; all but the first with one neighbourhood are settled (``part`` -1): repeated in full.

    A settled one has some other number in place of its anchor's. Anchors in ``hot`` have that many parts, from 1,
    by neighbourhood; all others have part 0.
    """
    names = [name for name in batch.schema.names if name != "text"]
    found: list[list[np.ndarray]] = [[], [], [], []]
    for chunk in text_chunks(batch.column("text")):
        text, place, anchor, around = anchors(chunk.data, chunk.offsets)
        for out, part in zip(found, (text + chunk.first, place, anchor, around)):
            out.append(part)
    row, place, anchor, around = (np.concatenate(parts) for parts in found)
    keys = [batch.column(name).to_numpy()[row] for name in names]
    order = np.lexsort((place, *keys[::-1], around, anchor))
    row, place, anchor, around = (part[order] for part in (row, place, anchor, around))
    keys = [key[order] for key in keys]
    settled, again = np.zeros(len(row), bool), np.zeros(len(row), bool)
    settled[1:] = (anchor[1:] == anchor[:-1]) & (around[1:] == around[:-1])
    again[1:] = settled[1:] & (place[1:] == place[:-1])
    for key in keys:
        again[1:] &= key[1:] == key[:-1]
    # settled ones need no neighbours: they take the same exchange, dealt out evenly
    spread = mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys[0].view(np.uint64)).view(np.int64)
    part = np.zeros(len(row), np.int32)
    if hot:
        known = np.array(sorted(hot), np.int64)
        at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        parts = np.array([hot[number] for number in known.tolist()], np.uint64)[at]
        part = np.where(known[at] == anchor, (mix(around.view(np.uint64)) % parts).astype(np.int32) + 1, part)
    part = np.where(settled, np.int32(-1), part)
    anchor = np.where(settled, spread, anchor)
    once = ~again  # a repeated row of the table is one text
    columns = {name: key[once] for name, key in zip(names, keys)}
    columns |= {"place": place[once].astype(np.int32), "anchor": anchor[once], "around": around[once], "part": part[once]}
    yield from pa.table({name: pa.array(values) for name, values in columns.items()}).to_batches(max_chunksize=50_000)


def _piece_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text: before it (at most 68) and from it on (100), by ``lot``."""
    texts, found = batch.column("text"), batch.column("found")
    names = [name for name in batch.schema.names if name not in ("text", "found")]
    keys: dict[str, list] = {name: [] for name in names}
    out: dict[str, list] = {"lot": [], "split": [], "place": [], "before": [], "after": []}
    held = 0

    def flush() -> pa.RecordBatch:
        kinds = {"lot": pa.int64(), "split": pa.bool_(), "place": pa.int32(), "before": pa.binary(), "after": pa.binary()}
        made = {name: pa.array(values, batch.schema.field(name).type) for name, values in keys.items()}
        made |= {name: pa.array(values, kinds[name]) for name, values in out.items()}
        for values in (*keys.values(), *out.values()):
            values.clear()
        return pa.RecordBatch.from_pydict(made)

    for row in range(batch.num_rows):
        raw = texts[row].as_buffer().to_pybytes()
        wanted = found[row].values
        place = wanted.field("place").to_pylist()
        for name in names:
            keys[name].extend([batch.column(name)[row].as_py()] * len(place))
        for name in ("lot", "split"):
            out[name].extend(wanted.field(name).to_pylist())
        out["place"].extend(place)
        out["before"].extend(raw[max(p - _REACH, 0) : p] for p in place)
        out["after"].extend(raw[p : p + LENGTH] for p in place)
        held += len(place)
        if held >= 20_000:
            yield flush()
            held = 0
    yield flush()


def _matrix(column: pa.Array, size: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes padded with zeros, and their lengths."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.append(np.frombuffer(column.buffers()[2] or b"", np.uint8), np.uint8(0))
    lengths = np.diff(offsets)
    steps = np.arange(size)[None, :]
    at = offsets[1:, None] - 1 - steps if backwards else offsets[:-1, None] + steps
    inside = steps < lengths[:, None]
    return np.where(inside, data[np.where(inside, at, -1)], np.uint8(0)), lengths


def repeated_windows(before: pa.Array, after: pa.Array) -> np.ndarray:
    """Which windows around each anchor are repeated; rows stand in document order.

    Entry (i, o) is the window that starts ``o`` bytes before anchor i.
    """
    count = len(after)
    tails, reach = _matrix(after, LENGTH, backwards=False)
    heads, back = _matrix(before, _REACH, backwards=True)
    # suffixes of one anchor begin alike: the shallow part goes on beyond it
    tail_order, head_order = sorted_order(tails, ANCHOR + SHALLOW_BYTES), sorted_order(heads)
    tail_common, head_common = common_prefixes(tails, tail_order), common_prefixes(heads, head_order)
    again = np.zeros((count, _REACH + 1), bool)
    tail_class, head_class = np.empty(count, np.int64), np.empty(count, np.int64)
    for o in range(_REACH + 1):
        valid = np.flatnonzero((back >= o) & (reach >= LENGTH - o))
        if len(valid) < 2:
            continue
        tail_class[tail_order] = np.cumsum(tail_common < LENGTH - o)
        head_class[head_order] = np.cumsum(head_common < o)
        key = head_class[valid] * (count + 1) + tail_class[valid]
        repeated = np.ones(len(valid), bool)
        repeated[np.unique(key, return_index=True)[1]] = False
        again[valid[repeated], o] = True
    return again


def _lot_firsts(block: pa.Table, again: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The windows of split anchors that are the first of their lot, with their hash."""
    offsets = np.arange(_REACH + 1)[None, :]
    back, reach = (pc.binary_length(block[name]).to_numpy()[:, None] for name in ("before", "after"))
    open_ = ~again & block["split"].to_numpy()[:, None] & (back >= offsets) & (reach >= LENGTH - offsets)
    rows, found = np.nonzero(open_)
    for begin in range(0, len(rows), 50_000):
        row, o = rows[begin : begin + 50_000], found[begin : begin + 50_000]
        digests = bytearray()
        last, around, at = -1, b"", 0
        for i, offset in zip(row.tolist(), o.tolist()):
            if i != last:
                before = block["before"][i].as_py()
                last, around, at = i, before + block["after"][i].as_py(), len(before)
            digests += blake2b(around[at - offset : at - offset + LENGTH], digest_size=16).digest()
        hashes = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
        low = (block["place"].to_numpy()[row] - o).astype(np.int32)
        keys = {name: block[name].take(pa.array(row)).combine_chunks() for name in names}
        spans = {"low": pa.array(low), "high": pa.array(low + np.int32(LENGTH))}
        yield pa.RecordBatch.from_pydict(keys | spans | {"hash_a": pa.array(hashes[:, 0]), "hash_b": pa.array(hashes[:, 1])})


def _sort_block(block: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    block = block.sort_by([(name, "ascending") for name in (*names, "place")]).combine_chunks()
    again = repeated_windows(block["before"].chunk(0), block["after"].chunk(0))
    yield from _lot_firsts(block, again, names)
    edges = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    if not len(row):
        return
    place = block["place"].to_numpy()[row]
    keys = {name: block[name].take(pa.array(row)).combine_chunks() for name in names}
    spans = {"low": pa.array((place - last).astype(np.int32)), "high": pa.array((place - first + LENGTH).astype(np.int32))}
    no_hash = {name: pa.nulls(len(row), pa.int64()) for name in ("hash_a", "hash_b")}
    yield from pa.table(keys | spans | no_hash).to_batches()


def _sort_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, and with a hash those that are the first of a split anchor's lot.

    Rows come sorted by lot and are taken in blocks of whole lots."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("lot", "split", "place", "before", "after")]
        while batch.num_rows:
            room = max(BLOCK_ROWS - size, 0)
            if batch.num_rows <= room:
                held.append(batch)
                size += batch.num_rows
                break
            # close the block at the next new lot
            last = held[-1]["lot"][-1].as_py() if held and not room else batch["lot"][room - 1].as_py()
            ahead = batch["lot"].to_numpy()[room:]
            differs = np.flatnonzero(ahead != last)
            cut = room + (int(differs[0]) if len(differs) else len(ahead))
            if cut:
                held.append(batch.slice(0, cut))
                size += cut
                batch = batch.slice(cut)
            if len(differs):
                yield from _sort_block(pa.Table.from_batches(held), names)
                held, size = [], 0
    if held:
        yield from _sort_block(pa.Table.from_batches(held), names)


def _keys(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """Distinct texts with their key columns: the id, and the text's hash where ids repeat."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_FIRST_ID).cast("bigint"))
    rows = docs.select(number.alias("id"), body.alias("text"))
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows, ["id"]
    return rows.withColumn("body", F.xxhash64("text")).select("id", "body", "text"), ["id", "body"]


def _hot_anchors(rows: DataFrame, keys: list[str], schema: str) -> dict[int, int]:
    """The most frequent anchors of a sample of the texts, with the number of parts to deal them in."""
    sample = rows.filter(F.pmod(F.xxhash64(*keys), F.lit(SAMPLE_ONE_IN)) == 0)
    counted = map_batches(sample, _anchor_batch, schema).filter("part = 0").groupBy("anchor").agg(F.count("*").alias("n"))
    often = counted.filter(F.col("n") * SAMPLE_ONE_IN > SPLIT_ROWS).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS)
    return {r["anchor"]: -(-r["n"] * SAMPLE_ONE_IN // SPLIT_ROWS) for r in often.collect()}


def _in_lots(ends: DataFrame, keys: list[str]) -> DataFrame:
    """``ends`` with their ``lot``: one for each anchor, or several, ``split``, of about ``SPLIT_ROWS`` rows."""
    large = ends.groupBy("anchor").agg(F.count("*").alias("rows")).filter(F.col("rows") > SPLIT_ROWS)
    large = materialise(large.select("anchor", F.ceil(F.col("rows") / SPLIT_ROWS).alias("lots")))
    dealt = ends.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "anchor", "left")
    part = F.pmod(F.xxhash64(*keys, "place"), F.col("lots"))
    lot = F.when(F.col("lots").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", part))
    return dealt.select(*keys, "place", lot.alias("lot"), F.col("lots").isNotNull().alias("split"))


def find_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per text with repeats: its keys, ``whole`` (anchors whose windows are all repeated) and
    ``spans`` (low, high) of other repeated windows."""
    plain = ", ".join(f"{name} bigint" for name in keys)
    schema = f"{plain}, place int, anchor bigint, around bigint, part int"
    found = map_batches(rows, partial(_anchor_batch, hot=_hot_anchors(rows, keys, schema)), schema)
    group = Window.partitionBy("anchor", "part").orderBy("around", *keys, "place")
    everything = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = [F.lag(name).over(group).alias(f"last_{name}") for name in ("around", *keys, "place")]
    seen = found.select(
        "*", *earlier, F.min("around").over(everything).alias("least"), F.max("around").over(everything).alias("most")
    )
    # a repeated row of the table gives the same anchors again: that is one occurrence
    same_row = F.lit(True)
    for name in ("around", *keys, "place"):
        same_row = same_row & (F.col(name) == F.col(f"last_{name}"))
    settled = F.col("part") == -1
    seen = seen.filter(settled | ~F.coalesce(same_row, F.lit(False)))
    seen = seen.withColumn("whole", settled | F.coalesce(F.col("around") == F.col("last_around"), F.lit(False)))
    # a part of a hot anchor does not show whether another part has other neighbourhoods: it goes on
    seen = seen.filter(F.col("whole") | (F.col("part") > 0) | (F.col("least") != F.col("most")))
    seen = materialise(seen.select(*keys, "place", "anchor", "whole"))
    ends = seen.filter(~F.col("whole"))
    wanted = _in_lots(ends, keys).groupBy(*keys).agg(F.collect_list(F.struct("lot", "split", "place")).alias("found"))
    pieces = map_batches(
        rows.dropDuplicates(keys).join(wanted, keys) if len(keys) > 1 else rows.join(wanted, keys),
        _piece_batch,
        f"{plain}, lot bigint, split boolean, place int, before binary, after binary",
    )
    tasks = max(1, -(-ends.count() // ROWS_PER_TASK))
    tasks = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_pieces = pieces.repartition(tasks, "lot").sortWithinPartitions("lot")
    spans = materialise(sorted_pieces.mapInArrow(_sort_partition, f"{plain}, low int, high int, hash_a bigint, hash_b bigint"))
    firsts = spans.filter(F.col("hash_a").isNotNull())
    # a window around two anchors comes twice, at one place: that is one occurrence
    nth = F.rank().over(Window.partitionBy("hash_a", "hash_b").orderBy(*keys, "low"))
    firsts = firsts.withColumn("nth", nth).filter(F.col("nth") > 1).drop("nth")
    whole = seen.filter("whole").groupBy(*keys).agg(F.collect_list("place").alias("whole"))
    repeated = spans.filter(F.col("hash_a").isNull()).unionByName(firsts)
    part = repeated.groupBy(*keys).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return whole.join(part, keys, "full")


def covered(size: int, whole: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(begin, end) of the maximal runs of repeated bytes of a text."""
    low = [np.maximum(whole - _REACH, 0), spans[:, 0]]
    high = [np.minimum(whole + LENGTH, size), spans[:, 1]]
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.concatenate(low), 1)
    np.add.at(steps, np.concatenate(high), -1)
    inside = np.cumsum(steps[:-1]) > 0
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


_RUN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _cut_batch(batch: pa.RecordBatch, as_text: bool) -> Iterator[pa.RecordBatch]:
    none = np.zeros((0, 2), np.int64)
    texts, wholes, parts = (batch.column(name) for name in ("text", "whole", "spans"))
    for begin in range(0, batch.num_rows, 500):
        kept, sizes, removed = [], [], []
        for row in range(begin, min(begin + 500, batch.num_rows)):
            raw = texts[row].as_buffer().to_pybytes()
            sizes.append(len(raw))
            runs: list[list[int]] = []
            if wholes[row].is_valid or parts[row].is_valid:
                whole = wholes[row].values.to_numpy() if wholes[row].is_valid else none[:, 0]
                spans = none
                if parts[row].is_valid:
                    values = parts[row].values
                    spans = np.stack([values.field("low").to_numpy(), values.field("high").to_numpy()], axis=1)
                runs = covered(len(raw), whole.astype(np.int64), spans.astype(np.int64)).tolist()
                bounds = [0, *(at for run in runs for at in run), len(raw)]
                raw = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            removed.append([{"begin": a, "end": b} for a, b in runs])
            kept.append(raw.decode("utf-8", "ignore") if as_text else raw)
        yield pa.RecordBatch.from_pydict(
            {
                "row": batch.column("row").slice(begin, len(kept)),
                "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "removed": pa.array(removed, pa.list_(_RUN)),
            }
        )


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, beside the bytes ``kept``, ``n_bytes`` before, and the runs
    ``removed``. With ``as_text`` what is kept is text, without characters that a run cuts in two."""
    rows, keys = _keys(docs, doc_id, text)
    repeats = find_repeats(rows, keys)
    repeats = repeats.select(*[F.col(name).alias(f"key_{name}") for name in keys], "whole", "spans")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_FIRST_ID).cast("bigint"))
    marked = docs.select(whole_row(docs), number.alias("id"), body.alias("text"))
    same = F.col("id") == F.col("key_id")
    if len(keys) > 1:
        same = same & (F.xxhash64("text") == F.col("key_body"))
    joined = marked.join(repeats, same, "left").select("row", "text", "whole", "spans")
    kind = "string" if as_text else "binary"
    schema = f"row {joined.schema['row'].dataType.simpleString()}, kept {kind}, n_bytes bigint, removed array<struct<begin:bigint,end:bigint>>"
    return map_batches(joined, partial(_cut_batch, as_text=as_text), schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from their texts; all rows and other columns kept."""
    cut = cut_repeats(docs, doc_id, text, as_text=True)
    names = [F.col("kept").cast(docs.schema[text].dataType).alias(n) if n == text else F.col("row").getField(n).alias(n) for n in docs.columns]
    return cut.select(*names)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document as repeated, and a digest of the rest."""
    cut = cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, run: total + run["end"] - run["begin"])
    return cut.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP10_SQL = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(b[i + 1:i + 100]) AS w FROM (SELECT doc_id, b, unnest(range(n - 99)) AS i FROM texts WHERE n >= 100)
), firsts AS (
  SELECT w, min(doc_id * 1000000000 + i) AS f FROM windows GROUP BY w HAVING count(*) > 1
), ordered AS (
  SELECT doc_id, i, doc_id * 1000000000 + i > f AS again FROM windows JOIN firsts USING (w)
), runs AS (
  SELECT doc_id, i, i - 100 > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -101) AS opens
  FROM ordered WHERE again
), numbered AS (
  SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs
), spans AS (
  SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN lows IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(len(lows) + 1), lambda k:
    hex(b[(CASE WHEN k = 0 THEN 0 ELSE highs[k] END) + 1:(CASE WHEN k = len(lows) THEN n ELSE lows[k + 1] END)])), '') END)) AS kept_sha256
FROM texts LEFT JOIN cuts USING (doc_id)
"""
