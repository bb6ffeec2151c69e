"""Near-duplicate classes of texts by BagMinHash.

A text is the multiset of its runs of five words (lower-cased A-Z, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; fewer words, but not none, are one run). Texts are linked when
the weighted Jaccard similarity of their multisets, counted exactly, is at least ``SIMILARITY``;
a class is a connected component of links.

Signature: each run of a text is a Poisson process over (weight, time), cut into the dyadic
weight intervals (0,1], (1,2], (2,4], ...; an interval's points come in order of time and fall
on a slot and, by further halving of the interval, on one of the discrete weights. A text keeps for
each slot the first point at a weight it reaches, and a process ends once its time is past the
text's slowest slot. Two texts then agree in a slot with a chance that equals their weighted
Jaccard similarity. ``BANDS`` bands of ``ROWS`` slots give candidates; a pair at the threshold
is missed by all of them with a chance of about 3e-6.

How the work is spread:

* Equal word sequences are one node, found by a grouped minimum; only nodes go on.
* In a bucket, members are first compared with its leader only (the member that shares most
  buckets), so a bucket of n texts gives n - 1 pairs. Texts verified to be similar are joined into
  components.
* Pairs of one bucket still in different components are then compared where they are: the bucket
  is split in blocks of at most ``BLOCK_MEMBERS`` texts and ``BLOCK_SHINGLES`` runs, and each pair of
  blocks is one group. Inside it, texts of different components whose signatures agree in at least
  ``ESTIMATE_FLOOR`` of the slots (five standard deviations below the threshold) are counted exactly,
  in the first band that they share. Only links that join two components leave the group, so no
  link between different components is lost, and neither pairs of one component nor pairs that
  fall short become rows.

Defined results: NULL and empty texts, and texts without words, are each a class of their own;
repeated rows and equal texts are one class; ties go to the smaller id, NULL ids first; an empty
table gives an empty result; other columns pass through :func:`keep_one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.llm.components import components
from stallwise.llm.tables import map_batches, materialise, read, unpacked, whole_row
from stallwise.llm.words import ALNUM_LOWER, Words, find_words, mix, sequence_hashes, text_chunks, window_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SLOTS = 96
ROWS = 4
BANDS = SLOTS // ROWS
ESTIMATE_FLOOR = 0.6
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 2_000_000

_BYTES = 4  # of a slot in a stored signature


def shingle_bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of a chunk, ordered by text and shingle."""
    text, _, value = window_hashes(words, SHINGLE_WORDS, whole_if_shorter=True)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if not len(text):
        return text, value, text
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])]))
    return text[first], value[first], np.diff(np.append(first, len(text)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots, 32 bits each) of weighted sets; weights are whole numbers."""
    best = np.full(texts * slots, np.inf)
    winner = np.zeros(texts * slots, np.uint64)
    # one process for each dyadic weight interval (low, low + width] that the element's weight reaches
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    seed = mix(element[owner] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    reach, place = weight[owner], text[owner]
    time = np.zeros(len(owner))
    drawn = 0
    while len(owner):
        points = int(np.clip(8192 // len(owner), 1, 64))
        number = np.arange(drawn, drawn + points, dtype=np.uint64) * np.uint64(3)
        draw = seed[:, None] + number[None, :] * np.uint64(0xD1342543DE82EF95)
        gap = -np.log(_uniform(mix(draw + np.uint64(1)))) / width[:, None]
        # summed from left to right, so a point's time does not depend on how many are drawn at once
        at = np.cumsum(np.concatenate([time[:, None], gap], axis=1), axis=1)[:, 1:]
        mark = mix(draw + np.uint64(2))
        slot = ((mark >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        # halving the interval again and again ends at one of its whole weights
        height = low[:, None] + 1 + ((mark & np.uint64(0xFFFFFFFF)) % width.astype(np.uint64)[:, None]).astype(np.int64)
        held = height <= reach[:, None]
        where, at_held = (place[:, None] * slots + slot)[held], at[held]
        np.minimum.at(best, where, at_held)
        won = at_held == best[where]
        winner[where[won]] = mark[held][won]
        slowest = best.reshape(texts, slots).max(axis=1)
        time, drawn = at[:, -1], drawn + points
        going = time < slowest[place]
        owner, seed, width, low, reach, place, time = (x[going] for x in (owner, seed, width, low, reach, place, time))
    # points are told apart by their own hash, not by the bits of their times
    return (mix(winner) >> np.uint64(32)).astype(np.uint32).reshape(texts, slots)


def _content_hash(words: Words) -> np.ndarray:
    """Hash of each text's word sequence, 0 for a text without words."""
    out = np.zeros(len(words.counts), np.uint64)
    some = words.counts > 0
    first = words.firsts()[some]
    out[some] = sequence_hashes(words.hash, first, first + words.counts[some])
    return out


def _sign_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batch.column("text")):
        words = find_words(chunk, ALNUM_LOWER)
        bag = shingle_bags(words)
        signature = bag_minhash(*bag, len(chunk)).view(np.uint8).reshape(len(chunk), -1)
        none = words.counts == 0
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id").slice(chunk.first, len(chunk)),
                "body": batch.column("body").slice(chunk.first, len(chunk)),
                "node": pa.array(_content_hash(words).view(np.int64), mask=none),
                "n": pa.array(np.where(none, 0, np.maximum(words.counts - SHINGLE_WORDS + 1, 1))),
                "signature": pa.array([None if empty else row.tobytes() for empty, row in zip(none, signature)], pa.binary()),
            }
        )


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("body"), body.alias("text"))


def _signed(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, _sign_batch, f"id {kind}, body bigint, node bigint, n bigint, signature binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, key, node): one row per band; the key tells bands apart."""
    size = ROWS * _BYTES
    keys = F.array(*[F.xxhash64(F.lit(band), F.substring("signature", band * size + 1, size)) for band in range(BANDS)])
    return nodes.select("node", F.posexplode(keys).alias("band", "key"))


def _similar_sizes(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")


def _compare_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Exact weighted Jaccard similarity of each row's two texts."""
    count = batch.num_rows
    texts = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")])
    texts = texts.take(pa.array(np.arange(2 * count).reshape(2, count).T.ravel()))
    similarity = np.zeros(count)
    for chunk in text_chunks(texts, together=2):
        words = find_words(chunk, ALNUM_LOWER)
        text, shingle, times = shingle_bags(words)
        pairs = len(chunk) // 2
        order = np.lexsort((shingle, text // 2))
        pair, shingle, times = text[order] // 2, shingle[order], times[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
        shared = np.bincount(pair[same], weights=np.minimum(times[same], times[same + 1]), minlength=pairs)
        both = np.bincount(pair, weights=times, minlength=pairs)
        similarity[chunk.first // 2 : chunk.first // 2 + pairs] = shared / np.maximum(both - shared, 1)
    yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(similarity)})


def _texts(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of some nodes."""
    wanted = wanted.join(nodes, "node").select("node", F.col("first.id").alias("first_id"), F.col("first.body").alias("first_body"))
    same = rows["id"].eqNullSafe(F.col("first_id")) & (rows["body"] == F.col("first_body"))
    # one row per node, also where a row is repeated
    return rows.join(wanted, same).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough, counted exactly."""
    sizes = nodes.select("node", "n")
    pairs = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(_similar_sizes(similarity))
    pairs = materialise(pairs.select("a", "b"))
    texts = materialise(_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, rows))
    sides = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    compared = map_batches(sides.select("a", "b", "text_a", "text_b"), _compare_batch, "a bigint, b bigint, similarity double")
    return compared.filter(F.col("similarity") >= similarity - 1e-12).select("a", "b")


def _elements(texts: pd.Series) -> list[np.ndarray]:
    """Each text's bag as a sorted set: a run's second time is an element of its own, and so on."""
    out: list[np.ndarray] = []
    for chunk in text_chunks(pa.array(texts, pa.large_string())):
        text, shingle, times = shingle_bags(find_words(chunk, ALNUM_LOWER))
        again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        element = mix(np.repeat(shingle, times) + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        text = np.repeat(text, times)
        element = element[np.lexsort((element, text))]
        out.extend(np.split(element, np.cumsum(np.bincount(text, minlength=len(chunk)))[:-1]))
    return out


def _block_links(members: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between components among the texts of two blocks; one that joins two is enough."""
    low, high, band = (members[c].iloc[0] for c in ("low", "high", "band"))
    members = members.sort_values("node", kind="stable")
    slots = np.frombuffer(b"".join(members["signature"]), np.uint32).reshape(len(members), -1)
    node, block = members["node"].to_numpy(), members["block"].to_numpy()
    root = members["root"].to_numpy().copy()
    first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
    elements: list[np.ndarray] | None = None
    out: list[tuple[int, int]] = []
    for i in first:
        others = second[(root[second] != root[i]) & ((second > i) | (low != high))]
        same = slots[others] == slots[i]
        close = same.mean(axis=1) >= ESTIMATE_FLOOR
        # a pair is compared in the first band that it shares
        shared = same[close].reshape(-1, BANDS, ROWS).all(axis=2)
        close = others[close][shared.argmax(axis=1) == band]
        if not len(close):
            continue
        if elements is None:
            elements = _elements(members["text"])
        own, sizes = elements[i], np.array([len(elements[j]) for j in close])
        theirs = np.concatenate([elements[j] for j in close])
        found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
        alike = common / (sizes + len(own) - common) >= similarity - 1e-12
        for j in close[alike]:
            if root[j] != root[i]:
                out.append((max(node[i], node[j]), min(node[i], node[j])))
                root[root == root[j]] = root[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _left_over(members: DataFrame, roots: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Links between texts of one bucket that are still in different components."""
    sized = members.join(nodes.select("node", "n"), "node")
    placed = sized.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"), F.sum("n").alias("shingles")
    )
    # the one pair of a bucket of two has been compared
    mixed = mixed.filter((F.col("least") != F.col("most")) & (F.col("size") > 2))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = materialise(placed.select("key", "band", "node", "root").join(mixed.select("key", blocks.alias("blocks")), "key"))
    texts = _texts(placed.select("node").distinct(), nodes, rows)
    own = placed.join(nodes.select("node", "signature"), "node").join(texts, "node")
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = other.select(
        "key", "band", "node", "root", "signature", "text", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    return groups.groupBy("key", "low", "high").applyInPandas(lambda group: _block_links(group, similarity), "a bigint, b bigint").distinct()


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, ``body`` (hash of the text), ``class_id`` (the least id of
    the class), ``class_size`` (rows), ``has_words`` and ``stays`` (it is the class's first row)."""
    rows = _rows(docs, doc_id, text)
    signed = materialise(_signed(rows))
    nodes = materialise(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min(F.struct("id", "body")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    )
    bands = _bands(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    members = materialise(bands.join(shared, "key"))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(weight, "node")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    first = members.join(leaders, "key").filter(F.col("node") != F.col("leader"))
    first = materialise(first.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
    links = materialise(_verified(first, nodes, rows, similarity))
    roots = materialise(components(links))
    more = materialise(_left_over(members, roots, nodes, rows, similarity))
    if not more.isEmpty():
        roots = materialise(components(links.unionByName(more)))
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "copies")
    classes = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("size"))
    known = placed.select("node", "root").join(classes, "root").select("node", "first", "size")
    joined = signed.select("id", "body", "node").join(known, "node", "left")
    lone = F.col("node").isNull()
    return joined.select(
        "id",
        "body",
        F.when(lone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(lone, 1).otherwise(F.col("size")).cast("bigint").alias("class_size"),
        (~lone).alias("has_words"),
        (lone | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("body") == F.col("first.body")))).alias("stays"),
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the first document of each class; all columns kept."""
    classes = near_duplicate_classes(docs, doc_id, text, similarity).filter("stays")
    stays = classes.select(F.col("id").alias("stay_id"), F.col("body").alias("stay_body"), "has_words").distinct()
    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(whole_row(docs), F.col(doc_id).alias("id"), body.alias("body"))
    joined = rows.join(stays, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("body") == F.col("stay_body")))
    same_row = Window.partitionBy("stay_id", "stay_body").orderBy("stay_body")
    nth = joined.withColumn("nth", F.row_number().over(same_row))
    return unpacked(nth.filter((F.col("nth") == 1) | ~F.col("has_words")), docs)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, and the one that stays."""
    classes = near_duplicate_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("stays").alias("representative"))
