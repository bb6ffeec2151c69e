"""Benchmark decontamination with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A benchmark window is
``WINDOW_WORDS`` consecutive words of an item; an item of fewer words, but not none, is one window.
A document word is hit when it lies inside an occurrence of any window.

A document is scanned in three steps that lose no occurrence:

1. Any occurrence of a window of ``w`` words covers a whole block of ``b`` words that begins at a
   multiple of ``b``, where ``2 b - 1 <= w`` for the shortest window. So only those blocks of a
   document are hashed, and looked up in the set of all ``b``-word runs of the windows.
2. Documents with a block in the set are read again, and each of their windows is compared, word
   for word, with the benchmark windows of its length.
3. Places found become hit words, and these the verdict; spans or documents can then be removed.

Runs and windows are broadcast only when both are counted to be within ``BROADCAST_ROWS``; a larger
benchmark is joined by a shuffle. Documents are aggregated before any exchange.

Defined results: NULL and empty texts have no words and are clean; benchmark rows with a NULL id or no
words are ignored; repeated benchmark rows count once; an empty benchmark contaminates nothing; document rows
with the same id and text are judged alike and each kept or removed; a NULL id is an id of its
own; other columns pass through the removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import materialise, read, unpacked, whole_row

WINDOW_WORDS = 13
#: A document is contaminated when at least one word in so many is hit.
CONTAMINATED_ONE_IN = 20
BROADCAST_ROWS = 200_000

_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; NULL and wordless texts give none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    parts = F.split(lowered, _BETWEEN_WORDS)
    # an empty string can only stand at either end
    return F.filter(parts, lambda word: word != "")


def _run_hash(words: Column, first: Column, size: int | Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, first, size), " "))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (item_id, words) of the windows, words joined by one space, with their number."""
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(width)))
    firsts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    rows = items.select("item_id", "n", F.explode(F.transform(firsts, lambda i: F.slice("words", i, F.col("n")))).alias("run"))
    return rows.select("item_id", "n", F.array_join("run", " ").alias("window")).distinct()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Identity of a row: its id and its text's hash, so equal ids with other texts stay apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("body"), body.alias("text"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, places).

    ``documents`` has one row per distinct (id, text) with ``doc_id, body, n_words, copies``.
    ``places`` has every occurrence: ``doc_id, body, first_word`` (from 0), ``n`` words,
    ``item_id``, ``n_words``.
    """
    windows = materialise(benchmark_windows(benchmark, item_id, item_text, width))
    sizes = [r["n"] for r in windows.select("n").distinct().orderBy("n").collect()]  # at most ``width`` values
    block = (sizes[0] + 1) // 2 if sizes else width
    keyed = _keyed(docs, doc_id, text)
    runs = windows.select(F.split("window", " ").alias("words"), "n").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - block + 1), lambda i: _run_hash(F.col("words"), i, block))).alias("run")
    ).distinct().withColumn("known", F.lit(True))
    few = max(runs.count(), windows.count()) <= BROADCAST_ROWS

    tokens = keyed.select("doc_id", "body", words_of(F.col("text")).alias("words"))
    last = (F.size("words") / block).cast("int")
    blocks = F.when(
        last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), lambda i: _run_hash(F.col("words"), i * block + 1, block))
    )
    scanned = tokens.select("doc_id", "body", F.size("words").alias("n_words"), F.posexplode_outer(blocks).alias("nth", "run"))
    looked_up = scanned.join(F.broadcast(runs) if few else runs, "run", "left")
    documents = materialise(
        looked_up.groupBy("doc_id", "body", "n_words").agg(
            F.max(F.coalesce("known", F.lit(False))).alias("candidate"),
            F.count(F.when(F.coalesce("nth", F.lit(0)) == 0, 1)).alias("copies"),
        )
    )

    candidates = documents.filter("candidate").select(F.col("doc_id").alias("id"), F.col("body").alias("hash"), "n_words")
    same = keyed["doc_id"].eqNullSafe(F.col("id")) & (keyed["body"] == F.col("hash"))
    reread = keyed.join(candidates, same).select("doc_id", "body", "n_words", words_of(F.col("text")).alias("words"))
    found = None
    for n in sizes:
        begins = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))))
        texts = F.transform(begins, lambda i: F.array_join(F.slice("words", i + 1, n), " "))
        at = reread.select("doc_id", "body", "n_words", F.posexplode(texts).alias("first_word", "window"))
        known = windows.filter(F.col("n") == n)
        part = at.join(F.broadcast(known) if few else known, "window").drop("window")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.limit(0).select("doc_id", "body", "n_words", F.lit(0).alias("first_word"), F.lit(0).alias("n"), F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"))
    return documents.drop("candidate"), found.select("doc_id", "body", "n_words", "first_word", "n", "item_id")


def judge_contamination(documents: DataFrame, places: DataFrame) -> DataFrame:
    """One row per distinct (id, text): ``n_words, n_hit, items, contaminated, copies``."""
    covered = F.sequence(F.col("first_word"), F.col("first_word") + F.col("n") - 1)
    hit = places.select("doc_id", "body", F.col("item_id").cast("string").alias("item"), F.explode(covered).alias("word"))
    found = hit.groupBy(F.col("doc_id").alias("id"), F.col("body").alias("hash")).agg(
        F.countDistinct("word").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )
    same = documents["doc_id"].eqNullSafe(F.col("id")) & (documents["body"] == F.col("hash"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return documents.join(found, same, "left").select(
        "doc_id",
        "body",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (CONTAMINATED_ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
        "copies",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; all columns kept."""
    judged = judge_contamination(*find_contamination(docs, benchmark, doc_id, text))
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("body").alias("bad_body"))
    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(whole_row(docs), F.col(doc_id).alias("id"), body.alias("body"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("body") == F.col("bad_body"))
    return unpacked(rows.join(bad, same, "left_anti"), docs)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, and the verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = read(spark, sf_dir, "benchmark").select("item_id", "text")
    judged = judge_contamination(*find_contamination(docs, benchmark))
    rows = judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    return rows.drop("copy")


OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS run FROM starts
), doc_starts AS (
  SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
  FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), places AS (
  SELECT doc_id, i, d.n, item_id FROM
  (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS run FROM doc_starts) d JOIN windows USING (n, run)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM places) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM places GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
