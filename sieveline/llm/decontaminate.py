"""Benchmark decontamination as a prefix-filtered set join.

Both sides are sets of word shingles. The shingles of the benchmark are ordered
by rarity in the corpus; a window can only occur where its rarest shingle does,
so that one is the necessary prefix. Its postings are joined, bounded by the
window's place and length. A window whose other shingles stand at their places
too is compared word by word. Only the documents of such windows have their
texts looked up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import SlotFilter
from .common import ROW_KEY, alnum_words, ascii_lower, materialize, row_key, with_row_key, with_run_hashes

#: Words of a benchmark window (fixed by the contract) and of a shingle.
WINDOW, SHINGLE = 10, 4


def _word_hashes(words: Column) -> Column:
    # lower() is the faster one, and the same where a word is ASCII.
    return F.transform(words, lambda w: F.xxhash64(F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(ascii_lower(w))))


def _with_shingles(df: DataFrame, size: int) -> DataFrame:
    """Adds g<size>, the hashes of all runs of ``size`` words of column wh."""
    column = f"g{size}"
    df = with_run_hashes(df.withColumn(column, F.col("wh")), column, {1: 0, 2: 1, 3: 1, 4: 2}[size])
    if size == 3:
        n = F.greatest(F.size(column) - 1, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(column, 1, n), F.slice(column, 2, n), lambda a, b: F.xxhash64(a, b)))
    return df


def _places(size: int) -> Column:
    return F.transform(f"g{size}", lambda h, i: F.struct(F.lit(size).alias("len"), i.alias("pos"), h.alias("h")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window of every item: item, size, win (its words), len
    (shingle words), shingles (in order)."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(ascii_lower(F.col("text"))).alias("w")
    ).where(F.size("w") > 0)
    windows = items.select(
        "item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("win")
    ).withColumn("size", F.size("win"))
    hashed = windows.withColumn("len", F.least(F.col("size"), F.lit(SHINGLE))).withColumn("wh", _word_hashes(F.col("win")))
    for n in range(1, SHINGLE + 1):
        hashed = _with_shingles(hashed, n)
    by_len = F.when(F.col("len") == 1, F.col("g1")).when(F.col("len") == 2, F.col("g2")).when(F.col("len") == 3, F.col("g3")).otherwise(F.col("g4"))
    return hashed.select("item", "size", "win", "len", by_len.alias("shingles"))


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, the row key, n_words) and, for those with any,
    their hits (the row key, n_hit, n_items, sha)."""
    windows = materialize(benchmark_windows(benchmark, window).withColumn("window", F.monotonically_increasing_id()), "windows")
    tokens = materialize(windows.select(F.explode("shingles").alias("h")).distinct(), "tokens")
    # Shingle sizes below the usual one occur only with items of that few words.
    lengths = sorted({r[0] for r in windows.select("len").distinct().collect()} | {SHINGLE})

    hashed = docs.select("doc_id", *row_key(docs), alnum_words(F.col("text")).alias("w")).select("doc_id", *ROW_KEY, F.size("w").alias("n_words"), _word_hashes(F.col("w")).alias("wh"))
    # One marker at place -1 carries the document itself through the same scan.
    marker = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("h")))
    for n in lengths:
        hashed = _with_shingles(hashed, n)
    postings = hashed.select("doc_id", *ROW_KEY, "n_words", F.explode_outer(F.concat(marker, *map(_places, lengths))).alias("s")).select("doc_id", *ROW_KEY, "n_words", "s.*")
    seen = materialize(postings.where((F.col("pos") < 0) | SlotFilter(tokens, "h").may_contain(F.col("h"))), "postings")
    all_docs = seen.where("pos < 0").select("doc_id", *ROW_KEY, "n_words")
    found = materialize(seen.where("pos >= 0").join(tokens, "h", "left_semi").select(*ROW_KEY, "n_words", "len", "pos", "h").distinct(), "found")

    # Order by rarity in the corpus; the rarest shingle of a window is its prefix.
    rarity = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    places = windows.select("window", "size", "len", F.posexplode("shingles").alias("j", "h"))
    prefix = places.join(rarity, "h", "left").groupBy("window", "size", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "h")).alias("p")).select("window", "size", "len", "p.*").where("n > 0")
    start = F.col("pos") - F.col("j")
    candidates = found.join(prefix.drop("n"), ["h", "len"]).withColumn("start", start).where("start >= 0 and start + size <= n_words").select(*ROW_KEY, "start", "window").distinct()

    # All shingles at their places, then all words: each a join on places.
    at = [*ROW_KEY, "start", "window"]
    expected = candidates.join(places.drop("size"), "window").select(*at, "len", "h", (F.col("start") + F.col("j")).alias("pos"))
    standing = expected.join(found.drop("n_words"), [*ROW_KEY, "len", "h", "pos"]).groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    standing = materialize(standing.join(windows.select("window", "item", "size", F.size("shingles").alias("of")), "window").where("n = of").select(*at, "item", "size"), "standing")
    owners = materialize(standing.select(*ROW_KEY).distinct(), "owners")
    texts = docs.select(*row_key(docs), "text").join(owners, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    words = texts.select(*ROW_KEY, F.posexplode(alnum_words(ascii_lower(F.col("text")))).alias("pos", "word"))
    wanted = standing.select(*at).join(windows.select("window", F.posexplode("win").alias("j", "word")), "window").select(*at, "word", (F.col("start") + F.col("j")).alias("pos"))
    equal = wanted.join(words, [*ROW_KEY, "pos", "word"]).groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    hits = materialize(standing.join(equal, at).where("n = size").select(*ROW_KEY, "start", "size", "item"), "hits")

    covered = hits.select(*ROW_KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select(*ROW_KEY, F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    return all_docs, materialize(covered.join(items, ROW_KEY), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Overlap of every document with the benchmark.

    Returns one row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated. Null or empty texts have no words and no hits;
    texts of any length are read whole; repeated rows each get a row; a null
    item_id counts as the empty string; items that share an id are told apart by
    their windows; items without words are no items. Other columns of either
    table are not read. An empty table on either side gives no hits.
    """
    all_docs, hits = overlap(docs, benchmark, window)
    return all_docs.join(hits, ROW_KEY, "left").select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs. Columns
    stay as they are, whatever their names; nulls, repeats, texts of any length
    and empty tables are as in ``decontaminate``."""
    _, hits = overlap(docs, benchmark, window)
    keyed, names = with_row_key(docs)
    dirty = hits.select(*[F.col(k).alias(names[k]) for k in ROW_KEY])
    return keyed.join(dirty, list(names.values()), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
