"""Benchmark decontamination by winnowing.

Words are lower-cased in A-Z. Both sides are reduced to fingerprints: hashes of ``K`` consecutive words, of which every
``WINNOW`` neighbours keep the smallest (all that are smallest). A passage of ``WINNOW + K - 1`` shared words holds
``WINNOW`` k-grams on both sides, so both keep the same smallest one: joining the fingerprints finds every shared
window of ten words. A hit is then extended word by word, at most ``WINDOW - K`` words each way, and counts if ten
words agree; the hash only proposes. Items of fewer than ten words are one window each and are joined by their whole
word sequence, once for each such length that occurs.

Item contexts are grouped by their words first, so a passage that many items share is one row. They are broadcast
below ``BROADCAST_ROWS`` contexts (some 50 bytes a word), else joined by a shuffle whose hot keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, without

#: The word of the contract, upper case still in it: letters are folded after splitting.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
K = 5
WINNOW = WINDOW - K + 1
#: Contexts of 15 words and a list of items: at this count some 200 MB at most on an executor.
BROADCAST_ROWS = 200_000
OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def raw_words(text: Column) -> Column:
    """Words with their case; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_hashes(words: Column) -> Column:
    """A hash of each word. Case is folded further than the contract asks, so equal words have equal hashes."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def gram_hashes(hashes: Column, size: Column, k: int) -> Column:
    """Hash of the k-gram that starts at each word."""
    starts = F.when(size >= k, F.sequence(F.lit(0), size - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def window_minima(grams: Column) -> Column:
    """The smallest of each ``WINNOW`` neighbours."""
    last = F.size(grams) - WINNOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.least(*[F.get(grams, i + j) for j in range(WINNOW)]))


def kept_grams(grams: Column, minima: Column) -> Column:
    """(gram, at) of the k-grams that are smallest in some window; a window's minimum is at most each of its grams."""
    places = F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
    around = lambda i: F.greatest(*[F.get(minima, i - j) for j in range(WINNOW)])
    return F.filter(places, lambda p: p["gram"] == around(p["at"]))


def with_fingerprints(df: DataFrame, text: str) -> DataFrame:
    """Adds _words, _size, _hashes and _kept."""
    return (
        df.withColumn("_words", raw_words(F.col(text)))
        .withColumn("_size", F.size("_words"))
        .withColumn("_hashes", word_hashes(F.col("_words")))
        .withColumn("_grams", gram_hashes(F.col("_hashes"), F.col("_size"), K))
        .withColumn("_minima", window_minima(F.col("_grams")))
        .withColumn("_kept", kept_grams(F.col("_grams"), F.col("_minima")))
        .drop("_grams", "_minima")
    )  # to be expanded by inline_outer only: the filter that inline implies would be pushed below, all steps in one


def folded(words: Column) -> Column:
    """The words, folded, joined by a space. Free of lambdas, so that it stays in one generated loop with the join and
    a document's word array is not copied for each of its fingerprints."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def context(side: str) -> list[Column]:
    """Words before, in and after the k-gram at ``at``: three joined strings, cut at the ends of the text."""
    words, size, at = F.col(f"{side}_words"), F.col(f"{side}_size"), F.col(f"{side}_at")
    reach = WINDOW - K
    before = F.least(at, F.lit(reach))
    return [
        folded(F.slice(words, at - before + 1, before)),
        folded(F.slice(words, at + 1, F.lit(K))),
        folded(F.slice(words, at + K + 1, F.greatest(F.least(size - at - K, F.lit(reach)), F.lit(0)))),
    ]


def agreeing(left: Column, right: Column) -> Column:
    """Number of equal leading words of two arrays, counted up to the reach of an extension."""
    same = lambda i: F.coalesce((F.get(left, F.lit(i)) == F.get(right, F.lit(i))) & (F.get(left, F.lit(i)) != ""), F.lit(False))
    counted = F.when(~same(0), 0)
    for i in range(1, WINDOW - K):
        counted = counted.when(~same(i), i)
    return counted.otherwise(WINDOW - K)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def long_item_contexts(items: DataFrame) -> DataFrame:
    """One row per distinct fingerprint context of items of ten words or more, with the items that have it."""
    found = (
        items.where(F.col("_size") >= WINDOW)
        .select("item_id", F.col("_words").alias("i_words"), F.col("_size").alias("i_size"), F.inline_outer("_kept"))
        .withColumnRenamed("at", "i_at")
    )
    before, gram_words, after = context("i")
    return (
        found.where("gram IS NOT NULL").select("item_id", "gram", before.alias("i_before"), gram_words.alias("i_gram"), after.alias("i_after"))
        .groupBy("gram", "i_before", "i_gram", "i_after")
        .agg(F.collect_set("item_id").alias("items"))
    )


def long_hits(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(doc key, size, from, to, items) of extended hits, and of each document one row without a range: its size is
    known here, and splitting the texts again to count words costs as much as all the rest."""
    marked = F.concat("_kept", F.array(F.struct(F.xxhash64(*KEY).alias("gram"), F.lit(None).cast("int").alias("at"))))
    places = docs.select(*KEY, F.col("_words").alias("d_words"), F.col("_size").alias("d_size"), F.inline_outer(marked))
    joined = places.withColumnRenamed("at", "d_at").join(contexts, "gram", "left").where(F.col("items").isNotNull() | F.col("d_at").isNull())
    before, gram_words, after = context("d")
    hits = (
        joined.select(*KEY, "d_size", "d_at", "items", "i_before", "i_gram", "i_after", before.alias("before"), gram_words.alias("words"), after.alias("after"))
        .where((F.col("words") == F.col("i_gram")) | F.col("d_at").isNull())
        .withColumn("left", agreeing(F.reverse(F.split("before", " ")), F.reverse(F.split("i_before", " "))))
        .withColumn("right", agreeing(F.split("after", " "), F.split("i_after", " ")))
        .where((F.col("left") + F.col("right") + K >= WINDOW) | F.col("d_at").isNull())
    )
    ranged = lambda v: F.when(F.col("d_at").isNotNull(), v)
    return hits.select(
        *KEY,
        F.col("d_size").alias("size"),
        ranged(F.col("d_at") - F.col("left")).alias("from"),
        ranged(F.col("d_at") + K + F.col("right")).alias("to"),
        ranged(F.col("items")).alias("items"),
    )


def short_hits(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """Hits of the items of ``length`` words, fewer than ten."""
    windows = (
        items.where(F.col("_size") == length)
        .select("item_id", F.xxhash64("_hashes").alias("gram"), folded(F.col("_words")).alias("i_words"))
        .groupBy("gram", "i_words")
        .agg(F.collect_set("item_id").alias("items"))
    )
    starts = F.when(F.col("_size") >= length, F.sequence(F.lit(0), F.col("_size") - length)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("_hashes", i + 1, length)).alias("gram"), i.alias("at")))
    places = docs.withColumn("_all", grams).select(*KEY, "_words", "_size", F.inline_outer("_all"))
    return (
        places.join(maybe_broadcast(durable(windows, "short-items")), "gram")
        .where(folded(F.slice("_words", F.col("at") + 1, length)) == F.col("i_words"))
        .select(*KEY, F.col("_size").alias("size"), F.col("at").alias("from"), (F.col("at") + length).alias("to"), "items")
    )


#: Rows that agree in id and text have the same result, so this key needs no row number.
KEY = ("_id", "_text_hash")


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hit word ranges of documents: (_id, _text_hash, size, from, to, items), ``to`` exclusive; and per document a row
    without a range."""
    keyed = docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(f"`{text}`").alias("_text_hash"), F.col(f"`{text}`").alias("_text"))
    keyed = with_fingerprints(keyed, "_text")
    items = with_fingerprints(benchmark.select("item_id", F.col("text").alias("_text")), "_text").where("_size > 0")
    found = long_hits(keyed, maybe_broadcast(durable(long_item_contexts(items), "item-contexts")))
    lengths = [r[0] for r in items.where(F.col("_size") < WINDOW).select("_size").distinct().collect()]  # at most nine
    for length in sorted(lengths):
        found = found.unionByName(short_hits(keyed, items, length))
    return found


def with_right(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right`` that has the same key, nulls being equal."""
    named = right.withColumnsRenamed({k: f"_right{k}" for k in KEY})
    same = [left[k].eqNullSafe(named[f"_right{k}"]) for k in KEY]
    return left.join(named, same, "left").drop(*[f"_right{k}" for k in KEY])


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    Defined cases: a null text has no words; an item without words hits nothing; items with a null id hit words but are
    not listed; equal rows get equal results; items listed twice count once; an empty benchmark leaves all clean; columns
    named like one added here are replaced.
    """
    seen = durable(hits(docs, benchmark, key=key, text=text).distinct(), "hits")
    ranges = seen.where("to IS NOT NULL")
    sizes = seen.where("to IS NULL").select(*KEY, "size")
    # words covered by overlapping ranges, counted once: a range adds what lies past all earlier ones
    before = Window.partitionBy(*KEY).orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranges.groupBy(*KEY, "from").agg(F.max("to").alias("to"))
    covered = (
        spans.withColumn("past", F.coalesce(F.max("to").over(before), F.lit(0)))
        .groupBy(*KEY)
        .agg(F.sum(F.greatest(F.col("to") - F.greatest("from", "past"), F.lit(0))).cast("long").alias("_hit"))
    )
    listed = (
        ranges.select(*KEY, F.explode("items").alias("item"))
        .distinct()
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("_items"))
    )
    found = with_right(with_right(sizes, covered), listed).withColumnsRenamed(
        {"_id": "_hit_id", "_text_hash": "_hit_text_hash", "size": "_hit_size"}
    )
    rows = without(docs, *OWN).withColumn("_text_hash", F.xxhash64(f"`{text}`"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_hit_id")) & (F.col("_text_hash") == F.col("_hit_text_hash"))
    none = F.array().cast("array<string>")
    return (
        rows.join(found, same, "left")
        .withColumns(
            {
                "n_words": F.col("_hit_size").cast("long"),
                "n_hit": F.coalesce("_hit", F.lit(0)).cast("long"),
                "n_items": F.size(F.coalesce("_items", none)).cast("long"),
                "items_sha256": F.sha2(F.concat_ws(",", F.coalesce("_items", none)).cast("binary"), 256),
                "contaminated": F.coalesce("_hit", F.lit(0)) > 0,
            }
        )
        .drop("_text_hash", "_hit_id", "_hit_text_hash", "_hit_size", "_hit", "_items")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *OWN)


#: The contract by definition, window by window.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS th, row_number() OVER () AS rid,
                  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
           FROM documents),
     b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
           FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     k AS (SELECT DISTINCT k FROM bw),
     dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
     h AS (SELECT DISTINCT rid, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
     p AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT rid, i, unnest(range(0, k)) AS o FROM h) GROUP BY rid),
     t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
           FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
