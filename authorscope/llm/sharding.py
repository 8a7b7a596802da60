"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a global number in [0, n), the numbers are permuted, and the permuted number p gives ``shard = p %
shards`` and ``slot = p // shards``. Shards therefore differ by one row at most and slots have no gaps, whatever the
data; where any row lies is computable from its number alone.

Rows are numbered without a global sort: ids are hashed into a fixed number of buckets, the bucket counts (a table of
at most ``BUCKETS`` rows) give each bucket's first number, and rows are ranked inside their bucket by (key, checksum,
size). Buckets are even for any distribution of texts or sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, without
from .permutation import grid, permuted

BUCKETS = 4096
SEED = 20_240_517
SHARDS = 40
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_rows(
    docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", overhead: int = 16
) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus ``overhead``; text_crc32 its checksum. law is ``rows``: row counts of shards
    differ by one at most (grown_shard is null, as adding a shard moves rows everywhere). Defined cases: a null text
    counts as empty; null keys are ranked first; rows equal in key, checksum and size take consecutive numbers in any
    order, which no column of theirs but further columns of the input can tell; an empty table gives an empty table;
    a column of the input named like one added here is replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = without(docs, *OWN).withColumns(
        {
            "size": F.octet_length(body).cast("long") + F.lit(overhead).cast("long"),
            "text_crc32": F.crc32(body.cast("binary")),
        }
    )
    # the key decides the bucket; the checksum spreads rows that share a key
    bucket = (F.crc32(F.concat_ws(":", F.col(f"`{key}`").cast("string"), F.col("text_crc32").cast("string")).cast("binary")) % BUCKETS).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
    total, first = 0, {}
    for bucket_id, n in sorted(counts):
        first[bucket_id] = total
        total += n
    a, b = grid(total)
    starts = F.split(F.lit(",".join(str(first.get(i, 0)) for i in range(BUCKETS))), ",").cast("array<bigint>")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(f"`{key}`"), "text_crc32", "size")).cast("long")
    number = F.get(starts, F.col("_bucket")) + rank - 1
    as_long = lambda v: F.lit(v).cast("long")
    place = permuted(F.col("_number"), as_long(max(total, 1)), as_long(a), as_long(b), seed)
    return (
        rows.withColumn("_number", number)
        .withColumn("_place", place)
        .withColumns(
            {
                "law": F.lit("rows"),
                "shard": (F.col("_place") % shards).cast("int"),
                "slot": ((F.col("_place") - F.col("_place") % shards) / shards).cast("long"),
                "grown_shard": F.lit(None).cast("int"),
            }
        )
        .drop("_bucket", "_number", "_place")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents")).select("doc_id", *OWN)
