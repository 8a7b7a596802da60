"""Exact top-k per group that holds up when one group spans every task, for any k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import durable

#: Up to this k Spark keeps only k rows of a group in each map task (its window group limit).
PRUNED_K = 1000
#: Ranges a round of counting divides a group into, and sampled rows from which their borders are taken.
RANGES, SAMPLE = 64, 1024
#: Groups divided at once: those with more than this share of the rows of all large groups.
HOT_GROUPS = 1000


def leading_rows(rows: DataFrame, keys: list[str], order: list[Column | str], k: int, fan_in: int = 512) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` (from 1). ``order`` must be total within a group; for a k
    above ``PRUNED_K`` it must be ascending.

    Small k: each map task keeps at most ``k`` rows of a group; groups of tasks are merged first, then the merged rows.
    A group present in a million tasks reaches its last task as ``fan_in * k`` rows, where a single window would receive
    ``k`` rows from every task. Large k: rows beyond the k-th of a hot group are found by counting and never move.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    if k > PRUNED_K:
        return without_tails(rows, keys, order, k).withColumn("rank", rank).where(F.col("rank") <= k)
    salted = rows.withColumn("_salt", F.spark_partition_id() % fan_in)
    merged = (
        salted.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
        .where(F.col("rank") <= k)
        .drop("rank", "_salt")
    )
    return merged.withColumn("rank", rank).where(F.col("rank") <= k)


def without_tails(rows: DataFrame, keys: list[str], order: list[Column | str], k: int, enough: int = 100_000) -> DataFrame:
    """``rows`` less those of hot groups that lie beyond some row that is the k-th or later.

    Selection by counts over key ranges: a group's rows are counted in ranges between sampled rows, the range that holds
    the k-th row is divided again until it has at most ``enough`` rows (4 k if that is more), and its upper border cuts
    the group. Samples only place the borders; the counts are of all rows, so the cut is right wherever they fall. A
    group is hot with more than 1 / ``HOT_GROUPS`` of the rows of all groups that are large, so borders are a table of
    ``HOT_GROUPS`` rows at most; all other groups are spread by their number.
    """
    enough = max(enough, 4 * k)
    placed = rows.select(F.struct(*keys).alias("_key"), F.struct(*order).alias("_place"))
    large = durable(placed.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > enough), "large-groups")
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return rows
    kind = placed.schema["_place"].dataType
    none = F.lit(None).cast(kind)
    hot = large.where(F.col("n") * HOT_GROUPS > total).select(
        "_key", "n", F.lit(0).cast("long").alias("before"), none.alias("low"), none.alias("high")
    )
    cuts = durable(hot, "cuts")
    while (open_ := cuts.where(F.col("n") > enough)).limit(1).count():
        inside = placed.join(F.broadcast(open_), "_key").where(
            (F.col("low").isNull() | (F.col("_place") > F.col("low"))) & (F.col("high").isNull() | (F.col("_place") <= F.col("high")))
        )
        drawn = inside.where(F.pmod(F.xxhash64("_place"), F.col("n")) < SAMPLE)
        borders = durable(
            drawn.groupBy("_key").agg(F.sort_array(F.collect_set("_place")).alias("drawn"))  # some SAMPLE rows
            .select("_key", F.filter("drawn", lambda d, i: i % (SAMPLE // RANGES) == SAMPLE // RANGES - 1).alias("borders")),
            "borders",
        )
        counted = (
            inside.join(F.broadcast(borders), "_key")
            .select("_key", F.size(F.filter("borders", lambda b: b < F.col("_place"))).alias("range"))
            .groupBy("_key", "range")
            .agg(F.count("*").alias("rows"))
        )
        so_far = W.partitionBy("_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        holding = (
            counted.join(open_, "_key").join(borders, "_key")
            .withColumn("before", F.col("before") + F.coalesce(F.sum("rows").over(so_far), F.lit(0)))
            .where((F.col("before") < k) & (F.col("before") + F.col("rows") >= k))
        )
        narrowed = holding.select(
            "_key",
            F.col("rows").alias("n"),
            "before",
            F.when(F.col("range") > 0, F.get("borders", F.col("range") - 1)).otherwise(F.col("low")).alias("low"),
            F.coalesce(F.get("borders", F.col("range")), F.col("high")).alias("high"),
        )
        moved = durable(cuts.where(F.col("n") <= enough).unionByName(narrowed), "cuts")
        if moved.agg(F.sum("n")).first()[0] == cuts.agg(F.sum("n")).first()[0]:  # as few distinct places as borders
            cuts = moved
            break
        cuts = moved
    side = F.broadcast(cuts.where("high IS NOT NULL").select("_key", "high"))
    kept = rows.withColumns({"_key": F.struct(*keys), "_place": F.struct(*order)}).join(side, "_key", "left")
    return kept.where(F.col("high").isNull() | (F.col("_place") <= F.col("high"))).select(*[F.col(f"`{c}`") for c in rows.columns])
