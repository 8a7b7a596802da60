"""Mixing sources to target weights.

A source's documents, in a fixed order, are one stream of words, packed into blocks of ``BLOCK`` words (the last may be
shorter). Output shards of the mix are filled by slots; how many slots of each shard a source fills is a multinomial
draw over all slots that the source owes, so that its total is met exactly and shards are near equal. The k-th slot of a
source takes turn ``k mod blocks`` of pass ``k // blocks``; each pass has its own Feistel permutation of the whole blocks
and a pseudorandom turn for the short one, so no block is used more than once a pass, the words before any slot are
known from its number, and the last slot is cut to the words that are still owed. Blocks are joined by index.

Sources are a table like any other: they are ranked by ranges, targets are settled by rounds of sums, and each source
draws its counts in a task, from a seed of its own. Places in a stream come from sums over hash buckets and ranks inside
a bucket, so a source with a third of all rows is spread over ``BUCKETS`` tasks. Shards, and with them the ranges in which
slots are made, grow in number with the slots. The driver holds a count per range of sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_words, durable, read
from .permutation import permuted, sides

#: Words of a block.
BLOCK = 128
#: Output shards, at least; there are as many more as keep a shard at about ``SHARD_SLOTS`` slots.
SHARDS = 64
SHARD_SLOTS = 65_536
BUCKETS = 512
SEED = 7
#: Weights by place of the source in code point order, repeated.
WEIGHTS = (1, 2, 3)
#: A target stops at this many times its source's size.
REPEATS = 3
#: Sources ranked by one task, about, and slots made by one task, about.
RANGE = 100_000


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` (_source, source_size) with source_no, the place in the order of ``_source``, null last; an "=" before
    every name keeps the null source, an empty string, apart from the empty one. Ranges are sorted apart."""
    sizes = durable(sizes, "source-sizes")
    ranges = -(-sizes.count() // RANGE) or 1
    order = [F.col("_source") == "", F.col("_source")]
    ranged = durable(sizes.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "source-ranges")
    total, first = 0, []
    for number, count in sorted(ranged.groupBy("_range").count().collect()):  # a row per RANGE sources
        first.append((number, total))
        total += count
    starts = sizes.sparkSession.createDataFrame(first, "_range int, _first long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_rank", rank).join(starts, "_range").select("_source", "source_size", (F.col("_first") + F.col("_rank")).alias("source_no"))


def with_targets(sources: DataFrame, weights: tuple[float, ...], most: float = REPEATS) -> DataFrame:
    """``sources`` (source_no, source_size) with target: all sizes shared by weight, where a share above ``most`` times
    its size stops there and the excess is shared anew. Weights are above 0 and ``most`` is 1 at least.

    A round is one sum over the sources; the share of a unit of weight only grows, and rounds end when no source stops.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)).cast("int"))
    top = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit, stopped = 0.0, -1
    while True:
        over = weight * F.lit(unit) > top
        fixed, open_, count = (
            sources.where("source_size > 0")
            .agg(F.sum(F.when(over, top)), F.sum(F.when(~over, weight)), F.count(F.when(over, 1)))
            .first()
        )
        if count <= stopped or not open_:
            break
        unit, stopped = (total - (fixed or 0.0)) / open_, count
    return sources.withColumn("target", F.when(F.col("source_size") == 0, 0.0).when(over, top).otherwise(weight * F.lit(unit)))


def with_slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """``sources`` with owed (words), full and short (whole blocks, words of the last block if it is shorter), blocks,
    a, b (the grid of the whole blocks) and slots, the number of slots that give just the words owed."""
    size = F.col("source_size")
    sources = sources.withColumn("owed", F.least(F.round("target").cast("long"), size * REPEATS))
    sources = sources.withColumns({"short": size % block, "full": ((size - size % block) / block).cast("long")})
    sources = sources.withColumn("blocks", F.col("full") + (F.col("short") > 0).cast("long"))
    a, b = sides(F.col("full"))
    some = F.when(size > 0, size)  # null where there are no words to divide by
    rest = F.col("owed") % some
    sources = sources.withColumns({"a": a, "b": b, "_rest": rest, "_turns": ((F.col("owed") - rest) / some).cast("long")})
    least = F.ceil(F.col("_rest") / block)
    lacking = block * least - F.when(short_turn(F.col("_turns"), seed) < least, block - F.col("short")).otherwise(0) < F.col("_rest")
    slots = F.col("_turns") * F.col("blocks") + least + lacking.cast("long")
    return sources.withColumn("slots", F.when(size > 0, slots).otherwise(0).cast("long")).drop("_rest", "_turns")


def short_turn(number: Column, seed: int) -> Column:
    """The turn at which pass ``number`` of a source takes its short block; a source without one has it past all turns."""
    turn = F.pmod(F.xxhash64(F.lit(seed), F.col("source_no"), number.cast("long")), F.col("blocks"))
    return F.when(F.col("short") > 0, turn).otherwise(F.col("blocks"))


def draws(slots: int, shards: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A multinomial draw of ``slots`` over equal shards: the shards met, in order, and the slots in each."""
    if slots < shards:
        return np.unique(random.integers(0, shards, slots), return_counts=True)
    counts = random.multinomial(slots, np.full(shards, 1 / shards))
    met = np.flatnonzero(counts)
    return met, counts[met]


def drawer(shards: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeats each source for the shards it meets, with shard, count and k0, its slots in the shards before."""

    def draw(batches):
        for batch in batches:
            numbers, slots = batch.column("source_no").to_pylist(), batch.column("slots").to_pylist()
            held, rows = [], 0
            for i, (number, left) in enumerate(zip(numbers, slots, strict=True)):
                met, counts = draws(left, shards, np.random.default_rng([seed, number]))
                held.append((np.full(len(met), i), met, np.cumsum(counts) - counts, counts))
                rows += len(met)
                if rows >= RANGE or i + 1 == len(numbers):
                    index, *added = (np.concatenate(part).astype(np.int64) for part in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.take(pa.array(index)).columns, *map(pa.array, added)], names=[*batch.schema.names, "shard", "k0", "count"]
                    )
                    held, rows = [], 0

    return draw


@dataclass(frozen=True)
class Mix:
    """``sources``: a row per source; ``rows``: a row per document with its place; ``pieces``: what each slot takes."""

    sources: DataFrame
    rows: DataFrame
    pieces: DataFrame


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with their numbers, ``_row``, written once. A second scan may be split otherwise, as when executors come
    or go, so numbers are never made anew: whoever needs number and text reads both from here."""
    return durable(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-documents")


def placed_rows(docs: DataFrame, key: str, text: str, source: str, row: Column) -> DataFrame:
    """(_row, _id, source, size) of every document."""
    return docs.select(
        row.alias("_row"),
        F.col(f"`{key}`").alias("_id"),
        F.xxhash64(f"`{text}`").alias("_text_hash"),
        F.col(f"`{source}`").cast("string").alias("source"),
        ascii_words(F.col(f"`{text}`")).alias("size"),
    )


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    block: int = BLOCK,
    shards: int | None = None,
    seed: int = SEED,
    row: str | None = None,
) -> Mix:
    """The mix of ``docs``. ``row`` is the column that numbers them, stored with them (:func:`numbered`); without it rows
    are numbered here, and the numbers hold in the tables returned, not in ``docs``.

    pieces: (shard, slot, source_no, pass, block, _row, start, words): ``words`` words of row ``_row`` from word
    ``start`` on fill part of a slot. Defined cases: null and empty texts have no words and are never taken; a null
    source is a source, last in order; equal rows are rows of their own; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    rows = durable(placed_rows(docs, key, text, source, number), "mix-rows")
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = ranked_sources(rows.groupBy("_source").agg(F.sum("size").alias("source_size")))
    sources = durable(with_slots(with_targets(durable(sources, "sources"), weights), block, seed), "source-slots")
    bucket = (F.crc32(F.concat_ws(":", F.col("_id").cast("string"), F.col("_text_hash").cast("string")).cast("binary")) % BUCKETS).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    parts = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("part"))  # at most BUCKETS rows per source
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_source", "_bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("part_first"))
    parts = parts.join(sources.select("_source", "source_no", "source_size", "target"), "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_id", "_text_hash", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("first", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(parts, ["_source", "_bucket"])
        .withColumn("first", F.col("first") + F.col("part_first"))
        .drop("_source", "_bucket", "part_first")
    )
    rows = durable(rows, "mix-places")

    whole = lambda v: ((v - v % block) / block).cast("long")
    spans = rows.where("size > 0").select(
        "source_no", "_row", "first", "size", F.explode(F.sequence(whole(F.col("first")), whole(F.col("first") + F.col("size") - 1))).alias("block")
    )
    start = F.greatest(F.col("block") * block, F.col("first"))
    end = F.least((F.col("block") + 1) * block, F.col("first") + F.col("size"))
    at = start - F.col("block") * block
    spans = spans.select("source_no", "block", "_row", (start - F.col("first")).alias("start"), at.alias("at"), (end - start).alias("words"))

    slots = sources.agg(F.sum("slots")).first()[0] or 0
    shards = shards or max(SHARDS, -(-slots // SHARD_SLOTS))
    plan = sources.where("slots > 0").select("source_no", "source_size", "owed", "short", "full", "blocks", "a", "b", "slots")
    kinds = ", ".join(f"{c} long" for c in plan.columns)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // RANGE))
    plan = plan.select(*[F.col(c).cast("long") for c in plan.columns]).repartition(tasks, "source_no")
    plan = plan.mapInArrow(drawer(shards, seed), f"{kinds}, shard long, k0 long, count long").withColumn("shard", F.col("shard").cast("int"))
    shard = Window.partitionBy("shard")
    within = F.sum("count").over(shard.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))
    plan = plan.withColumns({"within": F.coalesce(within, F.lit(0)), "width": F.sum("count").over(shard)})
    wa, wb = sides(F.col("width"))
    made = (
        plan.withColumns({"wa": wa, "wb": wb})
        .repartition(tasks, "shard", "source_no")  # with a number, so that a table of few bytes and many slots is not coalesced
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        .withColumn("k", F.col("k0") + F.col("i"))
        .withColumn("turn", F.col("k") % F.col("blocks"))
        .withColumn("pass", ((F.col("k") - F.col("turn")) / F.col("blocks")).cast("long"))
        .withColumn("short_at", short_turn(F.col("pass"), seed))
        .withColumn("past", (F.col("turn") > F.col("short_at")).cast("long"))
    )
    is_short = F.col("turn") == F.col("short_at")
    index = permuted(F.col("turn") - F.col("past"), F.col("full"), F.col("a"), F.col("b"), seed, F.col("source_no") * REPEATS + F.col("pass"))
    done = F.col("pass") * F.col("source_size") + F.col("turn") * block - F.col("past") * (block - F.col("short"))
    slot = permuted(F.col("within") + F.col("i"), F.col("width"), F.col("wa"), F.col("wb"), seed + 1, F.col("shard").cast("long"))
    made = made.select(
        "shard",
        slot.alias("slot"),
        "source_no",
        "pass",
        F.when(is_short, F.col("full")).otherwise(index).alias("block"),
        F.least(F.when(is_short, F.col("short")).otherwise(block), F.col("owed") - done).alias("due"),
    )
    # sorted and merged, as the planner takes rows that are exploded for as few as they were, and would broadcast them.
    # ``at``: words of the block before the span; a slot that is cut takes the first ``due`` words of its block
    pieces = spans.join(made.hint("merge"), ["source_no", "block"]).withColumn("words", F.least("words", F.col("due") - F.col("at"))).where("words > 0")
    return Mix(sources, rows, pieces.drop("at", "due"))


def taken_words(found: Mix) -> DataFrame:
    """``rows`` with the number of words the mix takes of each."""
    taken = found.pieces.groupBy("_row").agg(F.sum("words").alias("taken"))
    return found.rows.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The documents as the mix takes them: a row per document and pass, its text the words taken, in order.

    A document taken whole keeps its text as it is; of one taken in part, the words taken, joined by a space. ``length``,
    where there is such a column, is the new text's number of characters. Documents of which nothing is taken go.
    """
    rows = numbered(docs)
    found = mix(rows, key=key, text=text, source=source, row="_row")
    takes = (
        found.pieces.groupBy("_row", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("_parts"), F.sum("words").alias("_taken"))
        .select(F.col("_row").alias("_taken_row"), "_parts", "_taken")
    )
    joined = rows.join(takes, F.col("_row") == F.col("_taken_row"))
    whole = F.col("_taken") == ascii_words(F.col(f"`{text}`"))
    part = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(F.col("_split"), p["start"].cast("int") + 1, p["words"].cast("int")))), " ")
    split = F.when(whole, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0)))
    out = joined.withColumn("_split", split).withColumn(text, F.when(whole, F.col(f"`{text}`")).otherwise(part))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.length(f"`{text}`").cast(kind))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taken_words(mix(read(spark, sf_dir, "documents")))
    return found.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")
