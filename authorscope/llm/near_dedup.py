"""Near-duplicate documents by order MinHash.

A word is a run of letters, digits and non-ASCII characters, lower-cased in A-Z; a shingle is five words in a row (all
words of a shorter text). Every shingle carries its occurrence number in its text, so repeats count. A sketch takes the
``MINIMA`` smallest labelled shingles under one hash and keeps them in text order; two texts agree in a sketch only if
they share those shingles in the same order, which follows edit similarity. ``TABLES`` such sketches are drawn: at
similarity 0.8 a pair agrees in at least one with probability above 0.9999.

Candidates are verified by alignment: the longest common subsequence L of the two shingle sequences, in a band as wide
as the threshold leaves room for, and L / (n + m - L) >= 0.8. This is the Jaccard similarity of five-word shingles, of
which only those that keep their order count.

Texts with the same words are one node from the start. In each bucket of a sketch all nodes are first compared with one
head. Buckets that still hold several groups are then gone through in blocks of ``BLOCK`` nodes, a task for each two
blocks: it counts the shingles that its nodes share, and aligns those pairs of different groups that share enough. No
table of pairs is made; a task returns the links that join groups.

A large bucket is as a rule many variants of one text, and variants that are near to each other are near to that text.
So merged count-min sketches first tell of the nodes of large buckets how many of their labelled shingles occur in some
other such node. The head is the node that has the largest share of them, the middle of the variants, and links all
that are near it. A node with so few of them that no text of its bucket can be near it takes no part in the blocks:
the sketches only overestimate, so no link is lost. What has to be compared in blocks is the rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, without
from .components import components
from .hashing import BASES, PUNCTUATION, U, Words, mix, spans_hash, text_chunks
from .substring_dedup import FAN_IN, HELD, SEGMENTS, SKETCH, cells_of, marked, merger, sketch_rows, unpacked

SHINGLE = 5
MINIMA = 3
TABLES = 16
#: Occurrences from which a symbol of an alignment is held as bits, and columns after which the band moves on.
OFTEN, SHIFT = 64, 64
#: Cells of a count-min row for each labelled shingle that is counted, and their bounds.
CELLS_EACH, MIN_CELLS, MAX_CELLS = 4, 1 << 16, 1 << 30
#: Keys of 24 bytes broadcast below this many rows, else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 128
LAST = np.iinfo(U).max
KEY = ("_id", "_text_hash")


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and where each text's begin."""
    counts = np.where(words.counts >= SHINGLE, words.counts - SHINGLE + 1, (words.counts > 0).astype(int))
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(words.first[:-1] - first[:-1], counts) + np.arange(first[-1])
    ends = np.minimum(starts + SHINGLE, np.repeat(words.first[1:], counts))
    return spans_hash(words.hashes(), starts, ends, BASES[0]), first


def labelled(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingle hashes, each mixed with how often it occurred before in its text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    sorted_hash, sorted_text = hashes[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_text[1:] != sorted_text[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    occurrence = np.empty(len(order), U)
    occurrence[order] = (np.arange(len(order)) - begin).astype(U)
    return mix(hashes + occurrence * U(BASES[1]))


def sketches(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """TABLES sketches of each text that has shingles, zero rows for the others."""
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), TABLES), U)
    if not len(full):
        return out
    starts, sizes = first[:-1][full], counts[full]
    owner = np.repeat(np.arange(len(full)), sizes)
    for table in range(TABLES):
        keys = mix(labels ^ mix(np.full(1, table + 1, U)))
        places = np.full((len(full), MINIMA), -1)
        for turn in range(MINIMA):
            least = np.minimum.reduceat(keys, starts)
            at = np.flatnonzero((keys == least[owner]) & (keys != LAST))
            places[owner[at], turn] = at
            keys[at] = LAST
        places.sort(axis=1)
        sketch = np.full(len(full), table, U)
        for turn in range(MINIMA):
            sketch = mix(sketch + np.where(places[:, turn] >= 0, labels[places[:, turn]], U(0)))
        out[full, table] = sketch
    return out


SKETCHED = "_id {id}, _text_hash bigint, row bigint, node string, shingles bigint, sketches array<bigint>"


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row`` tells rows equal in key and text apart; it holds as long as this is read from where it was written."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for row, stop, data, offsets in text_chunks(batch.column(2)):
            words = Words(data, offsets, PUNCTUATION, fold=True)
            hashes = words.hashes()
            whole = [spans_hash(hashes, words.first[:-1], words.first[1:], base) for base in BASES]
            node = [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(*[w.tolist() for w in whole], words.counts, strict=True)]
            found, first = shingles(words)
            table = sketches(labelled(found, first), first).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (stop - row + 1) * TABLES, TABLES), pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:stop], batch.column(1)[row:stop], pa.array(np.arange(number, number + stop - row)),
                    pa.array(node, pa.string()), pa.array(np.diff(first), pa.int64()), lists,
                ],
                names=[*KEY, "row", "node", "shingles", "sketches"],
            )
            number += stop - row


def common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence along paths at most ``band`` off the diagonal.

    Bits of an integer are the cells of a column of the alignment, and only those in the band are held: cells below it
    no longer change and are counted as they leave, cells above it are as they began. So a text costs its length times
    the differences allowed, and memory of its length.
    """
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differs[0]) if len(differs) else short
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    wanted, places = set(b), {}
    for i, symbol in enumerate(a):
        if symbol in wanted:
            places.setdefault(symbol, []).append(i)
    # symbols that occur often, and so are few, as bits of all their places; the others by their places
    often = {symbol: bits_of(at, len(a)) for symbol, at in places.items() if len(at) > max(OFTEN, len(a) // 1024)}
    low = high = row = common = 0
    for j, symbol in enumerate(b):
        if j % SHIFT == 0:
            top = min(len(a), j + SHIFT + band)
            row |= ((1 << max(top - high, 0)) - 1) << (high - low)
            high = max(high, top)
            drop = min(max(j - band, 0), len(a)) - low
            if drop > 0:
                common += drop - (row & ((1 << drop) - 1)).bit_count()
                row >>= drop
                low += drop
        at = places.get(symbol)
        if at is None:
            continue
        first, last = max(j - band, 0), j + band
        if symbol in often:
            match = ((often[symbol] >> first) & ((1 << (last - first + 1)) - 1)) << (first - low)
        else:
            match = 0
            for i in at if len(at) < 4 else at[bisect_left(at, first) : bisect_right(at, last)]:
                if first <= i <= last:
                    match |= 1 << (i - low)
        hit = row & match
        if hit:
            row = ((row + hit) | (row - hit)) & ((1 << (high - low)) - 1)
    return head + tail + common + (high - low) - row.bit_count()


def bits_of(places: list[int], size: int) -> int:
    marks = np.zeros(size, bool)
    marks[places] = True
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether ordered shingle similarity is 0.8 or more: 9 L >= 4 (n + m), in integers."""
    total = len(a) + len(b)
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * common_in_order(a, b, total // 9) >= 4 * total


def aligned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text_a, text_b), the pairs that alignment confirms."""
    for batch in batches:
        sides = [shingle_lists(batch.column(i)) for i in (2, 3)]
        keep = [similar(x, y) for x, y in zip(*sides, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def shingle_lists(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(column):
        found, first = shingles(Words(data, offsets, PUNCTUATION, fold=True))
        for i in range(len(first) - 1):
            yield found[first[i] : first[i + 1]]


def shared_counts(labels: list[np.ndarray]) -> np.ndarray:
    """Number of labelled shingles that each two texts share."""
    text = np.repeat(np.arange(len(labels)), [len(x) for x in labels])
    every = np.concatenate(labels)
    order = np.argsort(every, kind="stable")
    every, text = every[order], text[order]
    edges = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
    found = np.zeros((len(labels), len(labels)), np.int32)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            rows = text[a:b]
            found[rows[:, None], rows] += 1
    return found


def linked_in_bucket(texts: list[np.ndarray], labels: list[np.ndarray], group: np.ndarray, part: np.ndarray, earlier: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """Links that join the groups of a bucket's nodes. ``earlier`` are the sketches of tables before this one: pairs
    that agree there were compared there. ``across``: only nodes of different parts are compared."""
    sizes = np.array([len(x) for x in labels])
    shared = shared_counts(labels)
    a, b = np.nonzero(np.triu(9 * shared >= 4 * (sizes[:, None] + sizes[None]), 1))
    want = group[a] != group[b]
    if across:
        want &= part[a] != part[b]
    a, b = a[want], b[want]
    fresh = ~(earlier[a] == earlier[b]).any(axis=1)
    root, links = {g: g for g in group.tolist()}, []

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    for i, j in zip(a[fresh].tolist(), b[fresh].tolist(), strict=True):
        x, y = top(int(group[i])), top(int(group[j]))
        if x != y and similar(texts[i], texts[j]):
            root[x] = y
            links.append((i, j))
    return links


LINK = pa.schema([("a", pa.string()), ("b", pa.string())])


def compared_blocks(table: pa.Table) -> pa.Table:
    """Of the nodes of some whole buckets, or of two blocks of one: links between groups."""
    table = table.sort_by([("table", "ascending"), ("sketch", "ascending")]).combine_chunks()
    found, labels = [], []
    for _, _, data, offsets in text_chunks(table["_text"]):
        some, first = shingles(Words(data, offsets, PUNCTUATION, fold=True))
        marks = labelled(some, first)
        found += [some[first[i] : first[i + 1]] for i in range(len(first) - 1)]
        labels += [marks[first[i] : first[i + 1]] for i in range(len(first) - 1)]
    number, sketch = (table[c].to_numpy() for c in ("table", "sketch"))
    part = np.unique(np.array(table["part"].to_pylist()), return_inverse=True)[1]
    across = table["low"][0].as_py() != table["high"][0].as_py()
    group = np.unique(np.array(table["component"].to_pylist()), return_inverse=True)[1]
    drawn = table["sketches"].combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
    edges = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (sketch[1:] != sketch[:-1]), [True]]))
    left, right = [], []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        links = linked_in_bucket(found[x:y], labels[x:y], group[x:y], part[x:y], drawn[x:y, : number[x]], across)
        left += [x + i for i, _ in links]
        right += [x + j for _, j in links]
    nodes = table["node"].combine_chunks()
    return pa.Table.from_arrays([nodes.take(pa.array(side, pa.int64())) for side in (left, right)], schema=LINK)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(f"`{text}`").alias("_text_hash"), F.col(f"`{text}`").alias("_text"))


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, _text) of the nodes in ``wanted``, read again from ``docs``."""
    asked = durable(nodes.join(wanted.select("node").distinct(), "node").select("node", "one.*"), "asked")
    same = docs["_id"].eqNullSafe(asked["_id"]) & (docs["_text_hash"] == asked["_text_hash"])
    return durable(docs.join(maybe_broadcast(asked), same).select("node", "_text").dropDuplicates(["node"]), "texts")


def labels_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labelled shingles of some texts, and where each text's begin."""
    for _, _, data, offsets in text_chunks(column):
        found, first = shingles(Words(data, offsets, PUNCTUATION, fold=True))
        yield labelled(found, first), first


def label_counter(cells: int) -> Callable:
    """Count-min sketches of the labelled shingles of a task's nodes (node, _text). A node has each label once, so cells
    that are met twice hold what two nodes share, and labels that happen to fall together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counted, held = TaskContext.get().partitionId(), [[], []], 0
        for batch in batches:
            for labels, _ in labels_of(batch.column(1)):
                for row, found in enumerate(cells_of(labels, cells)):
                    counted[row].append(found)
                held += len(labels)
                if held > 4 * HELD:
                    yield sketch_rows(part, counted, cells)
                    counted, held = [[], []], 0
        yield sketch_rows(part, counted, cells)

    return count


def shared_cells(texts: DataFrame, cells: int) -> list[np.ndarray]:
    """A bitmap per sketch row of the cells that all texts together met twice or more."""
    found = durable(texts.mapInArrow(label_counter(cells), SKETCH), "label-sketch")
    parts = int(found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        nested = found.withColumn("part", F.floor(F.col("part") / FAN_IN))
        found = durable(nested.groupBy("part", "row", "segment").applyInArrow(merger(cells), SKETCH), "label-sketch")
        if parts == 1:
            break
    marks = [np.zeros(cells, bool) for _ in range(2)]
    width = cells // SEGMENTS
    for r in found.select("row", "segment", "twice").toLocalIterator():  # bits of 2 * MAX_CELLS at most
        marks[r["row"]][r["segment"] * width + unpacked(r["twice"])] = True
    return [np.packbits(m, bitorder="little") for m in marks]


def shared_shares(bitmaps: Broadcast, cells: int) -> Callable:
    """(node, common): how many of a node's labelled shingles may occur in another node."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for labels, first in labels_of(batch.column(1)):
                places = cells_of(labels, cells)
                met = marked(bitmaps.value[0], places[0]) & marked(bitmaps.value[1], places[1])
                total = np.concatenate([[0], np.cumsum(met)])
                common.append(total[first[1:]] - total[first[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(common or [[]]).astype(np.int64))], names=["node", "common"])

    return measure


def with_middles(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``members`` (table, sketch, node, shingles, head, size) with the middle of each large bucket as its head, and
    whether a node is ``lone``: near to no other of its bucket, as it shares too little with all of them together."""
    large = members.where(F.col("size") > BLOCK)
    hot = durable(large.select("node", "shingles").distinct(), "hot-nodes")
    total = hot.agg(F.sum("shingles")).first()[0]
    if not total:
        return members.withColumn("lone", F.lit(False))
    cells = min(max(1 << (int(total) * CELLS_EACH - 1).bit_length(), MIN_CELLS), MAX_CELLS)
    asked = durable(texts.join(hot.select("node"), "node", "left_semi"), "hot-texts")
    bitmaps = members.sparkSession.sparkContext.broadcast(shared_cells(asked, cells))
    shares = durable(asked.mapInArrow(shared_shares(bitmaps, cells), "node string, common bigint"), "shares")
    scored = durable(large.join(shares, "node"), "scored")
    share = F.col("common") / F.col("shingles")
    bucket = ["table", "sketch"]
    middles = scored.groupBy(*bucket).agg(F.min(F.struct((-share).alias("far"), "node", "shingles")).alias("middle"), F.min("shingles").alias("least"))
    # a text near to one of n shingles has 4 n / 5 of them or more, and no text of the bucket has fewer than the least
    other = F.greatest(F.expr("(4 * shingles + 4) div 5"), F.col("least"))
    placed = scored.join(maybe_broadcast(durable(middles, "middles")), bucket).select(
        *bucket, "node", "shingles", F.struct("middle.node", "middle.shingles").alias("head"), "size",
        (9 * F.col("common") < 4 * (F.col("shingles") + other)).alias("lone"),
    )
    return members.where(F.col("size") <= BLOCK).withColumn("lone", F.lit(False)).unionByName(placed)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that alignment confirms."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b")), "b"
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(aligned_batches, "a string, b string")


def links_in_blocks(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the groups of buckets that hold several, from (table, sketch, node, component)."""
    bucket = ["table", "sketch"]
    mixed = (
        placed.groupBy(*bucket)
        .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"))
        .where("least != most")
        .select(*bucket, "size")
    )
    rows = durable(placed.join(mixed, bucket), "mixed")
    # a group with more nodes than a block has blocks of its own, which need not meet each other; the rest is pooled
    large = rows.groupBy(*bucket, "component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = durable(large.withColumn("own_parts", F.ceil(F.col("n") / BLOCK).cast("int")), "large-groups")
    listed = large.groupBy(*bucket).agg(F.collect_list(F.struct("component", "own_parts")).alias("big"), F.sum("n").alias("big_n"))
    rows = rows.join(listed, bucket, "left").join(large.select(*bucket, "component", "own_parts"), [*bucket, "component"], "left")
    pool_parts = F.ceil((F.col("size") - F.coalesce("big_n", F.lit(0))) / BLOCK).cast("int")
    numbered = lambda owner, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(owner, F.lit(":"), i.cast("string")))
    none = F.array().cast("array<string>")
    pool = F.when(pool_parts > 0, numbered(F.lit(""), pool_parts)).otherwise(none)
    of_large = F.flatten(F.transform("big", lambda g: numbered(g["component"], g["own_parts"])))
    owner = F.when(F.col("own_parts").isNotNull(), F.col("component")).otherwise(F.lit(""))
    turn = F.pmod(F.xxhash64("node"), F.coalesce("own_parts", pool_parts)).cast("string")
    rows = rows.withColumns({"blocks": F.concat(pool, F.coalesce(of_large, none)), "owner": owner, "part": F.concat(owner, F.lit(":"), turn)})
    batches = F.lit(max(1, rows.where(F.size("blocks") == 1).count() // (2 * BLOCK)))
    met = F.filter("blocks", lambda x: (F.col("owner") == "") | ~x.startswith(F.concat(F.col("owner"), F.lit(":"))))
    rows = rows.withColumn("parts", F.size("blocks")).withColumn("other", F.explode(met))
    bucket_hash = F.xxhash64(*bucket)
    rows = rows.withColumns(
        {
            "low": F.least("part", "other"),
            "high": F.greatest("part", "other"),
            # small buckets go through a task by the hundred, a block pair of a large one alone
            "batch": F.when(F.col("parts") == 1, F.pmod(bucket_hash, batches)).otherwise(bucket_hash),
        }
    )
    joined = rows.join(nodes.select("node", "sketches"), "node").join(texts, "node")
    columns = ["table", "sketch", "node", "component", "part", "low", "high", "sketches", "_text"]
    return joined.groupBy("batch", "parts", "low", "high").applyInArrow(lambda t: compared_blocks(t.select(columns)), "a string, b string")


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text_hash, node, class, stays) of each row: the class is the smallest key of the group, and exactly one row
    of it stays.

    Defined cases: texts without words (null, empty) are classes of their own and stay; rows with the same words are
    one class; null keys count as larger than all others.
    """
    docs = keyed(docs, key, text)
    kind = docs.schema["_id"].dataType.simpleString()
    rows = durable(docs.mapInArrow(sketch_batches, SKETCHED.format(id=kind)), "sketches")
    worded = rows.where("node IS NOT NULL")
    nodes = durable(
        worded.groupBy("node").agg(F.min(F.struct(*KEY)).alias("one"), F.any_value("shingles").alias("shingles"), F.any_value("sketches").alias("sketches")),
        "nodes",
    )
    members = nodes.select("node", "shingles", F.posexplode("sketches").alias("table", "sketch"))
    heads = members.groupBy("table", "sketch").agg(F.min(F.struct("node", "shingles")).alias("head"), F.count("*").alias("size"))
    members = durable(members.join(heads.where("size > 1"), ["table", "sketch"]), "members")
    texts = texts_of(members, nodes, docs)
    members = durable(with_middles(members, nodes, texts), "headed")
    near_length = lambda x, y: (5 * F.least(x, y) >= 4 * F.greatest(x, y))
    star = (
        members.where(~F.col("lone") & (F.col("node") != F.col("head.node")) & near_length(F.col("shingles"), F.col("head.shingles")))
        .select(F.col("head.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    star = durable(star, "candidates")
    links = durable(verified(star, texts), "links")
    groups = components(links)
    placed = members.where(~F.col("lone")).join(groups, "node", "left").select("table", "sketch", "node", F.coalesce("component", "node").alias("component"))
    more = durable(links_in_blocks(durable(placed, "placed"), nodes, texts), "links")
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    named = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = (
        named.where("node IS NOT NULL")
        .groupBy("component")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), *KEY, "row")).alias("first"))
    )
    of_group = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("first._id"))
    stays = F.col("node").isNull() | (F.col("row") == F.col("first.row"))
    return named.join(first, "component", "left").select(*KEY, "node", of_group.alias("class"), stays.alias("stays"))


def without_near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest key; columns unchanged."""
    found = durable(near_classes(docs, key=key, text=text), "classes")
    # rows equal in key and text share a fate here: they go if none of them stays
    fates = found.groupBy(*KEY).agg(F.max("stays").alias("stays"))
    gone = fates.where(~F.col("stays")).select(*[F.col(k).alias(f"_gone{k}") for k in KEY])
    rows = docs.withColumn("_text_hash", F.xxhash64(f"`{text}`"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_text_hash"))
    rows = rows.join(maybe_broadcast(durable(gone, "gone")), same, "left_anti")
    # and one of them stays
    again = found.where("node IS NOT NULL").groupBy(*KEY).count().where("count > 1")
    if again.limit(1).count():
        place = F.row_number().over(Window.partitionBy(F.col(f"`{key}`"), "_text_hash").orderBy(F.lit(0)))
        worded = F.length(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", "")) > 0
        rows = rows.withColumn("_copy", place).where((F.col("_copy") == 1) | ~worded).drop("_copy")
    return rows.drop("_text_hash")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = near_classes(docs)
    return found.select(F.col("_id").alias("doc_id"), F.col("class").alias("class_id"), F.col("stays").alias("kept"))
