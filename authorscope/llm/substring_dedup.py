"""Removal of repeated passages, with a count-min sketch as a filter before exact grouping.

A window is 20 words in a row. Its anchor is the smallest of the ten-word hashes inside it; equal windows have equal
anchors, so an anchor occurs at least as often as its window. Every task counts the anchors of its texts in a sketch of
two rows; the sketches are merged to bitmaps of the cells that were met twice or more. A second pass keeps the windows
whose anchor is marked in both rows: every repeated window is among them. These are grouped exactly by a 128-bit hash
of their words, and all but the first of a group mark their words.

A task sends only its own first occurrence of a window to the exchange, as its later ones are repeats whatever other
tasks hold; so a passage that a third of all documents share has a row for each task at most. Texts of the same words
are reduced to the first before. The bitmaps have a fixed greatest size (``MAX_CELLS`` bits a row); beyond what they
can tell apart, more windows are grouped, none is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, read, without
from .hashing import BASES, WHITE, U, Words, spans_hash, text_chunks, windows

WINDOW = 20
ANCHOR = 10
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 30
SEGMENTS = 32
FAN_IN = 64
#: Suspect windows a task holds before it reduces and sends them.
HELD = 1 << 20
#: Keys broadcast below this count, else joined by a shuffle.
BROADCAST_ROWS = 500_000
KEY = ("_id", "_text_hash")
OWN = ("n_words", "n_removed", "kept_sha256")


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ten-word hashes, those that are some window's anchor, the anchor of each window, each window's first word)."""
    hashes = words.hashes()
    starts = windows(hashes, words.first, WINDOW)[1]
    if not len(starts):
        none = np.zeros(0, U)
        return none, np.zeros(0, bool), none, starts
    grams = np.full(len(hashes), np.iinfo(U).max, U)
    at = np.arange(len(hashes) - ANCHOR + 1)
    grams[: len(at)] = spans_hash(hashes, at, at + ANCHOR, BASES[1])
    least = grams[starts]
    for step in range(1, WINDOW - ANCHOR + 1):
        least = np.minimum(least, grams[starts + step])
    used = np.zeros(len(hashes), bool)
    for step in range(WINDOW - ANCHOR + 1):
        used[starts[grams[starts + step] == least] + step] = True
    return grams, used, least, starts


def cells_of(anchor: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in both rows of the sketch."""
    return [(anchor & U(cells - 1)).astype(np.int64), ((anchor >> U(32)) & U(cells - 1)).astype(np.int64)]


SKETCH = "part long, row int, segment int, once binary, twice binary"


def packed(cells: np.ndarray) -> bytes:
    return zlib.compress(np.diff(cells, prepend=0).astype(np.uint32).tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(body), np.uint32).astype(np.int64))


def sketch_rows(part: int, counted: list[list[np.ndarray]], cells: int) -> pa.RecordBatch:
    width, out = cells // SEGMENTS, []
    for row, pieces in enumerate(counted):
        found, counts = np.unique(np.concatenate(pieces or [np.zeros(0, np.int64)]), return_counts=True)
        edges = np.searchsorted(found, np.arange(SEGMENTS + 1) * width)
        for segment in range(SEGMENTS):
            own = found[edges[segment] : edges[segment + 1]] - segment * width
            if len(own):
                again = own[counts[edges[segment] : edges[segment + 1]] > 1]
                out.append((part, row, segment, packed(own), packed(again)))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "row", "segment", "once", "twice"])


def counter(cells: int) -> Callable:
    """Counts the anchors of a task's texts, the third column of its batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counted, held = TaskContext.get().partitionId(), [[], []], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(2)):
                grams, used, _, _ = anchors(Words(data, offsets, WHITE, fold=False))
                for row, found in enumerate(cells_of(grams[used], cells)):
                    counted[row].append(found)
                held += int(used.sum())
                if held > 4 * HELD:  # a further sketch of the same task: merging adds them up
                    yield sketch_rows(part, counted, cells)
                    counted, held = [[], []], 0
        yield sketch_rows(part, counted, cells)

    return count


def merger(cells: int) -> Callable:
    """Merges the sketches of one row and segment: met once or more, met twice or more."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        once, twice = (np.zeros(cells // SEGMENTS, bool) for _ in range(2))
        for a, b in zip(table["once"], table["twice"], strict=True):
            a, b = unpacked(a.as_py()), unpacked(b.as_py())
            twice[a[once[a]]] = True
            twice[b] = True
            once[a] = True
        part, row, segment = (k.as_py() for k in key)
        merged = {"part": [part], "row": [row], "segment": [segment], "once": [packed(np.flatnonzero(once))], "twice": [packed(np.flatnonzero(twice))]}
        return pa.table(merged, schema=pa.schema([("part", pa.int64()), ("row", pa.int32()), ("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return merge


def repeated_cells(docs: DataFrame, cells: int) -> list[np.ndarray]:
    """A bitmap per sketch row of the cells that all texts together met twice or more."""
    found = durable(docs.mapInArrow(counter(cells), SKETCH), "sketch")
    parts = int(found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        nested = found.withColumn("part", F.floor(F.col("part") / FAN_IN))
        found = durable(nested.groupBy("part", "row", "segment").applyInArrow(merger(cells), SKETCH), "sketch")
        if parts == 1:
            break
    bitmaps = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    width = cells // SEGMENTS
    for r in found.select("row", "segment", "twice").toLocalIterator():
        marks = np.zeros(width, bool)
        marks[unpacked(r["twice"])] = True
        bitmaps[r["row"]][r["segment"] * width // 8 : (r["segment"] + 1) * width // 8] = np.packbits(marks, bitorder="little")
    return bitmaps


def marked(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def suspects(bitmaps, cells: int, id_type: pa.DataType) -> Callable:
    """Rows of windows estimated repeated: (h1, h2, _id, _text_hash, at, sure). Of windows met again in the same task
    only the first goes on to be grouped; the later ones are ``sure``."""

    def reduced(held: list[tuple]) -> pa.RecordBatch:
        h1, h2, text, at = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
        ids = pa.chunked_array([h[4] for h in held]).combine_chunks().cast(id_type)
        text_ids = pa.chunked_array([h[5] for h in held]).combine_chunks()
        # ranks follow the order of documents: by id, nulls first, then by the hash of the text
        order = pc.sort_indices(pa.table({"i": ids, "t": text_ids}), sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start")
        rank = np.empty(len(ids), np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        by = np.lexsort((at, rank[text], h2, h1))
        again = (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])
        sure = np.zeros(len(h1), bool)
        sure[by[1:][again]] = True
        # in the order of the texts, where ids repeat, and without hashes where none is needed: this is written
        take = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(h1.view(np.int64), mask=sure),
                pa.array(h2.view(np.int64), mask=sure),
                ids.take(take),
                text_ids.take(take),
                pa.array(at.astype(np.int32)),
                pa.array(sure),
            ],
            names=["h1", "h2", *KEY, "at", "sure"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, texts = [], 0, 0
        rows = bitmaps.value
        for batch in batches:
            for row, stop, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets, WHITE, fold=False)
                _, _, least, starts = anchors(words)
                first, second = cells_of(least, cells)
                keep = marked(rows[0], first)
                keep[keep] = marked(rows[1], second[keep])
                starts = starts[keep]
                text = np.searchsorted(words.first, starts, "right") - 1
                h1, h2 = (spans_hash(words.hashes(which), starts, starts + WINDOW, BASES[which]) for which in (0, 1))
                held.append((h1, h2, text + texts, starts - words.first[text], batch.column(0)[row:stop], batch.column(1)[row:stop]))
                texts += stop - row
                count += len(starts)
                if count > HELD:
                    yield reduced(held)
                    held, count, texts = [], 0, 0
        if held:
            yield reduced(held)

    return find


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, at, copy): the numbers of words and of removed ones, and the kept words."""
    for batch in batches:
        for row, stop, data, offsets in text_chunks(batch.column(0)):
            words = Words(data, offsets, WHITE, fold=False)
            begins, copies = batch.column(1)[row:stop].to_pylist(), batch.column(2)[row:stop].to_pylist()
            removed, kept, body = [], [], data.tobytes()
            for i, (at, copy) in enumerate(zip(begins, copies, strict=True)):
                n = int(words.counts[i])
                covered = np.zeros(n + 1, np.int64)
                if copy:
                    covered[0] = 1
                elif at:
                    at = np.unique(np.array(at))
                    covered[at] += 1
                    np.subtract.at(covered, np.minimum(at + WINDOW, n), 1)
                open_ = np.cumsum(covered)[:n] <= 0
                own = np.flatnonzero(open_) + words.first[i]
                removed.append(n - len(own))
                kept.append(b" ".join([body[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]).decode())
            rest = [c[row:stop] for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=[*batch.schema.names[3:], "n_words", "n_removed", "kept"],
            )


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _text_hash, n, s1, s2): number of words and a hash of the word sequence."""
    for batch in batches:
        for row, stop, data, offsets in text_chunks(batch.column(2)):
            words = Words(data, offsets, WHITE, fold=False)
            hashes = words.hashes()
            s1, s2 = (spans_hash(hashes, words.first[:-1], words.first[1:], b).view(np.int64) for b in BASES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[row:stop], batch.column(1)[row:stop], pa.array(words.counts, pa.int64()), pa.array(s1), pa.array(s2)],
                names=[*KEY, "n", "s1", "s2"],
            )


def maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed, kept (the words left, joined by a space) and kept_sha256.

    Defined cases: a null text has no words; fewer than 20 words are never removed; null keys come before all others;
    rows equal in key and text are one document, all with the same result; rows of one key with different texts are
    ordered by a hash of the text; an empty table gives an empty table; columns named like one added are replaced.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(f"`{text}`").alias("_text_hash"), F.col(f"`{text}`").alias("_text"))
    kind = keyed.schema["_id"].dataType.simpleString()
    texts = durable(keyed.mapInArrow(whole_texts, f"_id {kind}, _text_hash bigint, n bigint, s1 bigint, s2 bigint"), "texts")
    long_ = texts.where(F.col("n") >= WINDOW)
    heads = long_.groupBy("s1", "s2", "n").agg(F.min(F.struct(*KEY)).alias("head"))
    is_head = F.col("_id").eqNullSafe(F.col("head._id")) & (F.col("_text_hash") == F.col("head._text_hash"))
    copies = long_.join(heads, ["s1", "s2", "n"]).where(~is_head).select(F.col("_id").alias("_copy_id"), F.col("_text_hash").alias("_copy_hash")).distinct()
    copies = durable(copies, "copies")
    copy = F.col("_id").eqNullSafe(F.col("_copy_id")) & (F.col("_text_hash") == F.col("_copy_hash"))
    distinct = keyed.join(maybe_broadcast(copies), copy, "left_anti")
    # of rows equal in key and text one goes on; only these texts are shuffled
    doubles = long_.groupBy(*KEY).agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("_id").alias("_double_id"), F.col("_text_hash").alias("_double_hash"))
    doubles = durable(doubles, "doubles")
    if not doubles.isEmpty():
        doubles = maybe_broadcast(doubles)
        double = F.col("_id").eqNullSafe(F.col("_double_id")) & (F.col("_text_hash") == F.col("_double_hash"))
        once = distinct.join(doubles, double, "left_semi").groupBy(*KEY).agg(F.min("_text").alias("_text"))
        distinct = distinct.join(doubles, double, "left_anti").unionByName(once)
    if cells is None:
        total = int(long_.agg(F.sum(F.col("n") - WINDOW + 1)).first()[0] or 0)
        cells = min(max(1 << max(total // 2, 1).bit_length(), MIN_CELLS), MAX_CELLS)
    bitmaps = spark.sparkContext.broadcast(repeated_cells(distinct, cells))
    id_type = to_arrow_type(keyed.schema["_id"].dataType)
    found = distinct.mapInArrow(suspects(bitmaps, cells, id_type), f"h1 bigint, h2 bigint, _id {kind}, _text_hash bigint, at int, sure boolean")
    found = durable(found, "suspects")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*KEY, "at"))
    repeats = found.where(~F.col("sure")).withColumn("place", place).where("place > 1").select(*KEY, "at")
    repeats = repeats.unionByName(found.where("sure").select(*KEY, "at"))
    begins = repeats.groupBy(*KEY).agg(F.collect_list("at").alias("_at")).withColumnsRenamed({"_id": "_at_id", "_text_hash": "_at_hash"})

    rows = without(docs, *OWN, "kept").withColumn("_text_hash", F.xxhash64(f"`{text}`"))
    columns = [c for c in rows.columns if c != "_text_hash"]
    marks = (
        copies.select(F.col("_copy_id").alias("_at_id"), F.col("_copy_hash").alias("_at_hash"), F.lit(None).cast("array<int>").alias("_at"), F.lit(True).alias("_copy"))
        .unionByName(begins.withColumn("_copy", F.lit(False)))
    )
    joined = rows.join(marks, F.col(f"`{key}`").eqNullSafe(F.col("_at_id")) & (F.col("_text_hash") == F.col("_at_hash")), "left")
    joined = joined.select(F.col(f"`{text}`").alias("_text"), "_at", F.coalesce("_copy", F.lit(False)).alias("_copy"), *[f"`{c}`" for c in columns])
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text_hash"], "n_words bigint, n_removed bigint, kept string"])
    return joined.mapInArrow(cut, fields).withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", *OWN)


#: The contract by definition: each window, its first occurrence, and the words that later ones cover.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
     x AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g
           FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
     m AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
     c AS (SELECT DISTINCT rid, i + o AS i FROM (SELECT rid, i, unnest(range(0, 20)) AS o FROM m)),
     r AS (SELECT rid, count(*) AS n FROM c GROUP BY rid),
     k AS (SELECT u.rid, string_agg(t, ' ' ORDER BY u.i) AS kept
           FROM (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d) u LEFT JOIN c ON u.rid = c.rid AND u.i = c.i
           WHERE c.i IS NULL GROUP BY u.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)
"""
