"""Token ids packed into rows of fixed length, best fit decreasing.

Texts become token ids with an end mark after each. A document longer than a row is cut into full rows and a rest, so
nothing is lost. The pieces at hand are placed by decreasing length, each into the open row with the least room that
suffices; a segment tree over the possible rooms, holding how many rows have each, finds it in a logarithm of steps.

Packing needs no exchange: a task packs the texts of its own split, ``HELD`` tokens at a time, so memory is bounded and
a lost task repeats only itself. A row of the result is one packed row: its ids as little-endian unsigned integers (the
rows of a shard are an id matrix), the cumulative lengths of its segments, and where in its document each segment
starts, from which positions are reset.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read

#: Where the vocabulary is, a file of byte pairs and ranks; read by the driver and sent to the tasks (under 2 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this public vocabulary splits texts before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space as the pattern sees it, long enough to be cut out.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
ROW = 2048
#: Tokens a task packs together.
HELD = 1 << 22
#: Rows of ids in one Arrow batch.
BATCH = 256


class RoomTree:
    """How many open rows have each amount of room, as a segment tree: finds the least room of at least ``size``."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += change
            node >>= 1

    def least(self, size: int) -> int | None:
        node = size + self.leaves
        if self.counts[node]:
            return size
        while node > 1:
            # a left child's sibling holds the next larger rooms
            if not node & 1 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not self.counts[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Which pieces go into each row. Sizes are 1 to ``row``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rows: list[list[int]] = []
    tree, open_rows = RoomTree(row), {}
    for i in order:
        size = sizes[i]
        room = tree.least(size)
        if room is None:
            number = len(rows)
            rows.append([i])
            room = row
        else:
            number = open_rows[room].pop()
            tree.add(room, -1)
            rows[number].append(i)
        left = room - size
        if left:
            open_rows.setdefault(left, []).append(number)
            tree.add(left, 1)
    return rows


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text. The pattern takes a run of white space whole, but for its last character where text follows, and
    gives one character back at a time to find that; on long runs its engine gives up. They are cut out before it."""
    import tiktoken

    encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    plain = lambda text: np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)
    if pattern != PATTERN:
        return plain

    def encode(text: str) -> np.ndarray:
        found, past = [], 0
        for run in LONG_SPACE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            found += [plain(text[past : run.start()]), np.asarray(encoding._encode_single_piece(text[run.start() : stop]), np.uint32)]
            past = stop
        return np.concatenate([*found, plain(text[past:])]) if found else plain(text)

    return encode


def decoded(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of ids, without the end mark."""
    table = {rank: token for token, rank in read_ranks(vocabulary).items()}
    return b"".join(table[i] for i in ids if i in table).decode()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def packer(ranks, pattern: str, row: int, held: int, end: int, width: str, id_type: pa.DataType) -> Callable:
    """Packs (key, text) batches."""

    def packed(pieces: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(p[2]) for p in pieces], row)
        for start in range(0, len(rows), BATCH):
            some = [[pieces[i] for i in members] for members in rows[start : start + BATCH]]
            ids = []
            for segments in some:
                line = np.full(row, end, width)
                tokens = np.concatenate([s[2] for s in segments])
                line[: len(tokens)] = tokens
                ids.append(line.tobytes())
            lengths = [np.concatenate([[0], np.cumsum([len(s[2]) for s in segments])]).tolist() for segments in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + start + i for i in range(len(some))], pa.int64()),
                    pa.array([x[-1] for x in lengths], pa.int32()),
                    pa.array(ids, pa.binary()),
                    pa.array(lengths, pa.list_(pa.int32())),
                    pa.array([[s[1] for s in segments] for segments in some], pa.list_(pa.int64())),
                    pa.array([[s[0] for s in segments] for segments in some], pa.list_(id_type)),
                ],
                names=["pack_id", "n_tokens", "ids", "cu_seqlens", "starts", "doc_ids"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, pattern)
        pieces, tokens, number = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype(width)
                for start in range(0, len(ids), row):
                    pieces.append((key.as_py(), start, ids[start : start + row]))
                tokens += len(ids)
                if tokens > held:
                    for out in packed(pieces, number):
                        number += out.num_rows
                        yield out
                    pieces, tokens = [], 0
        yield from packed(pieces, number)

    return pack


def pack_tokens(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    row: int = ROW,
    held: int = HELD,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """Packed rows: pack_id, n_tokens, ids (``row`` numbers, the room left filled with the end mark), cu_seqlens,
    starts and doc_ids.

    Defined cases: a null text is not written; an empty one is a single end mark; equal rows are written each; an empty
    table gives no rows; further columns of the input do not take part. The end mark is the id after the last rank.
    """
    ranks = read_ranks(vocabulary)
    end = max(ranks.values()) + 1
    width = "<u2" if end < 1 << 16 else "<u4"
    kind = docs.schema[key].dataType
    work = packer(docs.sparkSession.sparkContext.broadcast(ranks), pattern, row, held, end, width, to_arrow_type(kind))
    schema = f"pack_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, starts array<bigint>, doc_ids array<{kind.simpleString()}>"
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(work, schema)


def positions(cu_seqlens: list[int], starts: list[int]) -> np.ndarray:
    """Position of each token in its document: runs that are reset at every segment."""
    return np.concatenate([np.arange(s, s + b - a) for a, b, s in zip(cu_seqlens, cu_seqlens[1:], starts, strict=False)] or [np.zeros(0, int)])


SHARD = "shard_id bigint, n_rows int, ids binary, cu_seqlens binary, row_of binary, resets binary"


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows, at most ``BATCH`` of them, as one row of flat arrays."""
    names, kinds = [c.split()[0] for c in SHARD.split(", ")], (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            some = batch.slice(at, BATCH).to_pydict()
            row_of = np.repeat(np.arange(len(some["ids"])), [len(c) for c in some["cu_seqlens"]])
            arrays = [
                b"".join(some["ids"]),
                np.concatenate(some["cu_seqlens"]).astype("<i4").tobytes(),
                row_of.astype("<i4").tobytes(),
                np.concatenate(some["starts"]).astype("<i8").tobytes(),
            ]
            values = (some["pack_id"][0], len(some["ids"]), *arrays)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def write_shards(packs: DataFrame, path: str) -> None:
    """Writes the result of :func:`pack_tokens` through Spark, so to any store it reaches, one row per shard of at most
    ``BATCH`` packed rows: the id matrix, all cumulative segment lengths with the packed row each belongs to, and the
    position at which each segment's count is reset. A task writes what it packed; nothing is exchanged."""
    packs.select("pack_id", "ids", "cu_seqlens", "starts").mapInArrow(sharded, SHARD).write.parquet(path)


def read_shard(shard, row: int = ROW, width: str = "<u2") -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(id matrix, cumulative segment lengths of each row, position ids): positions count from each segment's reset; the
    room left in a row has position 0."""
    ids = np.frombuffer(shard["ids"], width).reshape(shard["n_rows"], row)
    ends, row_of, resets = (np.frombuffer(shard[c], k) for c, k in (("cu_seqlens", "<i4"), ("row_of", "<i4"), ("resets", "<i8")))
    borders = np.split(ends, np.flatnonzero(np.diff(row_of)) + 1)
    places, at = np.zeros(ids.shape, np.int64), 0
    for line, cu in zip(places, borders, strict=True):
        line[: cu[-1]] = positions(cu.tolist(), resets[at : at + len(cu) - 1].tolist())
        at += len(cu) - 1
    return ids, borders, places


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(read(spark, sf_dir, "documents"))
