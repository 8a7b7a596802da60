"""Tokens and sentences of the texts of an Arrow batch: numpy over their UTF-8 bytes.

Texts cross to Python as they are. Cutting them in the JVM makes a string for every token, which costs more than all that
is counted of them. The cuts are those of :mod:`..functions.text`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import any_of
from ..functions.regex import WHITESPACE_CHARS, _ASCII_WORD

#: Classes of characters; a stop is neither of the others.
WORD, SPACE, STOP = 1, 2, 4
STOPS = ".!?"
#: Letters and digits of Unicode lie below.
LAST_LETTER = 0x40000
#: Bytes of text handled at once, or one text.
PIECE_BYTES = 1 << 22
#: Sentences longer than this many characters count; longer than the second, they also count as ``long``.
LEAST, LONG = 10, 20
#: Most frequent first words told, from this many sentences on.
LEADING, ENOUGH = 3, 5
SUMS = "n:double,s:double,q:double"
#: Number of sentences, sum and sum of squares of their words; the same of long ones; ``top`` first words, ``neg`` the negated count.
SENTENCES = f"struct<{SUMS},long:struct<{SUMS}>,top:array<struct<neg:int,value:string>>>"
#: Characters whose lower case has another length, or depends on what stands beside them.
UNEVEN = ("İ", "Σ")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x80, LAST_LETTER) if unicodedata.category(chr(c))[0] in "LN"]] = WORD
    out[[ord(c) for c in _ASCII_WORD]] = WORD
    out[[ord(c) for c in WHITESPACE_CHARS]] = SPACE
    out[[ord(c) for c in STOPS]] = STOP
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; the end comes last. Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def class_of_bytes(data: np.ndarray, unknown: str = "") -> np.ndarray:
    """The class of the character that each byte belongs to; ``unknown`` characters have none."""
    table = classes()
    if unknown:
        table = table.copy()
        table[[ord(c) for c in unknown]] = 0
    out = table[:256].copy()
    out[0x80:] = 0
    out = out[data]
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])

        def rest(i: int) -> np.ndarray:
            return padded[at + i].astype(np.uint32) & 0x3F

        first = data[at].astype(np.uint32)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        two = (first & 0x1F) << 6 | rest(1)
        three = (first & 0x0F) << 12 | rest(1) << 6 | rest(2)
        four = (first & 0x07) << 18 | rest(1) << 12 | rest(2) << 6 | rest(3)
        found = table[np.minimum(np.where(more == 1, two, np.where(more == 2, three, four)), 0x10FFFF)]
        out[at] = found
        for i in (1, 2, 3):
            reach = (more >= i) & (at + i < len(data))
            out[at[reach] + i] = found[reach]
    return out


def runs(mask: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of true places begins, and whether it ends behind each place; no run goes across a border."""
    before = np.zeros(len(mask) + 1, bool)
    before[1:] = mask
    behind = before[1:].copy()
    behind[:-1] = mask[1:]
    if len(behind):
        behind[-1] = False
    before[borders] = False
    behind[borders[borders > 0] - 1] = False
    return mask & ~before[:-1], mask & ~behind


def token_lists(texts: pa.Array, code: np.ndarray, unknown: str = "") -> pa.ListArray:
    """The tokens of each text: runs of word characters; where ``code``, also each other character that is not a space."""
    data, offsets = bytes_of(texts)
    kinds = class_of_bytes(data, unknown)
    kept = kinds == WORD
    begins, _ = runs(kept, offsets)
    if code.any():
        single = (kinds != WORD) & (kinds != SPACE) & np.repeat(code, np.diff(offsets))
        begins |= single & (data & 0xC0 != 0x80)
        kept |= single
    counts = np.searchsorted(np.flatnonzero(begins), offsets).astype(np.int32)
    ends = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[kept]))
    return pa.ListArray.from_arrays(pa.array(counts), tokens)


def sentence_facts(texts: pa.Array, unlowered: np.ndarray) -> pa.StructArray:
    """A ``SENTENCES`` struct for each text. First words of ``unlowered`` texts are lower-cased."""
    data, offsets = bytes_of(texts)
    n_rows, kinds = len(texts), class_of_bytes(data)
    begins, ends = runs((kinds != SPACE) & (kinds != STOP), offsets)
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    rows, stops = np.searchsorted(offsets, begins, side="right") - 1, np.searchsorted(np.flatnonzero(kinds == STOP), begins)
    new = np.ones(len(begins), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (stops[1:] != stops[:-1])
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(begins)))
    a, z = begins[first], ends[first + words - 1]
    within = np.flatnonzero(data & 0xC0 == 0x80)
    characters = z - a - (np.searchsorted(within, z) - np.searchsorted(within, a))
    kept = characters > LEAST
    rows, words, a, z, characters = rows[first][kept], words[kept], a[kept], ends[first][kept], characters[kept]

    def sums(these: np.ndarray) -> list[pa.Array]:
        of, n = rows[these], words[these].astype(float)
        return [pa.array(np.bincount(of, w, n_rows).astype(float)) for w in (None, n, n * n)]

    names = ["n", "s", "q"]
    told = sums(np.ones(len(rows), bool))
    long = pa.StructArray.from_arrays(sums(characters > LONG), names)
    enough = told[0].to_numpy()[rows] >= ENOUGH
    top = leading(data, a[enough], z[enough], rows[enough], n_rows, unlowered)
    return pa.StructArray.from_arrays([*told, long, top], [*names, "long", "top"])


def leading(data: np.ndarray, a: np.ndarray, z: np.ndarray, rows: np.ndarray, n_rows: int, unlowered: np.ndarray) -> pa.ListArray:
    """The most frequent of the texts from ``a`` to ``z`` of each row, ties by first use."""
    lengths = z - a
    borders = np.append(0, np.cumsum(lengths))
    taken = data[np.repeat(a - borders[:-1], lengths) + np.arange(borders[-1])]
    words = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())
    if unlowered.any():
        words = pa.array([w.lower() if change else w for w, change in zip(words.to_pylist(), unlowered[rows])], pa.string())
    encoded = words.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, at, counts = np.unique(rows * max(len(encoded.dictionary), 1) + codes, return_index=True, return_counts=True)
    order = np.lexsort((at, -counts, rows[at]))
    at, counts = at[order], counts[order]
    ahead = np.arange(len(at)) - np.searchsorted(rows[at], rows[at]) < LEADING
    at, counts = at[ahead], counts[ahead]
    values = pa.StructArray.from_arrays([pa.array(-counts, pa.int32()), words.take(pa.array(at))], ["neg", "value"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[at], np.arange(n_rows + 1)).astype(np.int32)), values)


def in_bytes(texts: pa.Array, limit: int = 0) -> list[tuple[int, int]]:
    """Borders of neighbouring texts with some ``PIECE_BYTES`` in all, or of one text."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        upto = (held[at - 1] if at else 0) + (limit or PIECE_BYTES)
        out.append((at, at := max(at + 1, int(np.searchsorted(held, upto, side="right")))))
    return out


@functools.cache
def _facts() -> Callable:
    def of(lowered: pa.Array, uneven: pa.Array, code: pa.Array) -> pa.Array:
        texts = pc.if_else(code, pa.scalar(None, pa.string()), pc.coalesce(uneven, lowered))
        unlowered = pc.is_valid(uneven).to_numpy(zero_copy_only=False)
        pieces = in_bytes(texts) or [(0, 0)]
        return pa.concat_arrays([sentence_facts(texts.slice(a, z - a), unlowered[a:z]) for a, z in pieces])

    of.__annotations__ = {"lowered": pa.Array, "uneven": pa.Array, "code": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, SENTENCES)


def sentences(lowered: Column, content: Column, code: Column) -> Column:
    """``SENTENCES`` of a text, none where ``code``. The text itself only crosses where its lower case has other lengths."""
    uneven = F.when(~code & any_of([content.contains(c) for c in UNEVEN]), F.make_valid_utf8(content))
    return _facts()(lowered, uneven, code)


def unknown_characters(lowered: Column) -> Column:
    """The characters that Java has no category for, so that both sides tell the same letters."""
    found = F.array_join(F.regexp_extract_all(lowered, F.lit(r"[[^\x00-\x7f]&&\p{Cn}]"), F.lit(0)), "")
    return F.when(F.octet_length(lowered) != F.length(lowered), found)
