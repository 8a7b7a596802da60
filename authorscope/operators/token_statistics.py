"""What the distribution rules read of the tokens of a text: numpy over the tokens of all texts of an Arrow batch.

Texts are cut into tokens here (:mod:`text_bytes`). The tokens of a batch are one flat array of numbers, a token's rank in the order of its bytes. One sort by (text, token,
position) gives counts, gaps and earlier uses; nothing loops over tokens in Python, and texts never leave their task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import placed_words
from .text_bytes import bytes_of, in_bytes, token_lists

# ---- fixed values ----
MIN_FREQUENT = 10
ZIPF_RANKS = 50
REPEAT_COUNT = 5
WINDOW, STEP = 50, 25
# ---- end of fixed values ----
#: Most repeated n-grams told of a text.
LEADING = 5
#: Tokens handled at once, or one text.
TOKENS = 1 << 20
#: ``n`` tokens, ``distinct`` ones; ``counts`` of the most frequent, falling; ``grams``: a list for each asked size.
STATISTICS = (
    "struct<n:int,distinct:int,burstiness:double,counts:array<int>,grams:array<array<string>>,"
    "windows:struct<n:double,mean:double,sd:double>>"
)
#: ``statistics`` and the asked ``parts`` that some token holds.
TOLD = f"struct<statistics:{STATISTICS},parts:array<string>>"


def lists(rows: np.ndarray, n_rows: int, values: pa.Array) -> pa.ListArray:
    """A list per row; ``rows`` is sorted and names the row of each value."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n_rows + 1)).astype(np.int32)), values)


def places_in_row(rows: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each row; ``rows`` is sorted."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys, none negative, equal ones by position. Sorting key and position as one number is several times
    faster than a stable sort of positions."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    packed = keys << bits | np.arange(len(keys))
    packed.sort()
    return packed & (1 << bits) - 1


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key in order: its first position, then the number of each position's key, and the keys' counts."""
    order = stable_order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    begins = np.flatnonzero(new)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[begins], which, np.diff(np.append(begins, len(keys)))


def doubles(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~known)


def burstiness(gaps: np.ndarray, runs_of_gaps: np.ndarray, counts: np.ndarray, frequent: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """Mean of (σ-μ)/(σ+μ) over the gaps between uses of each frequent token; null below ten of them.

    Sums run in the order of tokens and positions.
    """
    n = np.maximum(counts - 1, 1)
    mu = np.bincount(runs_of_gaps, gaps, len(counts)) / n
    sd = np.sqrt(np.bincount(runs_of_gaps, (gaps - mu[runs_of_gaps]) ** 2, len(counts)) / n)
    mu, sd, of = mu[frequent], sd[frequent], rows[frequent]
    found = np.bincount(of, minlength=n_rows)
    return doubles(np.bincount(of, (sd - mu) / (sd + mu), n_rows) / np.maximum(found, 1), found >= MIN_FREQUENT)


def window_moments(lengths: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> pa.Array:
    """``struct(n, mean, sd)`` of the distinct share of windows that start before ``length - WINDOW``; from exact sums."""
    n = np.where(lengths > WINDOW, (lengths - WINDOW - 1) // STEP + 1, 0)
    of = np.repeat(np.arange(len(lengths)), n)
    first = starts[of] + STEP * places_in_row(of)
    distinct = np.zeros(len(of))
    for i in range(WINDOW):
        distinct += earlier[first + i] < first
    s, q, known = np.bincount(of, distinct, len(n)), np.bincount(of, distinct * distinct, len(n)), n > 0
    n = np.maximum(n, 1).astype(float)
    var = (n * q - s * s) / (n * n)
    parts = [doubles(n, known), doubles(s / n / WINDOW, known), doubles(np.sqrt(var) / WINDOW, known)]
    return pa.StructArray.from_arrays(parts, ["n", "mean", "sd"], mask=pa.array(~known))


def repeated_grams(ids: np.ndarray, rows: np.ndarray, tokens: pa.Array, n_rows: int, sizes: tuple[int, ...]) -> dict[int, pa.ListArray]:
    """Up to five n-grams of each text that occur at least five times, most frequent first, ties by first position;
    single tokens in their order.

    ``ids`` numbers the (text, token) that are repeated, -1 elsewhere. An n-gram can only repeat where both its
    (n-1)-grams do, so only those positions are looked at.
    """
    out = {}
    for n in range(1, max(sizes, default=0) + 1):
        if n == 1:
            at = np.flatnonzero(ids >= 0)
            first, which, counts = grouped(ids[at])
        else:
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (rows[:-1] == rows[1:]))
            pairs = ids[at] * (int(ids.max(initial=0)) + 1) + ids[at + 1]
            first, which, counts = grouped(pairs)
        kept = counts >= REPEAT_COUNT
        ids = np.full(len(ids), -1)
        ids[at] = np.where(kept[which], (np.cumsum(kept) - 1)[which], -1)
        if n in sizes:
            first, counts = at[first[kept]], counts[kept]
            if n > 1:
                order = np.lexsort((first, -counts, rows[first]))
                first = first[order]
            first = first[places_in_row(rows[first]) < LEADING]
            words = [tokens.take(pa.array(first + i)) for i in range(n)]
            out[n] = lists(rows[first], n_rows, pc.binary_join_element_wise(*words, " ") if n > 1 else words[0])
    return out


def words_with(words: pa.Array, parts: tuple[str, ...]) -> list[np.ndarray]:
    """The numbers of the words that hold each part. All words are looked through as one text, once for the first bytes of
    all parts; what is found across the border of two does not count."""
    data, borders = bytes_of(words)
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint16)
    pairs, encoded = padded[:-2] | padded[1:-1] << 8, [np.frombuffer(p.encode(), np.uint8) for p in parts]
    # Few places begin with the first three bytes of a part; five bits of two and six of the third tell them well enough.
    telling = (padded[:-2] & 31) << 11 | (padded[1:-1] & 31) << 6 | (padded[2:] & 63)
    wanted = np.zeros(1 << 16, bool)
    for part in encoded:
        x, y, z = (int(b) for b in (*part[:3], -1, -1)[:3])
        ys, zs = ([b & m] if b >= 0 else np.arange(m + 1) for b, m in ((y, 31), (z, 63)))
        wanted[((x & 31) << 11) + (np.array(ys)[:, None] << 6) + np.array(zs)] = True
    places = np.flatnonzero(wanted[telling])
    # By their first two bytes, the places that a part may have are neighbours.
    begin = pairs[places]
    order = stable_order(begin.astype(np.int64))
    places, begin = places[order], begin[order]
    out = []
    for part in encoded:
        if len(part) > 1:
            key = int(part[0]) | int(part[1]) << 8
            at = places[np.searchsorted(begin, key) : np.searchsorted(begin, key, side="right")]
        else:
            at = np.flatnonzero(data == part[0])
        at = at[at + len(part) <= len(data)]
        for i in range(2, len(part)):
            at = at[data[at + i] == part[i]]
        word = np.searchsorted(borders, at, side="right") - 1
        out.append(np.unique(word[at + len(part) <= borders[word + 1]]))
    return out


def parts_held(words: pa.Array, codes: np.ndarray, rows: np.ndarray, n_rows: int, parts: tuple[str, ...]) -> pa.ListArray:
    """Those of ``parts`` of which each text has every word in some token, where the part leaves it: a part's word that is
    followed or preceded by something else ends or begins its token. ``words`` are the distinct tokens in order; ``codes``
    numbers those of ``rows``, each once a row. Only words are searched, which are few beside the tokens. Parts without
    words are not told."""
    asked = sorted({w for p in parts for w in placed_words(p)})
    found = words_with(pc.binary_join_element_wise("", words, "", " "), tuple(asked))
    which = np.repeat(np.arange(len(asked)), [len(f) for f in found])
    by_word = np.concatenate([np.zeros(0, np.int64), *found])
    order = np.argsort(by_word, kind="stable")
    which, held = which[order], np.bincount(by_word, minlength=len(words))
    first = np.cumsum(held) - held
    at = np.flatnonzero(held[codes] > 0)
    n = held[codes[at]]
    of = np.repeat(np.arange(len(at)), n)
    there = np.zeros((n_rows, len(asked)), bool)
    there[rows[at][of], which[first[codes[at]][of] + places_in_row(of)]] = True
    number = {w: i for i, w in enumerate(asked)}
    told = np.zeros((n_rows, len(parts)), bool)
    for i, part in enumerate(parts):
        if needed := [number[w] for w in placed_words(part)]:
            told[:, i] = there[:, needed].all(axis=1)
    of, which = np.nonzero(told)
    return lists(of, n_rows, pa.array(parts, pa.string()).take(pa.array(which)))


def symbols_held(texts: pa.Array, symbols: tuple[str, ...]) -> tuple[np.ndarray, list[str]]:
    """The rows of the texts that hold each of ``symbols``, which begin outside of ASCII, and which it is."""
    data, offsets = bytes_of(texts)
    rows, held = [np.zeros(0, np.int64)], []
    long = np.flatnonzero(data >= 0xC2) if symbols else np.zeros(0, np.int64)
    for symbol in symbols:
        encoded = np.frombuffer(symbol.encode(), np.uint8)
        at = long[data[long] == encoded[0]]
        at = at[at + len(encoded) <= len(data)]
        for i in range(1, len(encoded)):
            at = at[data[at + i] == encoded[i]]
        rows.append(np.unique(np.searchsorted(offsets, at, side="right") - 1))
        held += [symbol] * len(rows[-1])
    return np.concatenate(rows), held


def with_symbols(told: pa.StructArray, texts: pa.Array, parts: tuple[str, ...]) -> pa.StructArray:
    """``TOLD`` with those of ``parts`` that have no words, such as emojis, looked for in the texts themselves."""
    rows, held = symbols_held(texts, tuple(p for p in parts if not placed_words(p)))
    if not held:
        return told
    statistics, words = told.flatten()
    of = np.concatenate([pc.list_parent_indices(words).to_numpy().astype(np.int64), rows])
    order = np.argsort(of, kind="stable")
    values = pa.concat_arrays([words.flatten(), pa.array(held, pa.string())]).take(pa.array(order))
    return pa.StructArray.from_arrays([statistics, lists(of[order], len(texts), values)], ["statistics", "parts"])


def statistics_of(texts: pa.Array, sizes: tuple[int, ...], least: int) -> pa.Array:
    """A ``STATISTICS`` struct for each list of tokens, null for lists of fewer than ``least``."""
    return told_of(texts, sizes, least, ()).field("statistics")


def told_of(texts: pa.Array, sizes: tuple[int, ...], least: int, parts: tuple[str, ...]) -> pa.StructArray:
    """A ``TOLD`` struct for each list of tokens; the ``parts`` are told of short lists too."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_rows, tokens = len(lengths), texts.flatten().cast(pa.string())
    rows, starts = np.repeat(np.arange(n_rows), lengths), np.cumsum(lengths) - lengths
    encoded = tokens.dictionary_encode()
    words = encoded.dictionary
    rank, in_order = np.empty(len(words), np.int64), pc.sort_indices(words)
    rank[in_order.to_numpy()] = np.arange(len(words))
    codes = rank[encoded.indices.to_numpy(zero_copy_only=False)]
    long_enough = np.empty(len(words), bool)
    long_enough[rank] = pc.utf8_length(words).to_numpy() > 2

    key = rows * max(len(words), 1) + codes
    order = stable_order(key)
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    begins = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    counts = np.diff(np.append(begins, len(key)))
    run_rows, run_codes = rows[order[begins]], codes[order[begins]]
    earlier = np.full(len(key), -1)
    follows = np.flatnonzero(same)
    earlier[order[follows]] = order[follows - 1]
    gaps = order[follows] - order[follows - 1]

    bursts = burstiness(gaps, run[follows], counts, (counts >= 3) & long_enough[run_codes], run_rows, n_rows)
    most = int(counts.max(initial=0))
    falling = stable_order(run_rows * (most + 1) + most - counts)
    falling = falling[places_in_row(run_rows) < ZIPF_RANKS]
    repeated = counts >= REPEAT_COUNT
    ids = np.empty(len(key), np.int64)
    ids[order] = np.where(repeated, np.cumsum(repeated) - 1, -1)[run]
    grams = repeated_grams(ids, rows, tokens, n_rows, sizes)
    by_size = [grams[n] for n in sizes]
    told = pa.concat_arrays(by_size).take(pa.array(np.arange(n_rows * len(sizes)).reshape(len(sizes), n_rows).T.ravel())) if by_size else pa.array([], pa.list_(pa.string()))
    columns = {
        "n": pa.array(lengths, pa.int32()),
        "distinct": pa.array(np.bincount(run_rows, minlength=n_rows), pa.int32()),
        "burstiness": bursts,
        "counts": lists(run_rows[falling], n_rows, pa.array(counts[falling], pa.int32())),
        "grams": pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1) * len(sizes), pa.int32()), told),
        "windows": window_moments(lengths, starts, earlier),
    }
    statistics = pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=pa.array(lengths < least))
    held = parts_held(words.take(in_order), run_codes, run_rows, n_rows, parts)
    return pa.StructArray.from_arrays([statistics, held], ["statistics", "parts"])


def in_pieces(texts: pa.Array) -> list[pa.Array]:
    """Neighbouring lists with some ``TOKENS`` tokens, or one list."""
    held = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    borders, at = [], 0
    while at < len(texts):
        limit = (held[at - 1] if at else 0) + TOKENS
        borders.append((at, at := max(at + 1, int(np.searchsorted(held, limit, side="right")))))
    return [texts.slice(a, b - a) for a, b in borders] or [texts]


@functools.cache
def _told(sizes: tuple[int, ...], least: int, parts: tuple[str, ...]) -> Callable:
    def of(texts: pa.Array, code: pa.Array, unknown: pa.Array) -> pa.Array:
        code, characters = code.to_numpy(zero_copy_only=False), "".join(unknown.drop_null().unique().to_pylist())
        pieces = [token_lists(texts.slice(a, z - a), code[a:z], characters) for a, z in in_bytes(texts) or [(0, 0)]]
        told = pa.concat_arrays([told_of(piece, sizes, least, parts) for lists_of in pieces for piece in in_pieces(lists_of)])
        return with_symbols(told, texts, parts)

    of.__annotations__ = {"texts": pa.Array, "code": pa.Array, "unknown": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, TOLD)


def token_statistics(lowered: Column, code: Column, unknown: Column, sizes: tuple[int, ...], least: int, parts: tuple[str, ...] = ()) -> Column:
    """``TOLD`` of the tokens of a text; ``statistics`` are null below ``least`` of them."""
    return _told(tuple(sizes), least, tuple(parts))(lowered, code, unknown)
