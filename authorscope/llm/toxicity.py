"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings, of the word and of its beginnings of two lengths, so unseen inflections
of a word are near it. Filters of several widths run over the whole text, each keeps its largest response, and a logistic
unit weighs them. Training takes a bounded sample of labelled rows in batches of equal parts of both classes; words and
beginnings met in few documents of the sample have no vector, so no document is learned by its rarities. The score is
shifted by a threshold calibrated for the language that the text's function words suggest, so that 0.5 is the border in
each language; it is calibrated on scores of rows by networks that did not learn them. The language column is not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, without
from .hashing import PUNCTUATION, U, Words, text_chunks

#: Labelled rows of each class that are learned from, at most; taken in the order of a hash of their id.
SAMPLE_ROWS = 3000
#: Embedding rows of words, and of their beginnings of each length in bytes.
WORD_ROWS, PREFIX_ROWS = 1 << 14, 1 << 13
PREFIX_BYTES = (4, 7)
BUCKETS = WORD_ROWS + PREFIX_ROWS * len(PREFIX_BYTES)
#: Documents of the sample in which a word or beginning must occur to have a vector.
LEAST_DOCUMENTS = 5
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 5
BATCH = 32
RATE = 0.08
DECAY = 1e-3
#: Bytes of text convolved at once, words likewise, and bytes after which a long text is cut at the next border of words.
CHUNK = 1 << 18
STEP = 1 << 15
PIECE = 1 << 20
FOLDS = 5
#: Networks by whose scores of rows they did not learn the thresholds are set.
CALIBRATION_FOLDS = 3
#: Function words by which a language is told, fixed values; a text with none is of no known language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "with"),
    "de": ("der", "die", "und", "das", "ist", "von", "den"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour"),
    "es": ("el", "los", "las", "del", "y", "se", "por"),
}
#: Calibration rows of each class of a language below which the threshold of all languages is used.
LEAST_ROWS = 20
OWN = ("held_out", "score", "predicted")


@dataclass
class Tokens:
    """Embedding rows per word (kind, word); each text ends in ``max(WIDTHS)`` empty ones, so no filter spans two texts."""

    rows: np.ndarray
    starts: np.ndarray
    votes: np.ndarray  # function words of each language, per text

    @property
    def language(self) -> np.ndarray:
        return np.where(self.votes.max(axis=1) > 0, self.votes.argmax(axis=1), len(LANGUAGE_HASHES))


def _language_hashes() -> list[np.ndarray]:
    found = []
    for words in FUNCTION_WORDS.values():
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        found.append(Words(data, np.array([0, len(data)]), PUNCTUATION, fold=True).hashes())
    return found


LANGUAGE_HASHES = _language_hashes()


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    words = Words(data, offsets, PUNCTUATION, fold=True)
    hashes = words.hashes()
    pad = max(WIDTHS)
    sizes = words.counts + pad
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - words.first[:-1], words.counts) + np.arange(len(hashes))
    rows = np.full((1 + len(PREFIX_BYTES), sizes.sum()), BUCKETS, np.int32)
    rows[0, at] = (hashes % U(WORD_ROWS)).astype(np.int32)
    for i, size in enumerate(PREFIX_BYTES):
        rows[1 + i, at] = (words.prefix_hashes(size) % U(PREFIX_ROWS)).astype(np.int32) + WORD_ROWS + i * PREFIX_ROWS
    votes = [np.diff(np.concatenate([[0], np.cumsum(np.isin(hashes, known))])[words.first]) for known in LANGUAGE_HASHES]
    return Tokens(rows, starts, np.stack(votes, axis=1))


def cuts(data: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the pieces of a long text: cut between words, each begins with the last words of the one before,
    as many as the widest filter needs to span the cut."""
    found, start = [], 0
    while start < len(data):
        stop = min(start + PIECE, len(data))
        while stop < len(data) and not PUNCTUATION[data[stop]]:
            ahead = np.flatnonzero(PUNCTUATION[data[stop : stop + PIECE]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + PIECE, len(data))
        begin = start
        if start:
            inside = ~PUNCTUATION[data[max(found[-1][0], start - PIECE) : start + 1]]
            words = np.flatnonzero(inside[1:-1] & ~inside[:-2]) + 1  # where words begin, but for the one at the edge
            words = np.concatenate([[0] if inside[0] else [], words]).astype(int)
            begin = start - (len(inside) - 1) + int(words[-min(len(words), max(WIDTHS) - 1)]) if len(words) else start
        found.append((begin, stop))
        start = stop
    return found


@dataclass
class Network:
    embedding: np.ndarray  # BUCKETS + 1 rows, the last one empty
    filters: list[np.ndarray]  # per width: (width, SIZE, FILTERS)
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray  # per language, the last for none

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        x = self.embedding[rows[0]]
        for beginnings in rows[1:]:
            x += self.embedding[beginnings]
        # one product for all filters; what a filter says of its next words moves up to its first
        said = x @ np.hstack([step for kernel in self.filters for step in kernel])
        found, at = [], 0
        for kernel, offset in zip(self.filters, self.offsets, strict=True):
            h = said[:, at : at + FILTERS] + offset
            for step in range(1, len(kernel)):
                h[:-step] += said[step:, at + step * FILTERS : at + (step + 1) * FILTERS]
            found.append(np.maximum(h, 0, out=h))
            at += len(kernel) * FILTERS
        return x, found

    def pooled(self, tokens: Tokens) -> np.ndarray:
        """Each filter's largest response in each text, ``STEP`` words at a time."""
        out = np.zeros((len(tokens.starts), FILTERS * len(WIDTHS)), np.float32)
        size = tokens.rows.shape[1]
        for low in range(0, size, STEP):
            high = min(low + STEP, size)
            _, found = self.responses(tokens.rows[:, low : high + max(WIDTHS) - 1])
            first, last = np.searchsorted(tokens.starts, low, "right") - 1, np.searchsorted(tokens.starts, high)
            at = np.maximum(tokens.starts[first:last] - low, 0)
            largest = np.maximum.reduceat(np.hstack([h[: high - low] for h in found]), at, axis=0)
            out[first:last] = np.maximum(out[first:last], largest)
        return out

    def logits(self, tokens: Tokens) -> np.ndarray:
        return self.pooled(tokens).astype(float) @ self.out + self.bias

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[language], -30, 30)))

    def scores_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts; one that is longer than a piece is convolved piece by piece and pooled over all of it."""
        if len(data) <= PIECE:
            tokens = tokens_of(data, offsets)
            return self.scores(self.logits(tokens), tokens.language)
        found = []
        for begin, end in zip(offsets[:-1], offsets[1:]):
            pooled, votes = np.zeros((1, FILTERS * len(WIDTHS)), np.float32), np.zeros((1, len(LANGUAGE_HASHES)), np.int64)
            for low, high in cuts(data[begin:end]) or [(0, 0)]:
                tokens = tokens_of(data[begin + low : begin + high], np.array([0, high - low]))
                pooled, votes = np.maximum(pooled, self.pooled(tokens)), votes + tokens.votes
            tokens = Tokens(np.zeros((1, 0), np.int64), np.zeros(1, np.int64), votes)
            found.append(self.scores(pooled.astype(float) @ self.out + self.bias, tokens.language))
        return np.concatenate(found)


def fresh(seed: int, known: np.ndarray) -> Network:
    random = np.random.default_rng(seed)
    table = (random.standard_normal((BUCKETS + 1, SIZE)) * 0.1).astype(np.float32)
    table[~known] = 0
    kernels = [(random.standard_normal((w, SIZE, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
    return Network(
        table,
        kernels,
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        random.standard_normal(FILTERS * len(WIDTHS)) * 0.2,
        0.0,
        np.zeros(len(FUNCTION_WORDS) + 1),
    )


def tokens_of_texts(texts: list[str]) -> Tokens:
    bodies = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    return tokens_of(np.frombuffer(b"".join(bodies), np.uint8), offsets)


class Learner:
    """Adagrad on the log loss, with decay; a filter learns only where its response was largest. Rows of the embedding
    that are not ``known`` stay empty."""

    def __init__(self, network: Network, known: np.ndarray):
        self.n, self.unknown = network, ~known
        self.squares = {name: np.full_like(value, 1e-3) for name, value in self.parts().items()}

    def parts(self) -> dict[str, np.ndarray]:
        named = {"embedding": self.n.embedding, "out": self.n.out}
        for i in range(len(WIDTHS)):
            named |= {f"filters{i}": self.n.filters[i], f"offsets{i}": self.n.offsets[i]}
        return named

    def step(self, tokens: Tokens, labels: np.ndarray) -> None:
        n = self.n
        x, found = n.responses(tokens.rows)
        size = tokens.rows.shape[1]
        stops = np.append(tokens.starts[1:], size)
        places = [np.stack([a + h[a:b].argmax(axis=0) for a, b in zip(tokens.starts, stops, strict=True)]) for h in found]
        pooled = np.hstack([np.take_along_axis(h, at, axis=0) for h, at in zip(found, places, strict=True)]).astype(float)
        error = (1 / (1 + np.exp(-np.clip(pooled @ n.out + n.bias, -30, 30))) - labels) / len(labels)
        slopes = {"out": pooled.T @ error, "embedding": np.zeros_like(n.embedding)}
        back = (error[:, None] * n.out * (pooled > 0)).astype(np.float32)
        for i, at in enumerate(places):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            slopes[f"offsets{i}"] = own.sum(axis=0)
            kernel = np.zeros_like(n.filters[i])
            for step in range(WIDTHS[i]):
                where = np.minimum(at + step, size - 1)
                kernel[step] = np.einsum("bf,bfd->df", own, x[where])
                to_words = own[:, :, None] * n.filters[i][step].T[None]
                for rows in tokens.rows:
                    np.add.at(slopes["embedding"], rows[where], to_words)
            slopes[f"filters{i}"] = kernel
        slopes["embedding"][self.unknown] = 0
        for name, value in self.parts().items():
            slopes[name] = slopes[name] + DECAY * value
            self.squares[name] += slopes[name] ** 2
            value -= (RATE * slopes[name] / np.sqrt(self.squares[name])).astype(value.dtype)
        n.bias -= RATE * float(error.sum())


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap that splits the classes with the least sum of both error rates."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1)
    false = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max((1 - y).sum(), 1)
    edges = np.concatenate([[z[0] - 2], (z[:-1] + z[1:]) / 2, [z[-1] + 2]])
    cost = missed + false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def together(texts: list[Tokens]) -> Tokens:
    sizes = [t.rows.shape[1] for t in texts]
    starts = np.cumsum(sizes) - sizes
    return Tokens(np.concatenate([t.rows for t in texts], axis=1), starts, np.concatenate([t.votes for t in texts]))


def known_rows(texts: list[Tokens]) -> np.ndarray:
    """Embedding rows whose words or beginnings occur in ``LEAST_DOCUMENTS`` of the texts or more."""
    met = np.zeros(BUCKETS + 1, np.int64)
    for tokens in texts:
        met[np.unique(tokens.rows)] += 1
    met[-1] = 0
    return met >= min(LEAST_DOCUMENTS, max(len(texts) // 8, 1))


def learned(texts: list[Tokens], labels: np.ndarray, seed: int) -> Network:
    """A network fitted on batches that hold half of each class; an epoch has as many rows as there are texts."""
    known = known_rows(texts)
    network = fresh(seed, known)
    learner = Learner(network, known)
    random = np.random.default_rng(seed)
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    half = BATCH // 2
    for _ in range(EPOCHS):
        steps = max(1, len(texts) // BATCH)
        drawn = [np.concatenate([random.permutation(side) for _ in range(-(-steps * half // len(side)))]) for side in sides]
        for i in range(steps):
            rows = np.concatenate([d[i * half : (i + 1) * half] for d in drawn])
            learner.step(together([texts[r] for r in rows]), labels[rows])
    return network


def fit(texts: list[str], labels: np.ndarray, seed: int = 1) -> Network:
    """A network fitted on all texts; its thresholds on scores of rows by networks of the same kind that had not learned
    them. One class alone gives its own rate."""
    if len(set(labels.tolist())) < 2 or min(np.bincount(labels.astype(int))) < CALIBRATION_FOLDS:
        network = fresh(seed, np.zeros(BUCKETS + 1, bool))
        network.out[:] = 0
        network.bias = 2.0 if len(labels) and labels.mean() > 0.5 else -2.0
        return network
    fold = np.empty(len(texts), int)
    for y in (0, 1):  # both classes in each fold
        side = np.random.default_rng(seed).permutation(np.flatnonzero(labels == y))
        fold[side] = np.arange(len(side)) % CALIBRATION_FOLDS
    tokens = [tokens_of_texts([t]) for t in texts]  # the sample is bounded, and each text is read in every epoch
    found, language = np.zeros(len(texts)), np.concatenate([t.language for t in tokens])
    for number in range(CALIBRATION_FOLDS):
        apart, rest = np.flatnonzero(fold == number), np.flatnonzero(fold != number)
        network = learned([tokens[r] for r in rest], labels[rest], seed + number)
        for i in range(0, len(apart), BATCH):
            rows = apart[i : i + BATCH]
            found[rows] = network.logits(together([tokens[r] for r in rows]))
    network = learned(tokens, labels, seed)
    network.thresholds[:] = best_threshold(found, labels)
    for code in range(len(FUNCTION_WORDS)):
        own = language == code
        if min(np.bincount(labels[own].astype(int), minlength=2)) >= LEAST_ROWS:
            network.thresholds[code] = best_threshold(found[own], labels[own])
    return network


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Network:
    """A network that learned from at most ``rows`` documents of each class, none of them held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_label_id"), "toxic")
    order = [F.xxhash64("_label_id"), "_label_id"]
    # an id once per class, and of its texts the first: the sample is the same whatever the order of rows
    usable = usable.distinct()
    sample = usable.where("toxic = 1").orderBy(*order).limit(rows).unionByName(usable.where("toxic = 0").orderBy(*order).limit(rows))
    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    joined = texts.join(F.broadcast(sample), F.col("_id") == F.col("_label_id"))
    got = joined.groupBy("_id", "toxic").agg(F.min("_text").alias("_text")).collect()  # at most 2 * rows
    got.sort(key=lambda r: (r["_id"], r["_text"]))
    return fit([r["_text"] for r in got], np.array([float(r["toxic"]) for r in got]))


def scorer(network: Network, at: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network.scores_of(data, offsets) for _, _, data, offsets in text_chunks(batch.column(at), CHUNK)]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return score


def toxicity(docs: DataFrame, network: Network, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Defined cases: a null or empty text scores as one without words; a null key is not held out; without labels of both
    classes all texts score alike; columns named like one added here are replaced. Long texts are read whole.
    """
    rows = without(docs, *OWN)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(scorer(network, rows.columns.index(text)), schema)
    return scored.withColumns(
        {"held_out": F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")}
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, trained(docs, read(spark, sf_dir, "labels"))).select("doc_id", *OWN)
