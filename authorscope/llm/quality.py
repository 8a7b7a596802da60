"""Document quality: a classifier's evidence combined with what is known of the site, by hierarchical empirical Bayes.

A logistic model of surface features (case, symbols, repeated words, separators, word lengths) is fitted on a bounded
sample of labelled rows. Its probabilities over all documents are summed per path and per host. A host's rate is shrunk
toward the global rate, a path's toward its host's, each with a strength found by moments from the spread between
groups; so a site with few documents says little. A document's own probability is taken out of its site's sums, and its
odds are moved from the global prior to the site's.

Sums are partial aggregates; scoring is a map and reads the texts twice rather than moving them.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, read, without
from .hashing import WHITE, Words, text_chunks

#: Labelled rows the model is fitted on, at most; taken in the order of a hash of their id.
SAMPLE_ROWS = 20_000
#: Shrinkage strengths, in documents.
STRENGTH = (20.0, 10_000.0)
#: Rows of the site table that are broadcast, at most; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
FOLDS = 5
OWN = ("evidence", "site_rate", "score", "kept")
_ADDED = ("_p", "_words", "_host", "_path")


NAMES = ("upper", "letters", "symbols", "stops", "repeats", "bars", "digits", "word_length", "log_words")


def byte_set(*characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in "".join(characters)]] = True
    return table


_DIGITS = byte_set(string.digits)
_ASCII_UPPER = byte_set(string.ascii_uppercase)
_LETTERS = byte_set(string.ascii_letters)
_LETTERS[192:] = True  # the first byte of any character beyond ASCII
_SYMBOLS = byte_set(string.punctuation) & ~byte_set(".,;:'\"()-")
_STOPS = byte_set(".!?")
_CHARACTERS = np.ones(256, bool)
_CHARACTERS[128:192] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of NAMES per text, rates per word or character, zero without words; and the number of words."""
    rows, counts = [np.zeros((0, len(NAMES)))], [np.zeros(0, int)]
    for _, _, data, offsets in text_chunks(column):
        words = Words(data, offsets, WHITE, fold=False)
        in_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        in_words = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.first])
        upper = _ASCII_UPPER[data]
        if len(data):  # A-grave to Thorn in UTF-8
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        letter = in_text(_LETTERS[data])
        n, chars = np.maximum(words.counts, 1), np.maximum(in_text(_CHARACTERS[data]), 1)
        hashes = words.hashes()
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[words.first[:-1][words.counts > 0]] = False
        solid = np.concatenate([[0], np.cumsum(_LETTERS[data] | _DIGITS[data])])
        found = np.stack(
            [
                in_text(upper) / np.maximum(letter, 1),
                letter / chars,
                in_text(_SYMBOLS[data]) / n,
                in_words(_STOPS[data[words.end - 1]]) / n,
                in_words(again) / n,
                in_words(solid[words.end] == solid[words.start]) / n,
                in_text(_DIGITS[data]) / chars,
                np.minimum(chars / n, 50) / 10,
                np.log(n) / 10,
            ],
            axis=1,
        )
        rows.append(found * (words.counts > 0)[:, None])
        counts.append(words.counts)
    return np.concatenate(rows), np.concatenate(counts)


@dataclass(frozen=True)
class Model:
    """Weights for features after a square root, which spreads small rates; the last is the constant."""

    weights: tuple[float, ...]
    base_rate: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.sqrt(np.maximum(x, 0)) @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> Model:
    """Ridge logistic regression by Newton steps. Without both classes the constant alone is fitted."""
    rate = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2:
        return Model((0.0,) * len(NAMES) + (float(np.log(rate / (1 - rate))),), rate)
    x = np.sqrt(np.maximum(x, 0))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(z) * np.eye(len(w))
    penalty[-1, -1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty
        w = w + np.linalg.solve(hessian, z.T @ (y - p) - penalty @ w)
    weights = w[:-1] / scale
    return Model((*weights.tolist(), float(w[-1] - weights @ mean)), rate)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model fitted on at most ``rows`` labelled documents, none of the held-out fifth."""
    sample = (
        labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("_quality"))
        .distinct()
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_quality")
        .limit(rows)
    )
    joined = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_label_id")
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = features(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(NAMES)), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["quality", "x"])

    # of the texts of an id the first: the sample is the same whatever the order of rows
    joined = joined.groupBy("_id", "_quality").agg(F.min("_text").alias("_text"))
    got = joined.select(F.col("_quality").cast("double").alias("quality"), "_text").mapInArrow(measured, "quality double, x array<double>")
    got = got.collect()  # at most ``rows``
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(NAMES)), np.array([r["quality"] for r in got]))


def with_evidence(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """``rows`` with the model's probability _p, and whether there are _words."""
    at = rows.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = features(batch.column(at))
            more = [pa.array(model.probability(found)), pa.array(words > 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_p", "_words"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_p", T.DoubleType()), T.StructField("_words", T.BooleanType())])
    return rows.mapInArrow(scored, schema)


def shrunk_rates(rows: DataFrame) -> DataFrame:
    """(_host, _path, strengths and sums) from rows of (_host, _path, _p): what a document's prior is made of."""
    paths = durable(rows.groupBy("_host", "_path").agg(F.count("*").alias("path_n"), F.sum("_p").alias("path_sum")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    total = paths.agg(F.sum("path_n"), F.sum("path_sum")).first()
    n, overall = float(total[0] or 0), float(total[1] or 0)
    rate = (overall + 1) / (n + 2)

    def strength(groups: DataFrame, size: str, amount: str, around: Column, free: int) -> float:
        """Prior weight that explains the spread between groups, ``around`` what they belong to, beyond what chance gives;
        ``free`` of them would have none."""
        mean = F.col(amount) / F.col(size)
        spread = groups.agg(
            F.sum(F.col(size) * (mean - around) * (mean - around)).alias("between"), F.count("*").alias("groups")
        ).first()
        chance = rate * (1 - rate)
        between = (float(spread["between"] or 0) - chance * (float(spread["groups"]) - free)) / max(n, 1.0)
        return float(np.clip(chance / between - 1 if between > 0 else np.inf, *STRENGTH))

    joined = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    of_host = strength(hosts, "host_n", "host_sum", F.lit(rate), 1)
    of_path = strength(joined, "path_n", "path_sum", F.col("host_sum") / F.col("host_n"), hosts.count())
    return joined.withColumns({"rate": F.lit(rate), "of_host": F.lit(of_host), "of_path": F.lit(of_path)})


def quality(
    docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5
) -> DataFrame:
    """``docs`` with evidence (the model's probability), site_rate (the shrunk prior), score and kept.

    Defined cases: a text without words scores 0 and is not kept; null hosts and paths are a site of their own; equal
    rows score alike; without labels of both classes the evidence is the label rate; columns named like one added here
    are replaced.
    """
    site_columns = {"_host": F.col(f"`{host}`").cast("string"), "_path": F.col(f"`{path}`").cast("string")}
    rows = with_evidence(without(docs, *OWN).withColumns(site_columns), model, text)
    first = with_evidence(docs.withColumns(site_columns).select("_host", "_path", f"`{text}`"), model, text)
    sites = durable(shrunk_rates(first.where("_words").select("_host", "_path", "_p")), "sites")
    sites = sites.toDF(*[f"_site_{c.removeprefix('_')}" for c in sites.columns])
    if sites.count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    same = F.col("_host").eqNullSafe(F.col("_site_host")) & F.col("_path").eqNullSafe(F.col("_site_path"))
    joined = rows.join(sites, same, "left")
    of = lambda name: F.col(f"_site_{name}")
    host_rate = (of("of_host") * of("rate") + of("host_sum") - F.col("_p")) / (of("of_host") + of("host_n") - 1)
    site = (of("of_path") * host_rate + of("path_sum") - F.col("_p")) / (of("of_path") + of("path_n") - 1)
    odds = lambda v: F.log(v / (1 - v))
    inside = lambda v: F.least(F.greatest(v, F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(odds(inside(F.col("_p"))) + odds(inside(F.col("site_rate"))) - odds(inside(of("rate"))))))
    return (
        joined.withColumn("site_rate", site)
        .withColumns({"evidence": F.col("_p"), "score": F.when(F.col("_words"), score).otherwise(0.0)})
        .withColumn("kept", F.col("score") >= threshold)
        .drop(*_ADDED, *sites.columns)
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = trained(docs, read(spark, sf_dir, "labels"))
    return quality(docs.select("doc_id", "text", "source", "lang"), model).select("doc_id", "evidence", "site_rate", "score", "kept")
