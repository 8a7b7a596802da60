"""Whitening of embeddings from a covariance made of variances alone.

Polarisation: 2 cov(a, b) = var(a + b) - var(a) - var(b). So the job aggregates squares only, of every dimension and of
the sum of every two dimensions, and the whole covariance is assembled from differences.

Entries become whole numbers, so everything up to the covariance is exact: each task centres its rows by the rounded
mean, sums squares in 64-bit integers and hands them on in limbs of 40 bits, which Spark adds up; the driver, which gets
one number per pair of dimensions, corrects for the rounding of the mean in Python's unbounded integers. Rows whose
squares could pass 64 bits are squared in unbounded integers too.

The fit takes each distinct vector once. A vector travels as the shortest of 1, 2, 4 or 8 bytes an entry, so the
exchange that removes copies is smaller than the input, and copies meet in the tasks before it. The constant that makes
whole numbers positive (``SHIFT``) moves no deviation, variance or projection; vectors travel without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import durable, read, without

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMB, LIMBS = 40, 4
#: Rows squared at once.
ROWS = 2048
#: An eigenvalue below this share of the largest is no variance but rounding.
RANK = 1e-12
OWN = ("n", "deviation", "whitened", "explained", "identity_error")
ARROW = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())


@dataclass(frozen=True)
class Whitener:
    """Fitted on ``n`` distinct vectors with the sums ``sums``; ``axes`` (dimension, component) are unit vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, each of variance one over the fit list."""
        near, rest = centres(self.n, self.sums)
        return ((x - near) - rest / self.n) @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row; null where no long holds it."""
        near, rest = centres(self.n, self.sums)
        y = x - near
        reach = int(np.abs(y).max(initial=0)) * self.n + int(np.abs(rest).max(initial=0))
        if reach**2 * max(x.shape[1], 1) < 2**63:
            y = y * self.n - rest
            return np.einsum("nd,nd->n", y, y).tolist()
        exact = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < 2**63 else None for v in exact]


def centres(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rounded mean of each dimension, and what the sums hold beyond n times it."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(near, np.int64), np.array([s - n * c for s, c in zip(sums, near)], np.int64)


def quantised(vectors: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * c) of each vector; None for one that is null, or has an entry that is null, not finite, or
    too large for a long."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    entries = vectors.flatten()
    usable = np.asarray(entries.is_valid())
    c = np.floor(scale * np.asarray(entries.fill_null(0).cast(pa.float64())))
    usable &= np.isfinite(c) & (np.abs(np.where(np.isfinite(c), c, 0)) < 2.0**61)
    x = np.where(usable, c, 0).astype(np.int64)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~usable)])
    whole = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - lengths])
    return [x[e - k : e] if ok else None for e, k, ok in zip(ends, lengths, whole)]


def packed(x: np.ndarray) -> bytes:
    """Equal vectors give equal bytes: the fewest bytes an entry, which the first byte names."""
    reach = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
    width = next(w for w in (1, 2, 4, 8) if reach < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpacked(keys: list[bytes]) -> np.ndarray:
    """Vectors of one length, as rows."""
    return np.stack([np.frombuffer(k, f"<i{k[0]}", offset=1).astype(np.int64) for k in keys])


def fit_list(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """(dims, x): each distinct vector once."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = {packed(x): len(x) for x in quantised(batch.column(0), scale) if x is not None}
            yield pa.RecordBatch.from_arrays([pa.array(xs.values(), pa.int32()), pa.array(xs.keys(), pa.binary())], ["dims", "x"])

    plain = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return durable(plain.mapInArrow(keys, "dims int, x binary").dropDuplicates(["x"]), "fit-list")


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(dimensions, rows) of a batch of the fit list, ``ROWS`` at a time."""
    dims = np.asarray(batch.column("dims"))
    keys = batch.column("x").to_pylist()
    for d in np.unique(dims[dims > 0]):
        mine = [keys[i] for i in np.flatnonzero(dims == d)]
        for at in range(0, len(mine), ROWS):
            yield int(d), unpacked(mine[at : at + ROWS])


def limbs(value: int) -> list[int]:
    """Base 2^40 digits; the last carries the sign."""
    digits = [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)]
    return [*digits, value >> (LIMB * (LIMBS - 1))]


def added(fit: DataFrame, sums_of) -> dict[int, list[int]]:
    """Exact sums over the fit list of ``sums_of(dims, rows)``, a list of whole numbers, per vector length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for d, x in by_length(batch):
                new = sums_of(d, x)
                totals[d] = [a + b for a, b in zip(totals[d], new)] if d in totals else new
        for d, values in totals.items():
            digits = np.array([limbs(v) for v in values], np.int64).reshape(-1, LIMBS)
            columns = [pa.array(np.full(len(values), d, np.int32)), pa.array(np.arange(len(values), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(digits[:, i].copy()) for i in range(LIMBS)]], ["dims", "at", *names])

    names = [f"limb{i}" for i in range(LIMBS)]
    schema = "dims int, at int, " + ", ".join(f"{c} long" for c in names)
    total = fit.mapInArrow(partial, schema).groupBy("dims", "at").agg(*[F.sum(c).alias(c) for c in names])
    found: dict[int, dict[int, int]] = {}
    for row in total.collect():  # a number per dimension or pair of dimensions
        found.setdefault(row["dims"], {})[row["at"]] = sum(row[c] << (LIMB * i) for i, c in enumerate(names))
    return {d: [v for _, v in sorted(values.items())] for d, values in found.items()}


def squares(y: np.ndarray) -> list[int]:
    """Sums of squares of every dimension and of every sum of two, in the order (0, 0), (0, 1), ..., (1, 1), ...; the
    entry (i, i) is that of dimension i itself."""
    reach = int(np.abs(y).max(initial=0))
    if (2 * reach) ** 2 * len(y) >= 2**63:
        y = y.astype(object)
    found: list[int] = []
    for i in range(y.shape[1]):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        found += [int(v) for v in (both * both).sum(axis=0)]
    return found


def covariance(n: int, rest: np.ndarray, sums: list[int]) -> np.ndarray:
    """From sums of squares centred by the rounded mean; ``rest`` is what rounding left. Each entry is rounded once."""
    d = len(rest)
    rest = [int(r) for r in rest]
    at = lambda i, j: i * d - i * (i - 1) // 2 + j - i
    alone = [n * sums[at(i, i)] - rest[i] ** 2 for i in range(d)]  # n^2 times the variance
    cov = np.zeros((d, d))
    for i in range(d):
        cov[i, i] = alone[i] / n**2
        for j in range(i + 1, d):
            both = n * sums[at(i, j)] - (rest[i] + rest[j]) ** 2
            cov[i, j] = cov[j, i] = (both - alone[i] - alone[j]) / (2 * n**2)
    return cov


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each vector length of the fit list."""
    counts = dict(fit.groupBy("dims").count().where("dims > 0").collect())  # a row per vector length
    sums = added(fit, lambda d, x: [int(v) for v in exact(x).sum(axis=0)])
    near = {d: centres(counts[d], sums[d]) for d in counts}
    squared = added(fit, lambda d, x: squares(x - near[d][0]))
    models = {}
    for d, n in counts.items():
        cov = covariance(n, near[d][1], squared[d])
        values, axes = np.linalg.eigh(cov)
        order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > RANK * max(values.max(), 0)]
        total = np.trace(cov)
        models[d] = Whitener(n, sums[d], values[order], axes[:, order], values[order] / total if total else values[order])
    return models


def exact(x: np.ndarray) -> np.ndarray:
    """As unbounded integers where a sum of the rows could pass 64 bits."""
    return x.astype(object) if int(np.abs(x).max(initial=0)) * len(x) >= 2**63 else x


def identity_errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """Largest entry of the whitened fit list's covariance minus the identity, measured over all of it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in by_length(batch):
                w = models[d].whitened(x)
                totals[d] = totals.get(d, 0) + np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        for d, values in totals.items():
            columns = [pa.array(np.full(len(values), d, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "at", "value"])

    found = {d: np.zeros(len(m.values) * (len(m.values) + 1)) for d, m in models.items()}
    for r in fit.mapInArrow(partial, "dims int, at int, value double").groupBy("dims", "at").agg(F.sum("value").alias("value")).collect():
        found[r["dims"]][r["at"]] = r["value"]  # components squared, per vector length
    errors = {}
    for d, model in models.items():
        k = len(model.values)
        mean = found[d][k * k :] / model.n
        errors[d] = float(np.abs(found[d][: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return errors


def whiten(vectors: DataFrame, *, vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Rows of ``vectors`` with n, deviation, whitened (an array, by component), explained (likewise) and identity_error.

    Defined cases: a vector that is null, or has an entry that is null, not finite or too large for a long, is dropped;
    copies of a vector are fitted once and all get results; vectors of another length are fitted among themselves; an
    empty vector, and vectors that are all equal, have no components and get empty arrays; components without variance
    are left out, so there are as many as the fit list spans at most; deviation is null where no long holds it; columns
    named like one added here are replaced.
    """
    fit = fit_list(vectors, vector, scale)
    models = fitted(fit, components)
    errors = identity_errors(fit, models)
    rows = without(vectors, *OWN)
    names = [f"_{i}" for i in range(len(rows.columns))]
    entries = vectors.select(*[vectors[f"`{c}`"] for c in rows.columns], vectors[f"`{vector}`"].cast("array<double>")).toDF(*names, "_v")
    results = "_n long, _deviation long, _whitened array<double>, _explained array<double>, _identity_error double"
    schema = StructType([*entries.schema.fields[:-1], *StructType.fromDDL(results).fields])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = quantised(batch.column("_v"), scale)
            keep = [i for i, x in enumerate(xs) if x is not None]
            # a vector without entries has no components, and is alone in its fit list
            found = {i: (1, 0, [], [], 0.0) for i in keep}
            for d in {len(xs[i]) for i in keep} - {0}:
                model, at = models[d], [i for i in keep if len(xs[i]) == d]
                x = np.stack([xs[i] for i in at])
                shares, error = model.explained.tolist(), errors[d]
                for i, far, w in zip(at, model.deviations(x), model.whitened(x)):
                    found[i] = (model.n, far, w, shares, error)
            columns = [pa.array([found[i][c] for i in keep], kind) for c, kind in enumerate(ARROW)]
            kept = batch.take(pa.array(keep, pa.int64())).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *columns], schema.names)

    return entries.mapInArrow(projected, schema).toDF(*rows.columns, *OWN)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(read(spark, sf_dir, "embeddings"))
    entries = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "entry")
    return rows.select("vec_id", "n", "deviation", "identity_error", entries).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("entry.whitened").alias("whitened"),
        F.col("entry.explained").alias("explained"),
        "identity_error",
    )
