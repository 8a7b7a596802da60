"""Near-duplicate embeddings: exact pairs above a cosine by dual traversal of cover trees.

Vectors are scaled to length one, where a cosine of 0.98 is a distance of 0.2. Only vectors of one label and dimension
are compared. Equal vectors are one point with a weight. The top level of the tree is made by Spark: a bounded set of
pivots, each point in the cell of its nearest; cells above ``CELL`` points are split by a hash, so no task holds more
than two cells however many points lie in one place. Two cells are compared unless their covering radii rule it out.
Inside a task, each cell becomes a cover tree with halving radii; node pairs farther apart than their radii and the
threshold allow are pruned, node pairs that lie wholly within it are counted without looking at their points, and the
rest is compared point by point in double precision.

A task returns counts of links and a spanning forest, never the pairs; components follow from the forests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, spread_join, without
from .components import components

COSINE = 0.98
#: Points of a cell, at most.
CELL = 2048
#: Pivots of all labels together, at most some more by chance; they are held by every task.
PIVOTS = 1024
LEAF = 24
MARGIN = 1e-9
OWN = ("n_links", "component_id", "kept")


class Node:
    __slots__ = ("points", "center", "radius", "children")

    def __init__(self, points: np.ndarray, center: int, radius: float):
        self.points, self.center, self.radius = points, center, radius
        self.children: list[Node] = []


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def cover_tree(x: np.ndarray) -> Node:
    """Nested levels: the children of a node cover its points with half its radius, the first with the same center."""
    everything = np.arange(len(x))
    root = Node(everything, 0, float(distances(x, x[:1]).max()))
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node.points) <= LEAF or node.radius <= MARGIN:
            continue
        left, center, half = node.points, node.center, node.radius / 2
        while len(left):
            far = distances(x[left], x[center : center + 1])[:, 0]
            inside = far <= half
            inside |= left == center
            child = Node(left[inside], center, float(far[inside].max()))
            node.children.append(child)
            stack.append(child)
            left = left[~inside]
            center = int(left[0]) if len(left) else -1
    return root


class Links:
    """Weighted counts of the links of two sides, and edges that span them."""

    def __init__(self, n: int, m: int):
        self.left, self.right = np.zeros(n, np.int64), np.zeros(m, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> None:
        i, j = np.nonzero(linked)
        if len(i):
            self.left[a] += linked @ wb[b]
            self.right[b] += linked.T @ wa[a]
            self.edges.append((a[i], b[j]))

    def add_all(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> None:
        self.left[a] += wb[b].sum()
        self.right[b] += wa[a].sum()
        self.edges.append((a, np.full(len(a), b[0])))
        self.edges.append((np.full(len(b), a[0]), b))


def dual_traversal(x: np.ndarray, y: np.ndarray, wa: np.ndarray, wb: np.ndarray, cosine: float, trees: tuple[Node, Node]) -> Links:
    """All links between two sets of unit vectors; for a set with itself, each point also meets itself."""
    reach = float(np.sqrt(2 - 2 * cosine))
    found = Links(len(x), len(y))
    stack = [trees]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            found.add(a.points, b.points, x[a.points] @ y[b.points].T >= cosine, wa, wb)
            continue
        # singletons met side by side are compared in one product
        ones = [[n for n in side.children if len(n.points) == 1] for side in (a, b)]
        if ones[0] and ones[1]:
            p, q = (np.array([n.center for n in side]) for side in ones)
            found.add(p, q, x[p] @ y[q].T >= cosine, wa, wb)
        left, right = a.children or [a], b.children or [b]
        far = distances(x[[n.center for n in left]], y[[n.center for n in right]])
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        both = np.outer([len(n.points) == 1 and n is not a for n in left], [len(n.points) == 1 and n is not b for n in right])
        near = (far <= reach + ra[:, None] + rb[None] + MARGIN) & ~both
        within = near & (far + ra[:, None] + rb[None] <= reach - MARGIN)
        for i, j in zip(*np.nonzero(within), strict=True):
            found.add_all(left[i].points, right[j].points, wa, wb)
        stack.extend((left[i], right[j]) for i, j in zip(*np.nonzero(near & ~within), strict=True))
    return found


def forest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest point that each of n points is connected with."""
    label = np.arange(n)
    if not edges:
        return label
    a, b = (np.concatenate(side) for side in zip(*edges, strict=True))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list column, in double precision, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def assigner(pivots: dict[str, np.ndarray]) -> Callable:
    """Adds to (group, dimension, point, weight, vector) the cell of the nearest pivot and the distance to it."""

    def assign(batches):
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            cell, far = np.full(len(groups), -1, np.int32), np.full(len(groups), 2.0)
            for group in set(groups):
                if group in pivots:
                    rows = np.flatnonzero(groups == group)
                    known = pivots[group]
                    away = distances(matrix(batch.column(4).take(pa.array(rows)), known.shape[1]), known)
                    cell[rows] = away.argmin(axis=1)
                    far[rows] = away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return assign


def compared(cosine: float) -> Callable:
    """Of the points of two cells (side 0 and 1; one cell with itself has side 0 only): links of each and its root."""

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        points = table["point"].combine_chunks()
        dimension = table["dimension"][0].as_py()
        vectors, weight = matrix(table["vector"], dimension), table["weight"].to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        itself = not len(two)
        two = one if itself else two
        x, y = vectors[one], vectors[two]
        tree = cover_tree(x)
        links = dual_traversal(x, y, weight[one], weight[two], cosine, (tree, tree if itself else cover_tree(y)))
        counts = np.zeros(len(side), np.int64)
        counts[one] += links.left
        if not itself:
            counts[two] += links.right
        root = forest(len(side), [(one[a], two[b]) for a, b in links.edges])
        told = np.flatnonzero(counts > 0)
        return pa.table(
            {"point": points.take(pa.array(told)), "links": counts[told], "root": points.take(pa.array(root[told]))},
            schema=pa.schema([("point", pa.string()), ("links", pa.int64()), ("root", pa.string())]),
        )

    return compare


def link_counts(points: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(point, links, root) per compared pair of cells, from (group, dimension, point, weight, vector). ``links`` counts
    weights and includes the point's own weight, met once."""
    points = durable(points, "points")
    sizes = points.groupBy("group").count()
    total = points.count()
    share = min(1 / cell, PIVOTS / max(total, 1))
    large = sizes.where(F.col("count") > cell).select("group")
    drawn = F.pmod(F.xxhash64("point"), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = points.join(large, "group").where(drawn).select("group", "dimension", "vector").limit(4 * PIVOTS).collect()
    pivots: dict[str, list] = {}
    for row in sorted(sample, key=lambda r: (r["group"], r["vector"])):
        pivots.setdefault(row["group"], []).append(row["vector"])
    known = {g: matrix(pa.array(v, pa.list_(pa.float64())), len(v[0])) for g, v in pivots.items()}
    celled = durable(
        points.mapInArrow(assigner(known), "group string, dimension int, point string, weight bigint, vector array<double>, cell int, far double"), "cells"
    )
    cells = celled.groupBy("group", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = durable(cells.withColumn("parts", F.ceil(F.col("n") / cell).cast("int")), "cell-sizes")
    salt = F.pmod(F.xxhash64("point"), F.col("parts")).cast("int")
    celled = durable(celled.join(cells.select("group", "cell", "parts"), ["group", "cell"]).withColumn("part", salt).drop("parts"), "parts")

    between = [
        (group, i, j, float(away))
        for group, centers in known.items()
        for i, row in enumerate(distances(centers, centers))
        for j, away in enumerate(row)
        if i <= j
    ]
    # cells without a pivot are their whole group
    spark = points.sparkSession
    given = spark.createDataFrame(between, "group string, cell_a int, cell_b int, away double")
    alone = cells.where("cell = -1").select("group", F.col("cell").alias("cell_a"), F.col("cell").alias("cell_b"), F.lit(0.0).alias("away"))
    side = lambda s: cells.select("group", F.col("cell").alias(f"cell_{s}"), F.col("radius").alias(f"radius_{s}"), F.col("parts").alias(f"parts_{s}"))
    reach = float(np.sqrt(2 - 2 * cosine))
    pairs = (
        given.unionByName(alone)
        .join(side("a"), ["group", "cell_a"])
        .join(side("b"), ["group", "cell_b"])
        .where(F.col("away") <= F.col("radius_a") + F.col("radius_b") + reach + MARGIN)
        .withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        .where((F.col("cell_a") < F.col("cell_b")) | (F.col("part_a") <= F.col("part_b")))
    )
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))
    pairs = durable(pairs.select("group", "cell_a", "part_a", "cell_b", "part_b", same.alias("same")), "cell-pairs")
    pair = ["group", "cell_a", "part_a", "cell_b", "part_b"]
    first = pairs.select(*pair, F.lit(0).alias("side"), F.col("cell_a").alias("cell"), F.col("part_a").alias("part"))
    second = pairs.where("not same").select(*pair, F.lit(1).alias("side"), F.col("cell_b").alias("cell"), F.col("part_b").alias("part"))
    dealt = celled.join(first.unionByName(second), ["group", "cell", "part"]).select(*pair, "side", "dimension", "point", "weight", "vector")
    return dealt.groupBy(*pair).applyInArrow(compared(cosine), "point string, links bigint, root string")


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """``vectors`` with n_links, component_id and kept.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
    label, link with nothing and are components of their own; equal vectors link; vectors of different dimension do not;
    equal rows are rows of their own; a null key is kept; columns named like one added here are replaced.
    """
    rows = without(vectors, *OWN)
    body = F.col(f"`{vector}`")
    bad = F.exists(body, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = body.isNotNull() & F.col(f"`{label}`").isNotNull() & (F.size(body) > 0) & ~bad & F.exists(body, lambda v: v != 0)
    name = F.concat_ws(":", F.col(f"`{label}`").cast("string"), F.hex(F.xxhash64(body, F.lit(1))), F.hex(F.xxhash64(F.lit(2), body)))
    rows = rows.withColumn("_point", F.when(F.coalesce(usable, F.lit(False)), name))
    points = durable(
        rows.where("_point IS NOT NULL")
        .groupBy("_point")
        .agg(
            F.count("*").alias("_weight"),
            F.any_value(body).alias("_v"),
            F.any_value(F.col(f"`{label}`").cast("string")).alias("_label"),
            F.min(F.col(f"`{key}`")).alias("_key"),
        ),
        "distinct",
    )
    compared_points = points.select(
        F.concat_ws(":", "_label", F.size("_v").cast("string")).alias("group"),
        F.size("_v").alias("dimension"),
        F.col("_point").alias("point"),
        F.col("_weight").alias("weight"),
        F.col("_v").cast("array<double>").alias("vector"),
    )
    found = durable(link_counts(compared_points, cosine, cell), "links")
    counts = found.groupBy("point").agg(F.sum("links").alias("_links")).withColumnRenamed("point", "_counted")
    groups = components(found.where("point != root").select(F.col("point").alias("a"), F.col("root").alias("b")))
    # a row per point: neither its copies nor the points of its component meet in one task
    points = points.join(counts, F.col("_point") == F.col("_counted"), "left").join(groups, F.col("_point") == F.col("node"), "left")
    points = durable(points.select("_point", "_weight", "_key", "_links", F.coalesce("component", "_point").alias("_component")), "linked")
    least = points.groupBy("_component").agg(F.min("_key").alias("_least"), F.count("*").alias("_points"))
    points = spread_join(points, durable(least, "components"), "_component", "_points", F.xxhash64("_point"))
    points = durable(points.select("_point", "_weight", "_links", "_least"), "placed")
    placed = spread_join(rows, points, "_point", "_weight", F.xxhash64(F.col(f"`{key}`")))
    component = F.when(F.col("_point").isNull(), F.col(f"`{key}`")).otherwise(F.col("_least"))
    return (
        placed.withColumns({"n_links": F.coalesce(F.col("_links") - 1, F.lit(0)).cast("long"), "component_id": component})
        .withColumn("kept", F.coalesce(F.col(f"`{key}`") == F.col("component_id"), F.lit(True)))
        .drop("_point", "_links", "_least")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings")).select("vec_id", *OWN)
