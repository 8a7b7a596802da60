"""How filters interact: what each removes at every step of every order in which they may run.

Five filters fail a document or not, so all there is to know about a part of the corpus is its contingency table: how
many documents have each of the 32 combinations of failures. The table, reshaped to 2 x 2 x 2 x 2 x 2 with a trailing
axis of measures (documents, good ones, toxic ones), answers every question by a contraction: along the axis of a
filter select pass (it ran before), fail (it removes here) or all (it did not run yet).

The corpus is read once; a document leaves that scan as a text digest, an id, its part and four failures. The fifth
filter (a text that a smaller id has too) needs the smallest id of each digest: that is an aggregate, and the first
document of a text is found by joining (digest, id) to (digest, smallest id). No join or group is keyed by the digest
alone, so thousands of copies of one text spread by their ids, and rows equal in both are counted before they move.
Labels meet rows already counted per (id, part, failures).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, durable, read

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
#: Parts whose tables are contracted together: 600 rows of seven counts each.
PARTS = 256
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: Column) -> Column:
    """Failures of the filters A to D, as bits 0 to 3, of a text without nulls."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.transform(
        F.array(words),  # a lambda's argument is computed once
        lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
        + F.when(F.size(F.array_distinct(w)) * 100 < F.size(w) * 50, 2).otherwise(0)
        + F.when(F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 2, 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0),
    )[0]


def failure_table(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, cell, docs, good, toxic): documents per part and combination of failures, bit i of ``cell`` for filter i."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    seen = docs.select(
        F.sha2(body, 256).alias("digest"),
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        text_failures(body).alias("cell"),
    )
    seen = durable(seen.groupBy("digest", "id", "part", "cell").agg(F.count("*").alias("n")), "failures")
    firsts = seen.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    copies = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    by_id = (
        seen.join(firsts, ["digest", "id"], "left")
        .withColumn("cell", F.col("cell") + copies)
        .groupBy("id", "part", "cell")
        .agg(F.sum("n").alias("n"))
    )
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    return (
        by_id.join(said.where("id IS NOT NULL AND (is_good OR is_toxic)"), "id", "left")
        .groupBy("part", "cell")
        .agg(
            F.sum("n").alias("docs"),
            F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def selectors() -> dict[str, np.ndarray]:
    """For each quantity an array (orders * steps, 5, 2): what to select along each filter's axis (pass, fail)."""
    passes, fails, all_ = (1, 0), (0, 1), (1, 1)
    rows = [(order, step) for order in ORDERS for step in range(5)]
    here = np.array([[FILTERS.index(order[step]) == a for a in range(5)] for order, step in rows])
    before = np.array([[FILTERS[a] in order[:step] for a in range(5)] for order, step in rows])
    pick = lambda at_here, at_before, else_: np.where(
        here[..., None], at_here, np.where(before[..., None], at_before, else_)
    ).astype(np.int64)
    return {
        "kept": pick(passes, passes, all_),
        "removed": pick(fails, passes, all_),
        "fails": pick(fails, all_, all_),
        "unique_fails": pick(fails, passes, passes),
    }


def contracted(tensors: np.ndarray, selector: np.ndarray) -> np.ndarray:
    """(part, row, measure) from tables (part, 2, 2, 2, 2, 2, measure)."""
    axes = [selector[:, a] for a in range(5)]
    return np.einsum("pabcdem,ra,rb,rc,rd,re->prm", tensors, *axes, optimize="greedy")


def audit_rows(parts: list[str], tensors: np.ndarray) -> pd.DataFrame:
    """The 600 rows of each part."""
    sums = {name: contracted(tensors, selector) for name, selector in selectors().items()}
    letter = np.array([FILTERS.index(order[step]) for order in ORDERS for step in range(5)])
    removed = sums["removed"]
    per_filter = np.stack([removed[:, letter == f, 0].sum(axis=1) for f in range(5)], axis=1)
    rows = len(letter)
    return pd.DataFrame(
        {
            "part": np.repeat(np.array(parts, object), rows),
            "filter_order": np.tile(np.repeat(np.array(ORDERS, object), 5), len(parts)),
            "step": np.tile(np.arange(1, 6, dtype=np.int32), rows // 5 * len(parts)),
            "kept": sums["kept"][..., 0].ravel(),
            "removed": removed[..., 0].ravel(),
            "redundant": (sums["fails"] - removed)[..., 0].ravel(),
            "unique_fails": sums["unique_fails"][..., 0].ravel(),
            "good_lost": removed[..., 1].ravel(),
            "toxic_lost": removed[..., 2].ravel(),
            "shapley": per_filter[:, letter].ravel(),
        }
    )


def audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), PARTS):
            some = batch.iloc[at : at + PARTS]
            tensors = np.zeros((len(some), 32, 3), np.int64)
            for i, cells in enumerate(some["cells"]):
                for cell in cells:
                    tensors[i, cell["cell"]] = cell["docs"], cell["good"], cell["toxic"]
            # bit 0 is the fastest axis of a reshape: turn it to be the first filter's
            tensors = tensors.reshape(-1, 2, 2, 2, 2, 2, 3).transpose(0, 5, 4, 3, 2, 1, 6)
            yield audit_rows(some["part"].tolist(), tensors)


def filter_audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Defined cases: a null text is empty and a null part the empty string, together with those that are empty; a null id
    is smaller than none and larger than none, so its row never fails E, nor has it labels; rows equal in id and text
    both are the first of their text, or neither; a document is good (toxic) if any of its label rows says so; an empty
    table has no parts and no rows; other columns of the inputs are not read.
    """
    cells = F.collect_list(F.struct("cell", "docs", "good", "toxic")).alias("cells")  # at most 32 a part
    tables = failure_table(docs, labels, key=key, text=text, part=part).groupBy("part").agg(cells)
    return tables.mapInPandas(audited, SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: The contract by definition: documents that fail, counted order by order.
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
           FROM labels GROUP BY doc_id),
     f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                  || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                  || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS failed
           FROM w LEFT JOIN l USING (doc_id)),
     c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
     a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier
           FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, x,
                  sum(CASE WHEN NOT contains(failed, x) AND translate(failed, earlier, '') = failed THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN contains(failed, x) AND translate(failed, earlier, '') = failed THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN contains(failed, x) AND translate(failed, earlier, '') <> failed THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN contains(failed, x) AND translate(failed, earlier, '') = failed THEN good ELSE 0 END) AS good_lost,
                  sum(CASE WHEN contains(failed, x) AND translate(failed, earlier, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
           FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
