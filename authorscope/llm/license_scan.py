"""License scan: an exact set-similarity join of text blocks with license templates.

A template is the set of words of a known notice. A block is a window of twice the notice's words, beginning at every
multiple of its length, so that every place where a notice may stand lies inside one. A block matches if it holds at
least ``THRESHOLD`` per cent of the template's words. All blocks that do are found:

- words of templates are ordered by the number of documents that hold them, rarest first, over all documents;
- prefix: a template of t words of which n must occur shares one of its t - n + 1 rarest with every matching block, and
  so does the block with its own; only occurrences of such words are expanded and joined;
- length: a block with fewer than n words known to any template is passed over;
- position: the first word common to both at places i and j leaves at most 1 + min(t - i - 1, b - j - 1) common words.

What is left is compared exactly. A phrase is a template all of whose words must stand in a row: its rarest word is its
prefix, and the words around it are compared in order.

A text is cut into pieces of ``PIECE`` words, each with the words around it that a block or phrase may reach, so that an
occurrence carries a piece, not its text: a text made of nothing but such words costs its length, not the square of it.

The join index holds the prefix words of the templates; as the templates are a list of the caller's its size is known
and it is broadcast below ``BROADCAST_BYTES``, else shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, without

#: A word of the contract, A-Z already folded.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's distinct words that a block must hold, per cent.
THRESHOLD = 90
#: Words of a piece, without those around it.
PIECE = 256
BROADCAST_BYTES = 8 << 20
OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
KEY = ("_id", "_text_hash")

#: Phrases of the contract with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Notices as their licenses word them.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
]


@dataclass(frozen=True)
class Template:
    """``words`` in their order; ``phrase`` if they must stand in a row."""

    label: str
    words: tuple[str, ...]
    phrase: bool

    @property
    def needed(self) -> int:
        """Distinct words a block must hold."""
        distinct = len(set(self.words))
        return distinct if self.phrase else -(-THRESHOLD * distinct // 100)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def templates(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = TEMPLATES) -> list[Template]:
    """Phrases and notices; one without words can't be met and is left out."""
    made = [Template(label, words_of(text), True) for label, text in phrases]
    made += [Template(label, words_of(text), False) for label, text in notices]
    return [t for t in made if t.words]


def folded_words(text: Column) -> Column:
    """Words with A-Z folded; none for null. Lower-casing folds more than A-Z, but no letter outside ASCII into a
    letter inside it, save the Kelvin sign: it is put out of the way first, so words equal a template's iff they should."""
    lowered = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u2126")))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_order(words: DataFrame, known: list[str]) -> list[str]:
    """The known words, those of fewest documents first. The result has a row per known word, whatever the documents."""
    vocabulary = F.array(*[F.lit(w) for w in known])
    counts = words.select(F.explode(F.array_intersect(F.col("_words"), vocabulary)).alias("word")).groupBy("word").count()
    counted = dict(counts.collect())  # at most len(known) rows
    return sorted(known, key=lambda w: (counted.get(w, 0), w))


def prefix_index(spark: SparkSession, known: list[Template], order: list[str]) -> tuple[DataFrame, list[str]]:
    """A row per prefix word of a template, and the prefix words."""
    rank = {w: i for i, w in enumerate(order)}
    rows, size = [], 0
    for number, t in enumerate(known):
        ordered = sorted(set(t.words), key=rank.__getitem__)
        for i, word in enumerate(ordered[: len(ordered) - t.needed + 1]):
            rows.append((word, number, t.label, t.phrase, i, t.words.index(word), len(t.words), t.needed, ordered, list(t.words)))
            size += 200 + 2 * sum(len(w.encode()) + 16 for w in t.words)
    columns = "word string, template int, label string, phrase boolean, i int, offset int, m int, needed int, ordered array<string>, phrase_words array<string>"
    index = spark.createDataFrame(rows, columns)
    return (F.broadcast(index) if size <= BROADCAST_BYTES else index), sorted({r[0] for r in rows})


def pieces(words: DataFrame, reach: int) -> DataFrame:
    """(_id, _text_hash, n_words, first, before, words): the words of a piece, from word ``first`` of the text on, with
    ``reach`` words on either side; ``before`` of them, fewer at the beginning of a text, come first. A text without
    words has an empty piece."""

    def piece(at: Column) -> Column:
        before = F.least(at, F.lit(reach))
        around = F.slice("_words", at - before + 1, F.lit(PIECE + reach) + before)
        return F.struct(at.alias("first"), before.alias("before"), around.alias("words"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)), F.lit(PIECE))
    return words.select(*KEY, F.size("_words").alias("n_words"), F.inline(F.transform(starts, piece)))


def block_share(number: Column, vocabulary: Column) -> Column:
    """Share of the template's words in the block of that number, null if below the threshold or passed over."""
    block = F.slice("words", number * F.col("m") - F.col("first") + F.col("before") + 1, F.col("m") * 2)
    return F.transform(
        F.array(F.array_intersect(vocabulary, block)),  # the block's known words, rarest first
        lambda held: F.when(
            (F.size(held) >= F.col("needed"))
            & (F.array_position(held, F.col("word")) <= F.size(held) - F.col("needed") + 1)
            & (
                F.least(F.size("ordered") - F.col("i") - 1, F.size(held).cast("long") - F.array_position(held, F.col("word"))) + 1
                >= F.col("needed")
            ),
            F.transform(
                F.array(F.size(F.array_intersect(F.col("ordered"), held))),
                lambda common: F.when(common >= F.col("needed"), common / F.size("ordered")),
            )[0],
        ),
    )[0]


def matches(words: DataFrame, known: list[Template]) -> DataFrame:
    """(_id, _text_hash, n_words, template, label, place, share) of phrases, which have a place, and of templates that a
    block matches; and a row without a label for each document."""
    order = word_order(words, sorted({w for t in known for w in t.words}))
    index, prefixes = prefix_index(words.sparkSession, known, order)
    places = F.filter(
        F.transform(
            F.slice("words", F.col("before") + 1, F.lit(PIECE)),
            lambda w, i: F.struct(w.alias("word"), (F.col("first") + i).alias("at")),
        ),
        lambda p: p["word"].isin(prefixes),
    )
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("at")))
    cut = pieces(words, 2 * max((len(t.words) for t in known), default=0))
    found = cut.select(*KEY, "n_words", "first", "before", "words", F.inline(F.concat(places, nothing))).join(index, "word", "left")
    vocabulary = F.array(*[F.lit(w) for w in order])
    start = F.col("at") - F.col("offset")
    inside = F.greatest(start - F.col("first") + F.col("before"), F.lit(0))  # a piece begins with its text, or far enough before
    stands = (start >= 0) & (F.slice("words", inside + 1, F.col("m")) == F.col("phrase_words"))
    number = F.floor(F.col("at") / F.col("m")).cast("int")
    shares = F.array(block_share(number, vocabulary), F.when(number > 0, block_share(F.greatest(number - 1, F.lit(0)), vocabulary)))
    share = F.when(F.col("phrase"), F.when(stands, 1.0)).when(F.col("label").isNotNull(), F.array_max(shares))
    return (
        found.select(
            *KEY, "n_words", "template", "label", F.when(F.col("phrase"), start).alias("place"), share.alias("share"), "at"
        )
        .where("share IS NOT NULL OR at IS NULL")
        .drop("at")
        .distinct()
    )


def license_scan(docs: DataFrame, known: list[Template] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base, first_word and last_word count and bound the places of phrases; labels are those of phrases and of matching
    blocks; score is the largest share of a template that a block holds, 1 for a phrase, 0 if nothing matches. Defined
    cases: a null or empty text has no words, no places, empty labels and score 0; equal rows get equal results; an
    empty table gives an empty table; without templates nothing matches; columns named like one added here are replaced.
    """
    known = templates() if known is None else known
    words = docs.select(
        F.col(f"`{key}`").alias("_id"), F.xxhash64(f"`{text}`").alias("_text_hash"), folded_words(F.col(f"`{text}`")).alias("_words")
    )
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = (
        matches(words, known)
        .groupBy(*KEY)
        .agg(
            F.max("n_words").cast("long").alias("_n_words"),
            F.count("place").alias("_n_base"),
            F.min("place").cast("long").alias("_first_word"),
            F.max("place").cast("long").alias("_last_word"),
            joined(F.when(F.col("place").isNotNull(), F.col("label"))).alias("_base_labels"),
            joined("label").alias("_labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("_score"),
        )
        .withColumnsRenamed({"_id": "_found_id", "_text_hash": "_found_text_hash"})
    )
    rows = without(docs, *OWN).withColumn("_text_hash", F.xxhash64(f"`{text}`"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_found_id")) & (F.col("_text_hash") == F.col("_found_text_hash"))
    return (
        rows.join(found, same, "left")
        .withColumnsRenamed({f"_{c}": c for c in OWN})
        .drop("_text_hash", "_found_id", "_found_text_hash")
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).select("doc_id", *OWN)


def _listed(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: By definition: every place of every phrase, every block against every template.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
           FROM documents),
     p AS (SELECT * FROM (VALUES @phrases) AS v(label, p)),
     t AS (SELECT *, len(words) AS t FROM (VALUES @templates) AS v(label, m, needed, words)),
     b AS (SELECT rid, label, i FROM (SELECT rid, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, p) WHERE w[i:i + len(p) - 1] = p),
     k AS (SELECT rid, w, label, m, needed, t, words, unnest(range(0, (len(w) + m - 1) // m)) AS k FROM d, t),
     s AS (SELECT rid, label, share FROM
             (SELECT rid, label, needed, t, len(list_intersect(words, w[k * m + 1:k * m + 2 * m])) AS common, common / t AS share FROM k)
           WHERE common >= needed),
     ba AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word,
                   array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM b GROUP BY rid),
     al AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
            FROM (SELECT rid, label, CAST(1 AS DOUBLE) AS share FROM b UNION ALL SELECT * FROM s) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN ba USING (rid) LEFT JOIN al USING (rid)
""".replace("@phrases", ", ".join(f"('{t.label}', {_listed(t.words)})" for t in templates(notices=[]))).replace(
    "@templates",
    ", ".join(f"('{t.label}', {len(t.words)}, {t.needed}, {_listed(sorted(set(t.words)))})" for t in templates(phrases=[])),
)
