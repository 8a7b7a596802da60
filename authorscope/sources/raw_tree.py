"""Read raw directory trees that the executors can reach (a shared mount), one row per repository root.

The built-in file source drops names that start with a dot or underscore, which are the ones marker rules look for.

Listing goes in rounds. A task walks down from each folder it is given until it has met ``ENTRIES`` entries and returns
the folders it did not come to; the next round deals those out to all tasks. A small tree takes one round and one task,
a large one is soon spread over all of them, and each round is written, so a lost executor repeats its folders only.
Ignored and hidden folders are never entered. Contents are read file by file: the head first, the rest only if the head
is text, and rows leave a task whenever ``BATCH_BYTES`` have been read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..operators.intake import KEPT_HIDDEN_DIRECTORIES, NON_TEXT_BYTES, decode_text, ignore_regex, looks_binary, negates, select_files
from ..plans.durable import durable
from ..schema import RAW_FILES_SCHEMA

#: Entries a task meets below one folder before it hands the rest back.
ENTRIES = 5000
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
LISTING_SCHEMA = "repo string, root string, path string, size bigint, unread boolean"
LISTED = LISTING_SCHEMA.replace(" bigint", "").replace(" string", "").replace(" boolean", "").split(", ")


def below(root: str, folder: str, enters, entries: int = ENTRIES) -> Iterator[tuple[str, int | None, bool]]:
    """(path, size, False) of files below a folder, and (path, None, True) of folders not come to."""
    waiting, met = [folder], 0
    while waiting:
        here = waiting.pop()
        if met >= entries:
            yield here, None, True
            continue
        try:
            listing = os.scandir(os.path.join(root, here) if here else root)
        except OSError:
            continue
        with listing:
            for entry in listing:
                met += 1
                path = f"{here}/{entry.name}" if here else entry.name
                try:
                    if entry.is_dir():
                        if not entry.is_symlink() and enters(path, entry.name):
                            waiting.append(path)
                    else:
                        yield path, entry.stat().st_size, False
                except OSError:
                    continue


def list_trees(roots: DataFrame, config: ScoringConfig = DEFAULT, entries: int = ENTRIES) -> DataFrame:
    """(repo, root, path, size) of the files below each root; hidden and ignored directories are not entered. ``roots``
    has ``repo`` and ``root``."""
    # a later negated pattern may take back a file below an ignored folder
    pruned = None if negates(config.ignore_patterns) else ignore_regex(config.ignore_patterns).replace("\\z", "\\Z")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skips = re.compile(pruned) if pruned else None

        def enters(path: str, name: str) -> bool:
            hidden = name.startswith(".") and name.lower() not in KEPT_HIDDEN_DIRECTORIES
            return not hidden and not (skips and skips.search(path + "/"))

        for batch in batches:
            for repo, root, folder in zip(batch["repo"], batch["root"], batch["path"]):
                found = []
                for path, size, unread in below(root, folder, enters, entries):
                    found.append((repo, root, path, size, unread))
                    if len(found) >= BATCH_ROWS:
                        yield pd.DataFrame(found, columns=LISTED)
                        found = []
                yield pd.DataFrame(found, columns=LISTED)

    waiting = roots.select("repo", "root", F.lit("").alias("path"))
    rounds = []
    while True:
        found = durable(waiting.repartition("repo", "path").mapInPandas(walk, LISTING_SCHEMA), "listing")
        rounds.append(found.where("NOT unread").drop("unread"))
        waiting = found.where("unread").drop("size", "unread")
        if not waiting.limit(1).count():
            return reduce(DataFrame.unionByName, rounds)


def text_of_file(path: str, sniff_bytes: int | None) -> bytes | None:
    """A file's bytes; none of one that can't be read, or whose head is binary: the rest of it is not read."""
    try:
        with open(path, "rb") as handle:
            head = handle.read(-1 if sniff_bytes is None else sniff_bytes)
            odd = len(head) - len(head.translate(None, NON_TEXT_BYTES))
            if b"\0" in head or odd > 0.3 * len(head):
                return None
            return head if sniff_bytes is None else head + handle.read()
    except OSError:
        return None


def bounded_reads(rows: pd.DataFrame, sniff_bytes: int | None, limit: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """The rows with their contents, in pieces that end with the file that brings them to ``limit`` bytes."""
    contents: list[bytes | None] = []
    first, held = 0, 0
    for at, (root, path) in enumerate(zip(rows["root"], rows["path"])):
        contents.append(text_of_file(os.path.join(root, path), sniff_bytes))
        held += len(contents[-1] or b"")
        if held >= limit:
            yield rows.iloc[first : at + 1].drop(columns="root").assign(content=contents)
            contents, first, held = [], at + 1, 0
    if contents:
        yield rows.iloc[first:].drop(columns="root").assign(content=contents)


def read_contents(listing: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Bytes of each listed file; an unreadable or binary file has null content."""
    sniff_bytes = config.sniff_bytes

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from bounded_reads(batch, sniff_bytes)

    return listing.select("repo", "root", "path", "size").mapInPandas(read, RAW_FILES_SCHEMA)


def read_trees(roots: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """A ``files`` table from directory trees: filtered by path and size, then read, sniffed and decoded.

    Listings are dealt out by (repo, path) before any content is read, so one large repository is read by all tasks.
    """
    listing = select_files(list_trees(roots, config), config).repartition("repo", "path")
    raw = read_contents(listing, config)
    return raw.where(~looks_binary(F.col("content"), config.sniff_bytes)).withColumn("content", decode_text(F.col("content")))
