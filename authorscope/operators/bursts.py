"""Bursts of commits: windows anchored at the first commit outside the previous one.

A window's anchor depends on the window before it, back to the first commit of a repo. The chain is cut all the same.
Time is divided into buckets of ``SPAN`` windows. All that a bucket can receive from the time before it is how far the
last window reaches into it, that is: how many of its first moments are covered. So each bucket is folded once for
every such number, which gives how many moments of the next bucket are covered and what bursts there were, and the
folded buckets are then joined, ``FAN`` neighbours at a time, until one row is left for a repo.

A task holds one bucket, or the folded forms of ``FAN`` neighbours: a repo with a third of all commits and no pause is
dealt out by time. Anchors are followed by doubling pointers over arrays, for all buckets of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Windows a bucket; a moment in the first of them is copied to the bucket before, whose last window may cover it.
SPAN = 16
#: Neighbours joined at a time, as a power of two.
FAN_BITS = 6
#: Moments are counted from the first year and end with the year 9999, as timestamps do.
ORIGIN, END = -62_135_596_800_000_000, 253_402_300_800_000_000
#: Rows handled at once, or one group.
ROWS = 1 << 16
LEADING = 5
#: ``covered`` moments of the bucket are covered when it begins; then ``leaves`` of the next one are when it ends.
FOLDED = "repo string, bucket long, covered long, leaves long, largest long, " + ", ".join(f"burst{i} long" for i in range(LEADING))
NAMES = [c.split()[0] for c in FOLDED.split(", ")]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Consecutive rows with some ``ROWS`` rows that cut no group, and where each group begins. Rows are sorted by the
    keys."""
    pending: list[pa.RecordBatch] = []
    held, limit = 0, ROWS
    for batch in batches:
        pending.append(batch)
        held += batch.num_rows
        if held < limit:
            continue
        table = pa.Table.from_batches(pending)
        starts = group_starts(table, keys)
        if len(starts) < 2:
            limit *= 2
            continue
        yield table.slice(0, starts[-1]), starts[:-1]
        rest = table.slice(starts[-1])
        pending, held, limit = rest.to_batches(), rest.num_rows, max(ROWS, 2 * rest.num_rows)
    if held:
        table = pa.Table.from_batches(pending)
        yield table, group_starts(table, keys)


def group_starts(table: pa.Table, keys: tuple[str, str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for key in keys:
        values = table[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def followed(next_: np.ndarray, leaves: np.ndarray, largest: np.ndarray, bursts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each node with all that follow it: the last one's ``leaves``, the largest burst, and the first bursts."""
    while (ahead := next_ >= 0).any():
        at = next_[ahead]
        leaves, largest, bursts, next_ = leaves.copy(), largest.copy(), bursts.copy(), next_.copy()
        leaves[ahead] = leaves[at]
        largest[ahead] = np.maximum(largest[ahead], largest[at])
        mine, theirs = bursts[ahead], bursts[at]
        both = np.concatenate([mine, theirs], axis=1)
        # those that are bursts move to the front, in order
        order = np.argsort(both == 0, axis=1, kind="stable")[:, :LEADING]
        bursts[ahead] = np.take_along_axis(both, order, axis=1)
        next_[ahead] = next_[at]
    return leaves, largest, bursts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def folded_rows(table: pa.Table, rows: np.ndarray, bucket: np.ndarray, covered: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    leaves, largest, bursts = found
    columns = [bucket, covered, leaves, largest, *bursts.T]
    repo = table["repo"].combine_chunks().take(pa.array(rows))
    return pa.RecordBatch.from_arrays([repo, *[pa.array(np.ascontiguousarray(c, np.int64)) for c in columns]], NAMES)


def fold_buckets(width: int, length: int, least: int) -> Callable:
    """Rows (repo, bucket, at, n), sorted; those from ``length`` on belong to the next bucket."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ("repo", "bucket")):
            n, bucket = table["n"].to_numpy(), table["bucket"].to_numpy()
            offset = table["at"].to_numpy() - ORIGIN - bucket * length
            ends = np.append(starts[1:], len(n))
            ends_of = np.repeat(ends, ends - starts)
            own = offset < length
            own_ends = starts + np.add.reduceat(own.astype(np.int64), starts)
            past = following(offset, starts, ends, width)
            total = np.concatenate([[0], np.cumsum(n)])
            sizes = total[past] - total[:-1]
            stays = (past < ends_of) & own[np.minimum(past, len(n) - 1)]
            leaves = np.where(stays, 0, past - np.repeat(own_ends, ends - starts))
            burst = np.where(sizes >= least, sizes, 0)
            bursts = np.zeros((len(n), LEADING), np.int64)
            bursts[:, 0] = burst
            found = followed(np.where(stays, past, -1), leaves, burst, bursts)
            # one row for each number of first moments that may be covered; where all are, nothing happens here
            can = starts + np.add.reduceat((offset < width).astype(np.int64), starts) if width else starts
            filled = own_ends > starts
            starts, own_ends, can = starts[filled], own_ends[filled], can[filled]
            counts = can - starts + 1
            entry = ranges(starts, counts)
            idle = entry >= np.repeat(own_ends, counts)
            at = np.minimum(entry, np.repeat(own_ends, counts) - 1)
            picked = [f[at] for f in found]
            for p in picked:
                p[idle] = 0
            yield folded_rows(table, at, bucket[at], entry - np.repeat(starts, counts), tuple(picked))

    return fold


def following(offset: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For each row the first one of its group whose offset is more than ``width`` beyond its own."""
    stride = int(offset.max()) + width + 1
    step = max(1, 2**62 // stride)  # groups whose offsets fit one after the other in 64 bits
    found = []
    for first in range(0, len(starts), step):
        low, high = starts[first], ends[min(first + step, len(starts)) - 1]
        group = np.repeat(np.arange(len(starts[first : first + step])), (ends - starts)[first : first + step])
        key = offset[low:high] + group * stride
        found.append(low + np.searchsorted(key, key + width, side="right"))
    return np.concatenate(found)


def join_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded buckets (``next`` names those joined), sorted by (repo, next, bucket, covered), as one folded bucket."""
    for table, starts in whole_groups(batches, ("repo", "next")):
        bucket = table["bucket"].to_numpy()
        rows = len(bucket)
        first = np.zeros(rows, bool)
        first[starts] = True
        first[1:] |= bucket[1:] != bucket[:-1]
        parts = np.flatnonzero(first)
        last_part = np.isin(np.append(parts[1:], rows), np.append(starts[1:], rows))  # the last bucket of its group
        part = np.cumsum(first) - 1
        then = np.append(parts[1:], 0)
        leaves = table["leaves"].to_numpy()
        adjacent = np.append(bucket[parts[1:]] == bucket[parts[:-1]] + 1, False)
        next_ = np.where(last_part[part], -1, then[part] + np.where(adjacent[part], leaves, 0))
        leaves = np.where(bucket % (1 << FAN_BITS) == (1 << FAN_BITS) - 1, leaves, 0)
        bursts = np.stack([table[f"burst{i}"].to_numpy() for i in range(LEADING)], axis=1)
        found = followed(next_, leaves, table["largest"].to_numpy(), bursts)
        # only a group whose first bucket is there can begin with covered moments
        begins = np.repeat(bucket[starts] % (1 << FAN_BITS) == 0, np.diff(np.append(starts, rows)))
        in_first = part == np.repeat(part[starts], np.diff(np.append(starts, rows)))
        at = np.flatnonzero(in_first & (begins | first))
        yield folded_rows(table, at, table["next"].to_numpy()[at], table["covered"].to_numpy()[at], tuple(f[at] for f in found))


def burst_statistics(moments: DataFrame, window_hours: int, least: int) -> DataFrame:
    """(repo, largest_burst, first_bursts): of repos with a window of ``least`` commits or more, the largest and the
    first five in time order. ``moments`` has repo, at (microseconds) and n, each moment of a repo once."""
    width = window_hours * HOUR
    length = SPAN * max(width, HOUR)
    since = f"(at - ({ORIGIN}L))"
    bucket, inside = F.expr(f"{since} div {length}L"), F.expr(f"{since} % {length}L")
    places = F.when((inside < width) & (F.col("here") > 0), F.array(F.col("here"), F.col("here") - 1)).otherwise(F.array("here"))
    found = (
        moments.withColumn("here", bucket)
        .select("repo", F.explode(places).alias("bucket"), "at", F.col("n").cast("long").alias("n"))
        .repartition("repo", "bucket")
        .sortWithinPartitions("repo", "bucket", "at")
        .mapInArrow(fold_buckets(width, length, least), FOLDED)
    )
    left = (END - ORIGIN) // length
    while left:
        left >>= FAN_BITS
        found = (
            found.withColumn("next", F.shiftright("bucket", FAN_BITS))
            .repartition("repo", "next")
            .sortWithinPartitions("repo", "next", "bucket", "covered")
            .mapInArrow(join_buckets, FOLDED)
        )
    first = F.filter(F.array(*[F.col(f"burst{i}").cast("int") for i in range(LEADING)]), lambda b: b > 0)
    return found.where("covered = 0 AND largest > 0").select("repo", F.col("largest").cast("int").alias("largest_burst"), first.alias("first_bursts"))
