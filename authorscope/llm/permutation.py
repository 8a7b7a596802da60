"""Pseudorandom permutations of [0, n) as column expressions.

An unbalanced Feistel network over the grid a x b, where a = ceil(sqrt(n)) and b = ceil(n / a), so that fewer than a
cells lie outside [0, n). A value that lands outside walks its cycle until it is inside; the walk is at most
a * b - n steps long, so the bound below is exact, and one value in about sqrt(n) walks at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime below 2^31: products of two residues stay inside a long.
PRIME = 2_147_483_647
ROUNDS = 4


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) of the grid for n values."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def sides(n: Column) -> tuple[Column, Column]:
    """:func:`grid` of a column of longs, below 2^52."""
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")
    return a, F.greatest(F.lit(1), F.ceil(n / a)).cast("long")


def round_keys(seed: int) -> list[tuple[int, int, int, int]]:
    """Multipliers and increments of each double round, drawn from the seed by a linear congruence."""
    keys, state = [], seed * 2 + 1
    for _ in range(ROUNDS):
        four = []
        for _ in range(4):
            state = (state * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % 2**64
            four.append(1 + (state >> 33) % (PRIME - 1))
        keys.append(tuple(four))
    return keys


def mixed_value(value: int, multiplier: int, increment: int) -> int:
    """The round function on plain integers."""
    y = (value * multiplier + increment) % PRIME
    return (y * y + increment) % PRIME


def permuted_value(x: int, n: int, seed: int, tweak: int = 0) -> int:
    """The permutation on plain integers; the column expression gives the same."""
    a, b = grid(n)
    while True:
        left, right = x // b, x % b
        for m1, c1, m2, c2 in round_keys(seed):
            left = (left + mixed_value(right + tweak, m1, c1)) % a
            right = (right + mixed_value(left + tweak, m2, c2)) % b
        x = left * b + right
        if x < n:
            return x


def _mixed(value: Column, multiplier: Column, increment: Column) -> Column:
    y = (value * multiplier + increment) % F.lit(PRIME)
    return (y * y + increment) % F.lit(PRIME)


def permuted(x: Column, n: Column, a: Column, b: Column, seed: int, tweak: Column | None = None) -> Column:
    """Place of ``x`` in the permutation of [0, n). ``a`` and ``b`` are the grid of n; all are longs.

    ``tweak`` (below 2^30) selects another permutation for the same seed, row by row.
    """
    tweak = F.lit(0).cast("long") if tweak is None else tweak
    keys = F.array(
        *[F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(four)]) for four in round_keys(seed)]
    )

    def once(value: Column) -> Column:
        right = value % b
        start = F.struct(((value - right) / b).cast("long").alias("l"), right.alias("r"))

        def step(s: Column, k: Column) -> Column:
            left = (s["l"] + _mixed(s["r"] + tweak, k["k0"], k["k1"])) % a
            return F.struct(left.alias("l"), ((s["r"] + _mixed(left + tweak, k["k2"], k["k3"])) % b).alias("r"))

        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    first = once(x)
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), a), first, lambda v, _: F.when(v < n, v).otherwise(once(v))
    )
    return F.when(first < n, first).otherwise(walk)
