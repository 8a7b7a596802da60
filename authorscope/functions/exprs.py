"""Small expression combinators over Spark columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def built_once(make: Callable) -> Callable:
    """Cache the columns made by a function per argument list.

    Columns are unresolved trees, so one tree serves every table; building the large ones costs seconds of
    driver time. A new JVM gateway starts a new cache.
    """
    cache: dict = {}

    @functools.wraps(make)
    def cached(*args, **kwargs):
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = make(*args, **kwargs)
        return cache[key]

    return cached


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    Without the binding, Catalyst may inline ``value`` into a lambda and evaluate it once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def total(array: Column, item: Callable[[Column], Column]) -> Column:
    """Sum of ``item`` over an array, left to right."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + item(x))


def mean(array: Column) -> Column:
    """Mean of a non-empty numeric array."""
    return let(array, lambda xs: total(xs, lambda x: x.cast("double")) / F.size(xs))


def var_pop(array: Column) -> Column:
    """Population variance of a non-empty numeric array (two passes)."""
    return let(
        array,
        lambda xs: let(mean(xs), lambda mu: total(xs, lambda x: F.pow(x - mu, F.lit(2.0))) / F.size(xs)),
    )


def std_pop(array: Column) -> Column:
    return F.sqrt(var_pop(array))


def count_moments(counts: Column) -> Column:
    """``struct(n, mean, var)`` of an array of small integers, from exact sums, so ties at a threshold are stable."""
    def sums(xs: Column) -> Column:
        as_double = lambda x: x.cast("double")
        return F.struct(
            F.size(xs).cast("double").alias("n"),
            total(xs, as_double).alias("s"),
            total(xs, lambda x: as_double(x) * as_double(x)).alias("q"),
        )

    return let(let(counts, sums), moments_of_sums)


def moments_of_sums(m: Column) -> Column:
    """The same of ``struct(n, s, q)``: how many, their sum and the sum of their squares."""
    return F.when(
        m["n"] > 0,
        F.struct(
            m["n"].alias("n"),
            (m["s"] / m["n"]).alias("mean"),
            ((m["n"] * m["q"] - m["s"] * m["s"]) / (m["n"] * m["n"])).alias("var"),
        ),
    )


def run_bounds(ordered: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Runs of equal keys in a sorted array, as ``struct(b, e)`` with ``b`` inclusive and ``e`` exclusive (0-based)."""
    def runs(xs: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: (i == 0) | (key(F.get(xs, i)) != key(F.get(xs, i - 1))),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda b, j: F.struct(b.alias("b"), F.coalesce(F.get(st, j + 1), F.size(xs)).alias("e")),
            ),
        )

    return F.when(F.size(ordered) > 0, let(ordered, runs)).otherwise(
        F.from_json(F.lit("[]"), "array<struct<b:int,e:int>>")
    )


def run_counts(ordered: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Lengths of the runs of equal keys in a sorted array."""
    return F.transform(run_bounds(ordered, key), lambda r: r["e"] - r["b"])


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy in bits of a distribution given as an array of counts."""
    def bits(cs: Column) -> Column:
        return let(
            F.aggregate(cs, F.lit(0).cast("long"), lambda a, c: a + c),
            lambda n: -total(cs, lambda c: (c / n) * F.log2(c / n)),
        )

    return let(counts, bits)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of the exact binary value, ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def percent(ratio: Column, digits: int) -> Column:
    """Percentage text such as ``12.5%``."""
    return F.concat(fixed(ratio * 100.0, digits), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value.cast("long"), 0)


def int_list(array: Column) -> Column:
    """``[1, 2]`` text for an integer array."""
    return F.concat(F.lit("["), F.array_join(F.transform(array, lambda x: x.cast("string")), ", "), F.lit("]"))


def text_literal(value: Column) -> Column:
    """Quoted text: single quotes unless the text holds one and no double quote."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    has_single, has_double = value.contains("'"), value.contains('"')
    return F.when(has_single & ~has_double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
