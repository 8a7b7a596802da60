"""Rule records and their compilation into one signal array per row.

A rule is a pattern plus a score formula. Patterns stay literal in the plan (each compiled once per task), and a
rule names the literals its pattern cannot match without, so most rows are decided by a plain substring test.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import any_of, let
from ..functions.text import find_all


@dataclass(frozen=True)
class PatternRule:
    rule_id: str
    name: str
    pattern: str
    weight: float
    needs: tuple[str, ...]  # one of these must occur in the (lower-cased) text
    score: float = 0.0  # fixed score, where the family uses one


#: Characters from frequent to rare in texts; those that are not listed are rarer.
FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"


def holds(text: Column, literal: str) -> Column:
    """``text.contains(literal)``. Where a substring test stops at each first character of what it looks for, the part of
    the literal from its rarest character on is looked for first."""
    from_rarest = min(range(max(1, len(literal) - 2)), key=lambda i: -FREQUENT.find(literal[i].lower()) if literal[i].lower() in FREQUENT else -len(FREQUENT))
    whole = text.contains(literal)
    return text.contains(literal[from_rarest:]) & whole if from_rarest else whole


def word_part(literal: str) -> str | None:
    """The longest piece of a literal that lies within one token wherever the literal occurs; none without a word in it."""
    return max(re.findall("[A-Za-z0-9_]+", literal), key=len, default=None)


def word_parts(needs: tuple[str, ...]) -> set[str]:
    return {word_part(n) for n in needs} - {None}


def placed_words(literal: str) -> list[str]:
    """The words of a literal as they lie in tokens wherever it occurs: a space stands for the token's begin or end where
    the literal goes on with something else than a word."""
    return sorted({" " * (m.start() > 0) + m[0] + " " * (m.end() < len(literal)) for m in re.finditer(r"\w+", literal)})


def any_part(parts: Column, literals: tuple[str, ...]) -> Column:
    """Whether one of the literals is among ``parts``, those that the tokens of a text leave room for."""
    return any_of([F.array_contains(parts, n) for n in literals])


def some_part(parts: Column, literals: set[str]) -> Column:
    """The same for many literals at once."""
    return F.exists(parts, lambda p: p.isin(sorted(literals)))


def may_match(text: Column, needs: tuple[str, ...], parts: Column | None = None) -> Column:
    """Whether one of the literals is in the text. With ``parts``, the text is only looked through for those told there."""
    def one(literal: str) -> Column:
        there = holds(text, literal)
        return there if parts is None else any_part(parts, (literal,)) & there

    return any_of([one(n) for n in needs])


def hits(rule: PatternRule, text: Column, probe: Column, flags: str = "", parts: Column | None = None) -> Column:
    """All matches of a rule in ``text``; null when the literal test on ``probe`` rules it out."""
    return F.when(may_match(probe, rule.needs, parts), find_all(text, rule.pattern, flags))


def when_hit(
    matches: Column, make: Callable[[Column], Column], at_least: int = 1
) -> Column:
    """``make(matches)`` when there are enough matches, else null. ``matches`` is evaluated once."""
    return let(matches, lambda ms: F.when(ms.isNotNull() & (F.size(ms) >= at_least), make(ms)))


def capped(cap: float, base: float, step: float, n: Column) -> Column:
    """min(cap, base + step·n)."""
    return F.least(F.lit(cap), F.lit(base) + n * F.lit(step))


def instances(n: Column, what: str, noun: str = "instance(s)") -> Column:
    return F.concat(F.lit("Found "), n.cast("string"), F.lit(f" {noun} of {what}"))


def first(array: Column, k: int) -> Column:
    return F.slice(array, 1, k)
