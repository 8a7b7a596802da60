"""Text-to-array primitives shared by the rules. All are row-local: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import any_of, let, run_bounds, run_counts
from .regex import SPACE, WHITESPACE_CHARS, WORD, java_regex


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE_CHARS))


def lstrip(value: Column) -> Column:
    return F.ltrim(value, F.lit(WHITESPACE_CHARS))


def count_matches(value: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(value, F.lit(java_regex(pattern, flags)))


def find_all(value: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(java_regex(pattern, flags)), F.lit(group))


def prose_tokens(lowered: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(lowered, F.lit(f"[{WORD}]+"), F.lit(0))


def code_tokens(lowered: Column) -> Column:
    """Word runs plus every other non-space character on its own."""
    return F.regexp_extract_all(lowered, F.lit(f"[{WORD}]+|[^{WORD}{SPACE}]"), F.lit(0))


def tokens(lowered: Column, content_type: Column) -> Column:
    return F.when(content_type == "code", code_tokens(lowered)).otherwise(prose_tokens(lowered))


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def line_count(content: Column) -> Column:
    """Number of line feeds plus one, without building the array. A line feed is one byte, and bytes need no counting."""
    return F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def has_length(content: Column, least: int) -> Column:
    """At least so many characters. They have four bytes at most, so only those of short texts are counted."""
    return (F.octet_length(content) >= 4 * least) | (F.length(content) >= least)


def sentences(content: Column, longer_than: int) -> Column:
    """Stripped pieces between runs of ``. ! ?`` with more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(content, "[.!?]+", -1), strip), lambda s: F.length(s) > longer_than)


def word_count(stripped: Column) -> Column:
    """Number of whitespace-separated words of a stripped, non-empty text."""
    return F.regexp_count(stripped, F.lit(f"[{SPACE}]+")) + 1


def words(value: Column) -> Column:
    """Whitespace-separated words; empty array for blank text."""
    return F.regexp_extract_all(value, F.lit(f"[^{SPACE}]+"), F.lit(0))


def first_word(stripped: Column) -> Column:
    return F.lower(F.regexp_extract(stripped, f"^[^{SPACE}]+", 0))


def comment_text(stripped: Column) -> Column:
    """Text of a single-line comment, or null. The prefix must not be doubled."""
    out = None
    for prefix in ("//", "#", "--", ";"):
        hit = stripped.startswith(prefix) & ~stripped.startswith(prefix * 2)
        body = strip(F.substring(stripped, len(prefix) + 1, 2**31 - 1))
        out = F.when(hit, body) if out is None else out.when(hit, body)
    return out


def comments(stripped_lines: Column) -> Column:
    return F.filter(F.transform(stripped_lines, comment_text), lambda c: c.isNotNull())


def is_code_line(stripped: Column) -> Column:
    """Neither blank nor starting with a comment or docstring opener."""
    openers = ("//", "#", "--", ";", "/*", "*", "'''", '"""')
    return (stripped != "") & ~any_of([stripped.startswith(p) for p in openers])


def indent(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def blank_runs(stripped_lines: Column) -> Column:
    """Lengths of the blank runs that precede a non-blank line; a trailing run is not counted."""
    def gaps(filled: Column) -> Column:
        return F.filter(
            F.transform(
                filled,
                lambda p, j: p - F.when(j == 0, F.lit(-1)).otherwise(F.get(filled, j - 1)) - 1,
            ),
            lambda n: n > 0,
        )

    positions = F.filter(
        F.transform(stripped_lines, lambda s, i: F.when(s != "", i)), lambda p: p.isNotNull()
    )
    return let(positions, gaps)


def docstrings(content: Column) -> Column:
    """Text between triple quotes; either kind may close the other."""
    return F.when(
        content.contains('"""') | content.contains("'''"),
        F.regexp_extract_all(content, F.lit(r"""(?s)(?:\"\"\"|''')(.*?)(?:\"\"\"|''')"""), F.lit(1)),
    ).otherwise(F.array().cast("array<string>"))


def token_windows(token_array: Column, width: int = 50, step: int = 25) -> Column:
    """Sliding windows that start before ``len - width``; empty when there is none."""
    n = F.size(token_array)
    return F.when(
        n > width,
        let(
            token_array,
            lambda ts: F.transform(
                F.sequence(F.lit(0), F.size(ts) - width - 1, F.lit(step)), lambda i: F.slice(ts, i + 1, width)
            ),
        ),
    ).otherwise(F.array().cast("array<array<string>>"))


def positional_ngrams(token_array: Column, n: int) -> Column:
    """Every n-gram in order, joined by a space (tokens hold none, so the text identifies the n-gram)."""
    return F.when(
        F.size(token_array) >= n,
        let(
            token_array,
            lambda ts: F.transform(
                F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.array_join(F.slice(ts, i + 1, n), " ")
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))


def token_counts(token_array: Column) -> Column:
    """(token, n) of each distinct token, in order; counted inside the row."""
    return let(
        F.sort_array(token_array),
        lambda ts: F.transform(
            run_bounds(ts, lambda t: t),
            lambda r: F.struct(F.get(ts, r["b"]).alias("token"), (r["e"] - r["b"]).cast("long").alias("n")),
        ),
    )


def chunks(content: Column, max_size: int = 512, min_size: int = 50, limit: int | None = None) -> Column:
    """Greedy packing of paragraphs (or lines when there is no blank line) into chunks below ``max_size``.

    The joiner is not counted, a longer part is kept whole, chunks below ``min_size`` are dropped.
    """
    state = "struct<cur:string,out:array<string>>"
    parts = F.when(content.contains("\n\n"), F.split(content, "\n\n", -1)).otherwise(lines(content))

    def flush(acc: Column) -> Column:
        keep = F.length(acc["cur"]) >= min_size
        if limit is not None:
            keep = keep & (F.size(acc["out"]) < limit)
        return F.when(keep, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def add(acc: Column, part: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(part) < max_size
        joined = F.when(acc["cur"] == "", part).otherwise(F.concat(acc["cur"], F.lit("\n"), part))
        return F.struct(
            F.when(fits, joined).otherwise(part).alias("cur"),
            F.when(fits, acc["out"]).otherwise(flush(acc)).alias("out"),
        ).cast(state)

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")).cast(state)
    return F.aggregate(parts, start, add, flush)


def character_counts(content: Column) -> Column:
    """Number of occurrences of each distinct character (order not significant).

    With a small alphabet, removing each character and comparing lengths is several times cheaper than sorting them.
    """
    # The pattern matches one code point, so surrogate pairs stay whole.
    characters = F.regexp_extract_all(content, F.lit("(?s)."), F.lit(0))

    def count(cs: Column) -> Column:
        def by_removal(alphabet: Column) -> Column:
            return F.transform(
                alphabet, lambda ch: F.size(cs) - F.length(F.replace(content, ch, F.lit("")))
            )

        return let(
            F.array_distinct(cs),
            lambda alphabet: F.when(F.size(alphabet) <= 256, by_removal(alphabet)).otherwise(
                run_counts(F.sort_array(cs))
            ),
        )

    return let(characters, count)
