"""Phrase, code, documentation and configuration rules over one text per row."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T
from ..functions.exprs import any_of, fixed, int_list, let, moments_of_sums, percent
from ..functions.regex import java_regex
from ..schema import signal
from .rules import PatternRule, any_part, capped, first, hits, instances, may_match, when_hit, word_parts

# ---- fixed values: phrase rules (id, pattern on lower-cased text, name, weight, literals) ----
# In the order in which signals are told; the ids E10 to E14 and E22 follow topics instead.
PHRASE_TABLE = (
    (
        "E1",
        r"\bhere(?:'s| is) (?:a|an|the) (?:simple |basic |complete )?"
        r"(?:example|implementation|solution|code|function|class)\b",
        "AI intro phrase", 0.7, ("here's ", "here is "),
    ),
    ("E2", r"\blet me (?:explain|show|help|create|write)\b", "AI conversational phrase", 0.8, ("let me ",)),
    ("E3", r"\bi(?:'ll| will) (?:create|write|implement|show)\b", "AI action phrase", 0.75, ("i'll ", "i will ")),
    (
        "E4",
        r"\bas (?:requested|mentioned|you can see)\b",
        "AI reference phrase", 0.6, ("as requested", "as mentioned", "as you can see"),
    ),
    (
        "E5",
        r"\bthis (?:function|class|method|code|implementation) (?:will |does |is designed to )",
        "AI explanation pattern", 0.65, (" will ", " does ", " is designed to "),
    ),
    ("E6", r"\bthe above (?:code|function|implementation|example)\b", "AI reference pattern", 0.6, ("the above ",)),
    ("E7", r"\bnote that\b", "AI note pattern", 0.3, ("note that",)),
    ("E8", r"\bkeep in mind\b", "AI reminder pattern", 0.4, ("keep in mind",)),
    ("E9", r"\bimportant(?:ly)?:\s", "AI emphasis pattern", 0.4, ("important:", "importantly:")),
    ("E12", r"\bfirst,?\s+(?:we |you |let's |I )", "AI step pattern", 0.5, ("first",)),
    ("E13", r"\bnext,?\s+(?:we |you |let's |I )", "AI step pattern", 0.5, ("next",)),
    ("E14", r"\bfinally,?\s+(?:we |you |let's |I )", "AI step pattern", 0.5, ("finally",)),
    ("E15", r"\bhope this helps\b", "AI politeness", 0.9, ("hope this helps",)),
    ("E16", r"\bfeel free to\b", "AI politeness", 0.7, ("feel free to",)),
    ("E17", r"\bdon't hesitate to\b", "AI politeness", 0.8, ("don't hesitate to",)),
    ("E18", r"\blet me know if\b", "AI politeness", 0.75, ("let me know if",)),
    ("E19", r"\bhappy to help\b", "AI politeness", 0.85, ("happy to help",)),
    (
        "E20",
        r"(?:this|which) (?:ensures?|guarantees?|makes? sure) that\b",
        "AI over-explanation", 0.5, ("ensure", "guarantee", " sure that"),
    ),
    (
        "E21",
        r"\bfor (?:better |improved )?(?:readability|maintainability|performance|clarity)\b",
        "AI justification", 0.4, ("readability", "maintainability", "performance", "clarity"),
    ),
    ("E10", r"\bYOUR_[A-Z_]+_HERE\b", "AI placeholder pattern", 0.85, ("YOUR_",)),
    (
        "E22",
        r"\b(?:your|my)[-_]?(?:api[-_]?key|token|secret)\b",
        "AI placeholder pattern", 0.7, ("key", "token", "secret"),
    ),
    ("E11", r"<your[_-].*?>", "AI placeholder pattern", 0.85, ("<your",)),
    ("E23", r"\breplace (?:this |with )?\byour\b", "AI placeholder instruction", 0.75, ("replace ",)),
)

OBVIOUS_COMMENTS = (
    r"^(?:initialize|initializing|init)\s+(?:the\s+)?(?:variable|value|array|list|dict)",
    r"^(?:increment|decrement|add|subtract)\s+(?:the\s+)?(?:counter|value|number)",
    r"^(?:return|returns?)\s+(?:the\s+)?(?:result|value|data|response)",
    r"^(?:loop|iterate|iterating)\s+(?:through|over)\s+(?:the\s+)?(?:array|list|items)",
    r"^(?:check|checking)\s+if\s+",
    r"^(?:get|set|create|delete|remove|update|add)\s+(?:the\s+)?(?:user|data|item|value)",
)
# Possessive repetition: same matches, and no stack use on very long identifiers.
VERBOSE_NAMES = (r"\b[a-z]+(?:[A-Z][a-z]+){4,}+\b", r"\b[a-z]+(?:_[a-z]+){4,}+\b")
TEXTBOOK_NAMES = (
    r"\b(?:result|data|response|output|input|value|item|element|temp|tmp)\d*\b",
    r"\b(?:arr|lst|dict|obj|str|num|idx|cnt|len|max|min)(?:[A-Z]|_|$)",
    r"\b(?:isValid|isActive|isEnabled|hasPermission|canAccess)\b",
    r"\b(?:handleClick|handleSubmit|handleChange|handleError)\b",
    r"\b(?:fetchData|getData|setData|updateData|deleteData)\b",
)
TRY_BLOCK = r"\btry\s*[{:]"
DEBUG_CALLS = (
    (r"console\.log\s*\(", "console.log"),
    (r"\bprint\s*\(", "print"),
    (r"System\.out\.println\s*\(", "System.out.println"),
    (r"fmt\.Println\s*\(", "fmt.Println"),
    (r"puts\s+['\"]", "puts"),
)
TODO_NOTE = r"(?:TODO|FIXME|NOTE|HACK|XXX):\s*(.{10,60})"
TODO_PHRASES = (
    "implement", "add error handling", "add validation", "optimize", "refactor", "improve", "consider",
)
DOCSTRING_TEMPLATES = (
    (r"Args:\s*\n\s+\w+.*?:\s+.+", "Args:"),
    (r"Returns:\s*\n\s+.+", "Returns:"),
    (r"Raises:\s*\n\s+\w+.*?:\s+.+", "Raises:"),
    (r"Parameters\s*\n\s*-+\s*\n", "Parameters"),
    (r"Example(?:s)?:\s*\n\s+>>>", ">>>"),
)
SECTION_HEADERS = (
    r"^## (?:Overview|Introduction|Getting Started|Prerequisites|Installation|Usage|Features|Configuration|API"
    r"|Examples|Contributing|License)\s*$"
)
EMOJI = "[\U0001F300-\U0001F9FF]"
#: With which all of them begin in UTF-8.
EMOJI_BYTES = b"\xf0\x9f"
BADGES = r"\[!\[.*?\]\(.*?\)\]\(.*?\)(?:\s*\[!\[.*?\]\(.*?\)\]\(.*?\)){2,}"
CONTENTS_TABLE = r"## Table of Contents\s*\n(?:\s*-\s*\[.*?\]\(#.*?\)\s*\n){5,}+"
FEATURE_LIST = r"(?:^|\n)(?:[*-]\s+\*\*.*?\*\*:?\s+.*?\n){3,}"
PROSE_RULES = (
    PatternRule(
        "E41", "AI buzzwords", r"\b(?:comprehensive|robust|seamless|leverage|utilize|streamline)\b", 0.4,
        ("comprehensive", "robust", "seamless", "leverage", "utilize", "streamline"),
    ),
    PatternRule(
        "E42", "AI intro phrase",
        r"\bThis (?:project|repository|package|library|tool) (?:provides|offers|includes|features)\b", 0.5,
        ("This ",),
    ),
    PatternRule(
        "E43", "AI marketing phrases",
        r"\b(?:easy[- ]to[- ]use|user[- ]friendly|out[- ]of[- ]the[- ]box)\b", 0.4,
        ("easy", "friendly", "box"),
    ),
    PatternRule(
        "E44", "AI audience targeting",
        r"\bwhether you(?:'re| are) (?:a |looking |building |developing )", 0.6, ("whether you",),
    ),
)
PLACEHOLDERS = r"[\"'](?:your[-_]?|my[-_]?|example[-_]?|sample[-_]?)[\w-]+[\"']"
# ---- end of fixed values ----

PHRASE_RULES = tuple(PatternRule(rule_id, name, pattern, weight, needs) for rule_id, pattern, name, weight, needs in PHRASE_TABLE)
#: The words with which a token must begin for each of the textbook patterns, lower-cased.
TEXTBOOK_WORDS = tuple(tuple(f" {w}" for w in re.search(r"\(\?:([\w|]+)\)", p)[1].lower().split("|")) for p in TEXTBOOK_NAMES)
#: Of lowered text. Avoid i and s, whose non-ASCII case variants stay other letters there: FIXME by "xme:".
TODO_NEEDS = ("todo:", "xme:", "hack:", "note:", "xxx:")
PLACEHOLDER_NEEDS = ("your", "my", "ample")
#: The token that opens a try block.
TRY_NEEDS = (" try ",)
#: Literals that the rules ask for.
LITERALS = {n for r in (*PHRASE_RULES, *PROSE_RULES) for n in r.needs}.union(
    *TEXTBOOK_WORDS, (lit.lower() for _, lit in DEBUG_CALLS), TODO_NEEDS, PLACEHOLDER_NEEDS, TRY_NEEDS, ("_",)
)
#: The words in them.
PARTS = word_parts(tuple(LITERALS))


def count_badges(text: str) -> int:
    """Number of matches of ``BADGES``, in time that grows with the text alone.

    A badge that starts at some place may end at any closing bracket of its line from the first possible one on, so a
    chain of badges is a question of which ends are followed by another start. Three levels of sorted ends answer it.
    """
    starts = [m.start() for m in re.finditer(r"(?=\[!\[)", text)]
    if len(starts) < 3:
        return 0
    inner, outer = ([m.start() for m in re.finditer(p, text)] for p in (r"\]\(", r"\)\]\("))
    brackets, breaks = ([m.start() for m in re.finditer(p, text)] for p in (r"\)", r"\n"))

    def at_least(places: list[int], low: int) -> int:
        i = bisect.bisect_left(places, low)
        return places[i] if i < len(places) else len(text)

    first_end, line_end, follower = {}, {}, {}
    for p in starts:
        line_end[p] = at_least(breaks, p)
        bracket = at_least(brackets, at_least(outer, at_least(inner, p + 3) + 2) + 3)
        if bracket < line_end[p]:
            first_end[p] = bracket + 1
        before = p
        while before and text[before - 1].isspace():
            before -= 1
        if before and text[before - 1] == ")":
            follower[before] = p

    def then(possible: Callable[[int], bool]) -> Callable[[int], int | None]:
        """The first end, followed by a possible badge, that a badge starting at p can have."""
        ends = sorted(e for e, p in follower.items() if possible(p))

        def end(p: int) -> int | None:
            if p not in first_end:
                return None
            e = at_least(ends, first_end[p])
            return e if e <= line_end[p] and e in follower else None

        return end

    with_second = then(lambda p: p in first_end)
    with_third = then(lambda p: with_second(p) is not None)
    found, past = 0, 0
    for p in starts:
        if p < past:
            continue
        end = with_third(p)
        if end is None:
            continue
        unit = follower[with_second(follower[end])]
        past = first_end[unit]
        while follower.get(past) in first_end:
            past = first_end[follower[past]]
        found += 1
    return found


LIST_HEAD = re.compile(r"^[*-]\s+\*\*", re.MULTILINE)
LIST_TERM_IN_LINE = re.compile(r"\*\*:?[^\S\n]+\S")
WHITE_RUN = re.compile(r"\s*")


def count_feature_lists(text: str) -> int:
    """Number of matches of ``FEATURE_LIST``, in time that grows with the text alone.

    An item begins at a line's start, and its bold term must close on the line where it opens. There are at most three
    places where it can end, in the order in which the pattern tries them: the end of that line, if anything follows
    the term there; else the end of the next line with text, or of the blank lines before it. Each begins a line, so a
    list is a walk over lines: the first two items may take any of their ends, all later ones take their first.
    """
    heads = {m.start(): m.end() for m in LIST_HEAD.finditer(text)}
    if len(heads) < 3:
        return 0
    known: dict[int, list[int]] = {}

    def ends(p: int) -> list[int]:
        if p in known:
            return known[p]
        found: list[int] = []
        h = heads.get(p)
        if h is not None:
            line_end = text.find("\n", h)
            stop = len(text) if line_end < 0 else line_end
            if line_end >= 0 and LIST_TERM_IN_LINE.search(text, h, stop):
                found.append(line_end + 1)
            closed = h + len(text[h:stop].rstrip())
            term = closed - 3 if text.endswith("**:", h, closed) else closed - 2 if text.endswith("**", h, closed) else -1
            if term >= h and closed < len(text):
                text_from = WHITE_RUN.match(text, closed).end()
                after, within = text.find("\n", text_from), text.rfind("\n", closed + 1, text_from)
                found += [e + 1 for e in (after, within) if e >= 0]
        known[p] = found
        return found

    found, past = 0, 0
    for p in heads:
        if p < past:
            continue
        third = next((e2 for e1 in ends(p) for e2 in ends(e1) if ends(e2)), None)
        if third is None:
            continue
        past = third
        while ends(past):
            past = ends(past)[0]
        found += 1
    return found


@F.arrow_udf(StructType([StructField("badges", IntegerType()), StructField("feature_lists", IntegerType())]))
def markdown_lists(content: pa.Array) -> pa.Array:
    """Match counts of the two patterns whose backtracking Java cannot run on long lists, nor any engine in linear time.

    Rows that lack the patterns' literals arrive as null and are skipped.
    """
    texts = content.to_pylist()
    counts = [[count(v) if v is not None else 0 for v in texts] for count in (count_badges, count_feature_lists)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in counts], ["badges", "feature_lists"])


def markdown_list_input(content: Column, content_type: Column) -> Column:
    """Text to send to Python: documentation that holds one of the literals, null otherwise."""
    return F.when(
        (content_type == "documentation") & (content.contains("[![") | content.contains("**")), content
    )


def phrase_signals(lowered: Column, parts: Column | None = None) -> list[Column]:
    return [
        when_hit(
            hits(rule, lowered, lowered, parts=parts),
            lambda ms, rule=rule: signal(
                rule.rule_id,
                rule.name,
                capped(0.95, 0.3, 0.15, F.size(ms)),
                rule.weight,
                instances(F.size(ms), f"'{rule.name}'"),
                first(ms, 3),
            ),
        )
        for rule in PHRASE_RULES
    ]


def comment_signals(comments: Column, stripped: Column) -> list[Column]:
    code_lines = F.size(F.filter(stripped, T.is_code_line))
    obvious = F.size(
        F.filter(
            comments,
            lambda c: F.lower(c).rlike("|".join(java_regex(p) for p in OBVIOUS_COMMENTS)),
        )
    )
    n = F.size(comments)
    ratio = F.when(n > 0, F.struct(n.alias("c"), code_lines.alias("l")))

    def high_ratio(r: Column) -> Column:
        value = r["c"] / F.greatest(r["l"], F.lit(1))
        return F.when(
            value > 0.5,
            signal(
                "E24",
                "High comment ratio",
                F.least(F.lit(0.8), value * 0.6),
                0.6,
                F.concat(F.lit("Comment ratio is "), percent(value, 1), F.lit(" (AI tends to over-comment)")),
                F.array(F.concat(F.lit("Ratio: "), r["c"].cast("string"), F.lit("/"), r["l"].cast("string"))),
            ),
        )

    def stating_obvious(k: Column) -> Column:
        return F.when(
            k >= 3,
            signal(
                "E25",
                "Obvious comments",
                capped(0.85, 0.3, 0.1, k),
                0.7,
                F.concat(F.lit("Found "), k.cast("string"), F.lit(" comments stating the obvious")),
            ),
        )

    def uniform_capitals(share: Column) -> Column:
        return F.when(
            (share > 0.9) | (share < 0.1),
            signal(
                "E26",
                "Uniform comment capitalization",
                0.5,
                0.4,
                "Comments have unusually consistent capitalization style",
                F.array(F.concat(F.lit("Capitalized: "), percent(share, 0))),
            ),
        )

    capitals = F.size(F.filter(comments, lambda c: c.rlike(r"^\p{IsUppercase}")))
    return [
        let(ratio, high_ratio),
        let(F.when(n >= 3, obvious), stating_obvious),
        let(F.when(n >= 5, capitals / n), uniform_capitals),
    ]


def structure_signals(lines: Column, stripped: Column) -> list[Column]:
    indents = F.filter(
        F.transform(lines, _indent_of_filled),
        lambda i: i > 0,
    )

    def perfect(xs: Column) -> Column:
        levels = F.array_distinct(xs)
        return F.when(
            (F.size(xs) >= 10) & (F.size(levels) <= 4) & ~F.exists(xs, lambda i: i % 2 != 0),
            signal(
                "E27",
                "Perfect indentation",
                0.4,
                0.3,
                "Indentation is unusually consistent (only multiples of 2)",
                F.array(F.concat(F.lit("Indent levels: "), int_list(F.sort_array(levels)))),
            ),
        )

    def uniform_blanks(runs: Column) -> Column:
        return F.when(
            (F.size(runs) >= 5) & F.forall(runs, lambda r: r <= 2),
            signal(
                "E28",
                "Consistent blank line usage",
                0.35,
                0.25,
                "Blank line usage is unusually uniform",
                F.array(F.concat(F.lit("Pattern: "), int_list(first(runs, 10)))),
            ),
        )

    return [let(indents, perfect), let(T.blank_runs(stripped), uniform_blanks)]


def _indent_of_filled(line: Column) -> Column:
    """Indent of a non-blank line, null for a blank one."""
    rest = T.lstrip(line)
    return F.when(rest != "", F.length(line) - F.length(rest))


def _total_matches(content: Column, patterns: list[tuple[str, Column]]) -> Column:
    """Sum of match counts; a pattern is only run where its literal test holds."""
    out = F.lit(0)
    for pattern, gate in patterns:
        out = out + F.when(gate, T.count_matches(content, pattern)).otherwise(0)
    return out


def naming_signals(content: Column, parts: Column | None = None) -> list[Column]:
    two_capitals = content.rlike("[A-Z][a-z]+[A-Z]")
    joined = content.contains("_") if parts is None else any_part(parts, ("_",))
    verbose = _total_matches(content, [(VERBOSE_NAMES[0], two_capitals), (VERBOSE_NAMES[1], joined)])
    textbook = _total_matches(
        content, [(p, F.lit(True) if parts is None else any_part(parts, words)) for p, words in zip(TEXTBOOK_NAMES, TEXTBOOK_WORDS, strict=True)]
    )

    def too_verbose(n: Column) -> Column:
        return F.when(
            n >= 3,
            signal(
                "E29",
                "Verbose naming",
                capped(0.7, 0.3, 0.08, n),
                0.5,
                F.concat(F.lit("Found "), n.cast("string"), F.lit(" overly descriptive variable names")),
            ),
        )

    def too_generic(n: Column) -> Column:
        return F.when(
            n >= 10,
            signal(
                "E30",
                "Textbook naming conventions",
                capped(0.6, 0.2, 0.03, n),
                0.4,
                F.concat(
                    F.lit("High use of generic/textbook variable names ("), n.cast("string"), F.lit(" found)")
                ),
            ),
        )

    return [let(verbose, too_verbose), let(textbook, too_generic)]


def code_habit_signals(content: Column, lowered: Column, stripped: Column, parts: Column | None = None) -> list[Column]:
    def there(literal: str, told: str) -> Column:
        return content.contains(literal) if parts is None else any_part(parts, (told,)) & content.contains(literal)

    tries = F.when(there("try", *TRY_NEEDS), T.count_matches(content, TRY_BLOCK)).otherwise(0)
    filled = F.size(F.filter(stripped, lambda s: s != ""))

    def error_handling(r: Column) -> Column:
        ratio = r["t"] / (F.greatest(r["l"], F.lit(1)) / 20)
        return F.when(
            (r["l"] > 20) & (r["t"] > 0),
            F.when(
                ratio > 0.5,
                signal(
                    "E31",
                    "Excessive error handling",
                    F.least(F.lit(0.6), ratio * 0.4),
                    0.4,
                    F.concat(
                        F.lit("High ratio of try-catch blocks ("),
                        r["t"].cast("string"),
                        F.lit(" in "),
                        r["l"].cast("string"),
                        F.lit(" lines)"),
                    ),
                ),
            ),
        )

    def debugging(n: Column) -> Column:
        return F.when(
            n >= 5,
            signal(
                "E32",
                "Debug statements",
                capped(0.5, 0.2, 0.05, n),
                0.3,
                F.concat(F.lit("Multiple debug/log statements found ("), n.cast("string"), F.lit(")")),
            ),
        )

    def todos(notes: Column) -> Column:
        typical = F.size(
            F.filter(notes, lambda t: any_of([F.lower(t).contains(p) for p in TODO_PHRASES]))
        )
        return let(
            typical,
            lambda n: F.when(
                n >= 2,
                signal(
                    "E33",
                    "AI-style TODO comments",
                    capped(0.7, 0.3, 0.15, n),
                    0.5,
                    F.concat(F.lit("Found "), n.cast("string"), F.lit(" TODOs with AI-typical phrasing")),
                    first(notes, 3),
                ),
            ),
        )

    todo_gate = may_match(lowered, TODO_NEEDS, parts)
    calls = _total_matches(content, [(p, there(lit, lit.lower())) for p, lit in DEBUG_CALLS])
    return [
        let(F.struct(tries.alias("t"), filled.alias("l")), error_handling),
        let(calls, debugging),
        let(F.when(todo_gate, T.find_all(content, TODO_NOTE, "i", 1)), todos),
    ]


def docstring_signals(docstrings: Column) -> list[Column]:
    def template_hits(doc: Column) -> Column:
        out = F.lit(0)
        for pattern, literal in DOCSTRING_TEMPLATES:
            out = out + F.when(doc.contains(literal) & doc.rlike(java_regex(pattern)), 1).otherwise(0)
        return out

    hits_total = F.aggregate(docstrings, F.lit(0), lambda a, d: a + template_hits(d))
    long_counts = F.filter(F.transform(docstrings, lambda d: F.size(T.words(d))), lambda n: n > 100)

    def templated(n: Column) -> Column:
        return F.when(
            n >= 3,
            signal(
                "E34",
                "Templated docstrings",
                capped(0.7, 0.3, 0.1, n),
                0.5,
                "Docstrings follow consistent AI-style templates",
            ),
        )

    def verbose(counts: Column) -> Column:
        return F.when(
            F.size(counts) > 0,
            signal(
                "E35",
                "Verbose docstrings",
                0.5,
                0.4,
                "Found unusually detailed docstrings",
                F.array(F.concat(F.lit("Docstring with "), F.get(counts, F.lit(0)).cast("string"), F.lit(" words"))),
            ),
        )

    return [let(hits_total, templated), let(long_counts, verbose)]


def documentation_signals(
    content: Column, lowered: Column, long_sentences: Column, md_lists: Column, parts: Column | None = None
) -> list[Column]:
    """``long_sentences`` are the sums over words of long sentences; ``md_lists`` is the struct made by :func:`markdown_lists`."""
    counts = [
        (
            "E36", "AI-style section headers", 0.4,
            F.when(content.contains("## "), T.count_matches(content, SECTION_HEADERS, "im")),
        ),
        ("E37", "Emoji usage", 0.3, F.when(content.cast("binary").contains(F.lit(EMOJI_BYTES)), T.count_matches(content, EMOJI))),
        ("E38", "Multiple badges pattern", 0.5, md_lists["badges"]),
        (
            "E39", "Structured table of contents", 0.5,
            F.when(content.contains("## ") & content.contains("](#"), T.count_matches(content, CONTENTS_TABLE, "im")),
        ),
        ("E40", "Formatted feature list", 0.4, md_lists["feature_lists"]),
    ]

    def counted(rule_id: str, name: str, weight: float):
        return lambda n: F.when(
            n > 0, signal(rule_id, name, capped(0.8, 0.3, 0.1, n), weight, instances(n, name))
        )

    out = [let(n, counted(rule_id, name, weight)) for rule_id, name, weight, n in counts]
    out += [
        when_hit(
            hits(rule, lowered, lowered, parts=parts),
            lambda ms, rule=rule: signal(
                rule.rule_id,
                rule.name,
                capped(0.7, 0.2, 0.1, F.size(ms)),
                rule.weight,
                instances(F.size(ms), rule.name, "instances"),
                first(ms, 3),
            ),
            at_least=2,
        )
        for rule in PROSE_RULES
    ]

    def uniform(sums: Column) -> Column:
        stats = F.when(sums["n"] >= 5, moments_of_sums(sums))
        return let(
            stats,
            lambda st: F.when(
                st["var"] < 50,
                signal(
                    "E47",
                    "Uniform sentence length",
                    0.5,
                    0.4,
                    "Sentences have unusually consistent length",
                    F.array(
                        F.concat(
                            F.lit("Average: "), fixed(st["mean"], 1), F.lit(" words, variance: "),
                            fixed(st["var"], 1),
                        )
                    ),
                ),
            ),
        )

    out.append(let(long_sentences, uniform))
    return out


def configuration_signals(content: Column, lowered: Column, parts: Column | None = None) -> list[Column]:
    blocks = F.when(content.contains("/*"), T.count_matches(content, r"/\*.*?\*/", "s")).otherwise(0)
    tails = F.when(content.contains("//"), T.count_matches(content, r"//.*$", "m")).otherwise(0)

    def commented(n: Column) -> Column:
        return F.when(
            n >= 5,
            signal(
                "E45",
                "Verbose config comments",
                0.4,
                0.3,
                "Configuration file has unusual number of comments",
                F.array(F.concat(n.cast("string"), F.lit(" comment blocks"))),
            ),
        )

    gate = may_match(lowered, PLACEHOLDER_NEEDS, parts)
    return [
        let(blocks + tails, commented),
        when_hit(
            F.when(gate, T.find_all(content, PLACEHOLDERS, "i")),
            lambda ms: signal(
                "E46",
                "Placeholder values",
                capped(0.7, 0.3, 0.1, F.size(ms)),
                0.6,
                F.concat(F.lit("Found "), F.size(ms).cast("string"), F.lit(" placeholder values")),
                first(ms, 3),
            ),
            at_least=3,
        ),
    ]
