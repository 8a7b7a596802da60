"""Attribution markers: tool files, attribution text, attributed authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import any_of, let
from ..functions.regex import java_regex
from ..schema import SIGNALS, signal
from .classify import file_name
from .rules import PatternRule, first, hits, may_match, when_hit
from .topk import leading_rows

WEIGHT = 0.95

# ---- fixed values: marker files, attribution patterns, author patterns ----
MARKER_FILES = (
    ("claude.md", "Claude Code configuration file", 0.95),
    (".claude", "Claude configuration directory", 0.95),
    (".claude/settings.json", "Claude settings file", 0.95),
    (".claude/commands", "Claude custom commands", 0.90),
    (".github/copilot-instructions.md", "Copilot instructions file", 0.90),
    (".copilot", "Copilot configuration", 0.85),
    (".cursor", "Cursor AI configuration", 0.90),
    (".cursorrules", "Cursor AI rules file", 0.90),
    (".cursorignore", "Cursor AI ignore file", 0.85),
    (".aider", "Aider AI configuration", 0.90),
    (".aider.conf.yml", "Aider configuration", 0.90),
    (".aiderignore", "Aider ignore file", 0.85),
    (".codeium", "Codeium AI configuration", 0.85),
    (".ai", "AI configuration directory", 0.80),
    ("ai-instructions.md", "AI instructions file", 0.85),
)

# The literals in the fourth column avoid i, k and s: those letters have non-ASCII case variants. Where the rest of a literal
# is a common word, all that lower-casing makes of the variants is listed.
ATTRIBUTION = (
    (r"🤖\s*Generated with \[Claude", "Claude Code generation marker", 0.98, ("🤖",)),
    (r"Generated with Claude Code", "Claude Code attribution", 0.98, ("th claude code",)),
    (r"Co-Authored-By:\s*Claude", "Claude co-author attribution", 0.95, ("co-authored-by:",)),
    (r"Co-Authored-By:.*<noreply@anthropic\.com>", "Anthropic co-author email", 0.98, ("noreply@anthrop",)),
    (r"@anthropic\.com", "Anthropic email in attribution", 0.90, ("@anthrop",)),
    (r"Generated by GitHub Copilot", "Copilot generation marker", 0.95, ("hub cop",)),
    (r"Co-Authored-By:.*Copilot", "Copilot co-author", 0.95, ("co-authored-by:",)),
    (r"Co-Authored-By:.*<copilot@github\.com>", "Copilot email attribution", 0.98, ("co-authored-by:",)),
    (r"GitHub Copilot suggested", "Copilot suggestion marker", 0.85, ("hub cop",)),
    (r"Generated by ChatGPT", "ChatGPT generation marker", 0.95, ("by chatgpt",)),
    (r"Generated by GPT-?4", "GPT-4 generation marker", 0.95, ("by gpt",)),
    (r"Co-Authored-By:.*OpenAI", "OpenAI co-author", 0.90, ("co-authored-by:",)),
    (r"Written by AI assistant", "Generic AI attribution", 0.85, ("tten by a",)),
    (r"Generated by Cursor", "Cursor generation marker", 0.95, ("by cur",)),
    (r"aider:", "Aider commit marker", 0.90, ("aider:", "a\u0131der:", "ai\u0307der:")),
    (r"AI-generated", "Generic AI-generated marker", 0.85, ("-generated",)),
    (r"Generated by AI", "Generic AI generation", 0.85, ("generated by a",)),
    (
        r"This (?:code|file) was (?:generated|written|created) (?:by|with|using) (?:an? )?"
        r"(?:AI|LLM|GPT|Claude|Copilot)",
        "AI generation statement",
        0.90,
        ("generated", "tten", "created"),
    ),
    (r"🤖.*Generated", "Robot emoji with Generated", 0.90, ("🤖",)),
    (r"✨.*(?:AI|Claude|Copilot|GPT)", "Sparkle emoji with AI tool", 0.75, ("✨",)),
)

AUTHORS = (
    (r"^claude$", "Author named 'claude'", 0.95),
    (r"^copilot$", "Author named 'copilot'", 0.95),
    (r"^github.?copilot$", "Author named 'github-copilot'", 0.98),
    (r"^gpt$", "Author named 'gpt'", 0.90),
    (r"^chatgpt$", "Author named 'chatgpt'", 0.95),
    (r"^openai$", "Author named 'openai'", 0.90),
    (r"^cursor$", "Author named 'cursor'", 0.85),
    (r"^aider$", "Author named 'aider'", 0.90),
    (r"^ai-?assistant$", "Author named 'ai-assistant'", 0.90),
    (r"^codeium$", "Author named 'codeium'", 0.85),
    (r"anthropic", "Author containing 'anthropic'", 0.90),
    (r"noreply@anthropic", "Anthropic noreply email", 0.95),
    (r"copilot@github", "Copilot GitHub email", 0.98),
)
# ---- end of fixed values ----

ATTRIBUTION_RULES = tuple(
    PatternRule(f"D3.{i:02d}", name, pattern, WEIGHT, needs, score)
    for i, (pattern, name, score, needs) in enumerate(ATTRIBUTION, 1)
)


def marker_signals(path: Column) -> list[Column]:
    """One signal per marker that ends the path or equals the file name."""
    lowered, name = F.lower(path), file_name(path)
    return [
        F.when(
            lowered.endswith(marker) | (name == marker),
            signal("D1", f"AI marker file: {marker}", score, WEIGHT, description, F.array(path)),
        )
        for marker, description, score in MARKER_FILES
    ]


def attribution_signals(content: Column, lowered: Column, parts: Column | None = None) -> list[Column]:
    """One signal per attribution pattern found in the text, with its count and first three hits."""
    return [
        when_hit(
            hits(rule, content, lowered, "im", parts),
            lambda ms, rule=rule: signal(
                rule.rule_id,
                rule.name,
                rule.score,
                WEIGHT,
                F.concat(
                    F.lit("Found "), F.size(ms).cast("string"), F.lit(" instance(s) of definitive AI marker")
                ),
                first(ms, 3),
            ),
        )
        for rule in ATTRIBUTION_RULES
    ]


def marker_rows(files: DataFrame) -> DataFrame:
    """Marker signals of all files of a repo, as rows. Reads ``repo`` and ``path`` only.

    A cheap suffix test drops nearly all paths before the signal array is built.
    """
    suffixes = any_of([F.lower("path").endswith(m) for m, _, _ in MARKER_FILES])
    return (
        files.select("repo", "path")
        .where(suffixes)
        .select("repo", "path", F.posexplode(F.array_compact(F.array(*marker_signals(F.col("path"))))).alias("k", "s"))
    )


def multiple_markers(markers: DataFrame) -> DataFrame:
    """One summary signal for each repo with at least two marker signals; evidence is the first five paths.

    The five paths come from a per-task-pruned top-k, so a repo full of markers is never gathered.
    """
    counts = markers.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    leading = (
        leading_rows(markers.select("repo", "path", "k"), ["repo"], ["path", "k"], 5)
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("top"))
    )
    return counts.join(leading, "repo").select(
        "repo",
        "n",
        signal(
            "D2",
            "Multiple AI tool markers",
            0.95,
            WEIGHT,
            F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" AI tool marker files")),
            F.transform("top", lambda t: t["path"]),
        ).alias("s"),
    )


#: Any of the author patterns, in one scan of a name.
ANY_AUTHOR = java_regex("|".join(f"(?:{pattern})" for pattern, _, _ in AUTHORS), "i")


def message_marker_signals(message: Column, lowered: Column) -> list[Column]:
    """Attribution patterns in the message of one commit."""
    return [
        F.when(
            may_match(lowered, rule.needs) & message.rlike(java_regex(rule.pattern, "i")),
            signal(
                rule.rule_id.replace("D3", "D4"),
                f"Commit: {rule.name}",
                rule.score,
                WEIGHT,
                "Commit message contains AI marker",
                F.array(F.substring(message, 1, 100)),
            ),
        )
        for rule in ATTRIBUTION_RULES
    ]


def person_marker_signals(author: Column, email: Column) -> list[Column]:
    """Patterns of author names and addresses of one commit; both are lower-cased."""
    out = []
    for i, (pattern, name, score) in enumerate(AUTHORS, 1):
        regex = java_regex(pattern, "i")
        out.append(
            F.when(
                author.rlike(regex),
                signal(
                    f"D5.{i:02d}", f"AI Author: {name}", score, WEIGHT, "Commit author matches AI pattern",
                    F.array(author),
                ),
            )
        )
        out.append(
            F.when(
                email.rlike(regex),
                signal(
                    f"D6.{i:02d}", f"AI Author Email: {name}", score, WEIGHT,
                    "Commit author email matches AI pattern", F.array(email),
                ),
            )
        )
    return out


def commit_markers(message: Column, author: Column, email: Column) -> Column:
    """Signals of one commit: attribution patterns in the message, then author name and e-mail patterns. The patterns
    for people are only gone through where one of them matches."""
    people = F.when(is_ai_author(author) | is_ai_author(email), compact(person_marker_signals(author, email)))
    # Bound, as each literal test in the array would lower-case the message again.
    told = let(F.lower(message), lambda lowered: compact(message_marker_signals(message, lowered)))
    return F.concat(told, F.coalesce(people, F.array().cast(SIGNALS)))


def is_ai_author(author: Column) -> Column:
    return author.rlike(ANY_AUTHOR)


def compact(signals: list[Column]) -> Column:
    """Signals that fired, in rule order."""
    if not signals:
        return F.array().cast(SIGNALS)
    return F.array_compact(F.array(*signals))
