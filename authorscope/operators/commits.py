"""Commit-history rules: per commit, then across all commits of each repo.

Rules over one commit are projections. Rules over a repo read two tables that one pass over the messages makes: a row
per commit with its markers, and a count per (repo, kind, value) of first words, hours, names, addresses and moments.
No row holds a history, so a repo with a third of all commits is spread like any other. A cap on the newest commits of
each repo applies only when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions import text as T
from ..functions.exprs import any_of, built_once, int_list, let, percent
from ..functions.regex import SPACE, java_regex
from ..plans.durable import durable
from ..schema import signal
from .bursts import burst_statistics
from .markers import commit_markers, compact, is_ai_author
from .rules import first
from .scoring import weighted_mean
from .topk import leading_rows

# ---- fixed values: message, author and bot patterns ----
MESSAGE_RULES = (
    (
        "H2", r"^(?:feat|fix|docs|style|refactor|test|chore)\([^)]+\):\s+.{50,}$",
        "Conventional commit with long description", 0.3,
    ),
    ("H3", r"this commit (?:adds|updates|fixes|removes|implements)\b", "AI commit explanation style", 0.6),
    ("H4", r"(?:please|kindly|hope|help)\b", "Polite language in commit", 0.5),
    (
        "H5", r"(?:generated|created|written) (?:by|with|using) (?:ai|gpt|copilot|claude|chatgpt)\b",
        "Explicit AI attribution", 0.95,
    ),
    ("H6", r"co-authored-by:.*(?:copilot|ai|bot|gpt)\b", "AI co-author tag", 0.9),
    ("H7", "[\U0001F300-\U0001F9FF].*[\U0001F300-\U0001F9FF]", "Multiple emojis", 0.4),
    ("H8", "^[✨\U0001F680\U0001F4DD\U0001F41B\U0001F527]\\s+[A-Z]", "Emoji prefix pattern", 0.4),
    (
        "H9",
        r"(?:implement|add|create|update).*(?:functionality|feature|module|component).*(?:that|which|to)",
        "Verbose description", 0.4,
    ),
)
CONVENTIONAL_PREFIX = r"^(?:feat|fix|docs|style|refactor|test|chore|ci|build|perf)"
AI_NAMES = (
    (r"^claude$", "Claude AI author", 0.95),
    (r"claude\s*(?:opus|sonnet|haiku)", "Claude model author", 0.98),
    (r"copilot", "Copilot author", 0.90),
    (r"^gpt", "GPT author", 0.90),
    (r"chatgpt", "ChatGPT author", 0.95),
    (r"anthropic", "Anthropic author", 0.95),
    (r"openai", "OpenAI author", 0.90),
    (r"^cursor$", "Cursor AI author", 0.85),
    (r"^aider$", "Aider AI author", 0.90),
    (r"codeium", "Codeium author", 0.85),
)
BOT_NAMES = (r"bot\b", r"dependabot", r"renovate", r"github-actions", r"ci[-_]?bot", r"auto[-_]?commit")
AI_ADDRESSES = (("anthropic.com", "Anthropic"), ("copilot@github", "Copilot"))
SIGNIFICANT_BURST = 5
# ---- end of fixed values ----


# The same language for Java, which would try every verb with every noun of a line: from the start of a line the
# earliest verb and the earliest noun after it leave the most room, and are not given up again.
LINE_WISE = {
    "H9": r"(?m)^(?>.*?(?:implement|add|create|update))(?>.*?(?:functionality|feature|module|component)).*?(?:that|which|to)",
}


def newest_commits(commits: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """The newest ``max_commits`` commits of each repo with their rank (0 = newest); messages stripped. Without a cap
    all commits, and no rank: nothing is moved."""
    if config.max_commits is None:
        return commits.withColumn("message", T.strip(F.col("message")))
    return leading_rows(
        commits, ["repo"], [F.col("date").isNull(), -F.unix_micros("date"), "sha"], config.max_commits
    ).withColumns({"rank": F.col("rank") - 1, "message": T.strip(F.col("message"))})


def change_totals(commit_files: DataFrame) -> DataFrame:
    """Files changed, insertions and deletions per commit."""
    return commit_files.groupBy("repo", "sha").agg(
        F.count("*").cast("int").alias("files_changed"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
    )


def file_history(commits: DataFrame, commit_files: DataFrame, max_commits: int = 10) -> DataFrame:
    """The newest commits touching each path: short sha, subject line, author, date."""
    newest = W.partitionBy("repo", "path").orderBy(F.col("date").desc_nulls_last(), "sha")
    leading = (
        commit_files.select("repo", "sha", "path")
        .join(commits.select("repo", "sha", "date"), ["repo", "sha"])
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= max_commits)
    )
    # messages and authors are joined to the kept rows only
    return leading.join(commits.select("repo", "sha", "message", "author"), ["repo", "sha"]).select(
        "repo",
        "path",
        "rank",
        F.substring("sha", 1, 8).alias("sha"),
        F.substring_index(T.strip(F.col("message")), "\n", 1).alias("subject"),
        "author",
        "date",
    )


@built_once
def style_signals() -> Column:
    """Message-style signals of one commit, in rule order."""
    message = F.col("message")
    lowered = F.lower(message)
    out = [
        F.when(
            lowered.rlike(java_regex(LINE_WISE.get(rule_id, pattern), "i")),
            signal(
                rule_id, name, 0.6, weight, f"Commit message matches '{name}' pattern",
                F.array(F.substring(message, 1, 50)),
            ),
        )
        for rule_id, pattern, name, weight in MESSAGE_RULES
    ]

    def very_long(n: Column) -> Column:
        return F.when(
            n > 50,
            signal(
                "H10", "Very long commit message", 0.5, 0.3,
                F.concat(F.lit("Commit message has "), n.cast("string"), F.lit(" words (unusually detailed)")),
            ),
        )

    return compact(out + [let(F.size(T.words(message)), very_long)])


def commit_scores(commits: DataFrame) -> DataFrame:
    """Score of each commit from its message style; 0 without signals. Map-only."""
    return commits.withColumn("signals", style_signals()).select(
        "repo",
        "sha",
        F.substring("message", 1, 100).alias("message"),
        F.coalesce(weighted_mean(F.col("signals")), F.lit(0.0)).alias("ai_probability"),
        "files_changed",
        "signals",
    )


@built_once
def _marker_array() -> Column:
    return commit_markers(F.col("message"), F.col("_author"), F.col("_email"))


def with_commit_markers(commits: DataFrame) -> DataFrame:
    """Add lower-cased author fields and the attribution signals of each commit."""
    return commits.withColumns(
        {
            "_author": F.lower(F.coalesce(F.col("author"), F.lit(""))),
            "_email": F.lower(F.coalesce(F.col("author_email"), F.lit(""))),
        }
    ).withColumn("markers", _marker_array())


#: Kinds of values that the rules across commits count.
WORD, HOUR, NAME, ADDRESS, AI_NAME, MOMENT = "word", "hour", "name", "address", "ai", "moment"
RANKED = (WORD, HOUR)


@dataclass(frozen=True)
class History:
    """What the rules across commits read: ``marked`` has a row per commit without its message, ``values`` a row (repo,
    kind, value, n, first) per distinct value. Both are written once, so messages are read and matched once."""

    marked: DataFrame
    values: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.values.where(F.col("kind") == kind)


def history(commits: DataFrame, config: ScoringConfig = DEFAULT) -> History:
    """``commits`` is the output of :func:`newest_commits`."""
    has_message = F.coalesce(F.length("message"), F.lit(0)) > 0
    local = F.from_utc_timestamp(F.to_utc_timestamp("date", F.current_timezone()), F.lit(config.time_zone))
    marked = with_commit_markers(commits).select(
        "repo",
        "sha",
        F.unix_micros("date").alias("at"),
        "author",
        "_author",
        "_email",
        "markers",
        has_message.alias("has_message"),
        (has_message & F.coalesce(F.lower("message").rlike(java_regex(CONVENTIONAL_PREFIX)), F.lit(False))).alias("conventional"),
        F.when(has_message, F.lower(F.regexp_extract("message", f"[^{SPACE}]+", 0))).alias("word"),
        F.hour(local).cast("string").alias("hour"),
    )
    marked = durable(marked, "marked-commits")
    attributed = (F.size("markers") > 0) & is_ai_author(F.col("_author"))
    kinds = {
        WORD: F.col("word"),
        HOUR: F.col("hour"),
        NAME: F.col("_author"),
        ADDRESS: F.col("_email"),
        AI_NAME: F.when(attributed, F.col("author")),
        MOMENT: F.col("at").cast("string"),
    }
    facts = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items() if kind not in RANKED])
    counts = marked.select("repo", F.inline(facts)).where("value IS NOT NULL").groupBy("repo", "kind", "value").agg(F.count("*").alias("n"))
    # the order of commits settles ties of words and hours
    newest = F.struct(F.col("at").isNull().alias("undated"), (-F.col("at")).alias("age"), "sha")
    ranked = F.array(*[F.struct(F.lit(kind).alias("kind"), kinds[kind].alias("value"), newest.alias("newest")) for kind in RANKED])
    ranks = marked.select("repo", F.inline(ranked)).where("value IS NOT NULL").groupBy("repo", "kind", "value")
    values = ranks.agg(F.count("*").alias("n"), F.min("newest").alias("first")).unionByName(counts, allowMissingColumns=True)
    return History(marked, durable(values, "history-values"))


def top_value(values: DataFrame, name: str) -> DataFrame:
    """``repo`` and the most frequent value as ``name`` (neg, first, value); ties go to the newest commit's."""
    return values.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("neg"), "first", "value")).alias(name))


def repo_statistics(found: History, config: ScoringConfig = DEFAULT) -> DataFrame:
    """One row per repo with what the rules across commits read."""
    totals = found.marked.groupBy("repo").agg(
        F.count_if(F.size("markers") > 0).cast("int").alias("ai_commits"),
        F.count("*").cast("int").alias("total_commits"),
        F.count_if("has_message").cast("int").alias("messages"),
        F.count_if("conventional").cast("int").alias("conventional"),
        F.count("at").cast("int").alias("dated"),
    )
    ai_authors = found.of(AI_NAME).groupBy("repo").agg(F.array_sort(F.collect_set("value")).alias("ai_authors"))
    words = top_value(found.of(WORD), "top_word")
    hours = top_value(found.of(HOUR), "top_hour")
    moments = found.of(MOMENT).select("repo", F.col("value").cast("long").alias("at"), "n")
    return (
        totals.withColumn("ai_commit_ratio", F.col("ai_commits") / F.col("total_commits"))
        .join(ai_authors, "repo", "left")
        .withColumn("ai_authors", F.coalesce("ai_authors", F.array().cast("array<string>")))
        .join(words, "repo", "left")
        .join(hours, "repo", "left")
        .join(burst_statistics(moments, config.bulk_commit_window_hours, SIGNIFICANT_BURST), "repo", "left")
    )


def burst_signal(config: ScoringConfig = DEFAULT) -> Column:
    """A burst of at least the threshold. Reads the statistics columns, like the rules below."""
    largest = F.col("largest_burst")
    return F.when(
        (F.col("total_commits") >= config.bulk_commit_threshold) & (largest >= config.bulk_commit_threshold),
        signal(
            "H11",
            "Bulk commit burst",
            F.least(F.lit(0.7), F.lit(0.3) + largest * 0.03),
            0.5,
            F.concat(
                F.lit("Found burst of "), largest.cast("string"),
                F.lit(f" commits in {config.bulk_commit_window_hours}h window"),
            ),
            F.array(F.concat(F.lit("Burst sizes: "), int_list(F.col("first_bursts")))),
        ),
    )


def message_pattern_signals() -> list[Column]:
    """Uniform conventional prefixes and one dominating first word; both need five messages."""
    n, total, top = F.col("conventional"), F.col("messages"), F.col("top_word")
    share = lambda count: count / F.greatest(total, F.lit(1))
    conventional = F.when(
        (total >= 5) & (share(n) > 0.9),
        signal(
            "H12", "Uniform conventional commits", 0.4, 0.3,
            F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" commits use conventional format")),
            F.array(F.lit("High consistency may indicate tooling or AI")),
        ),
    )
    repetitive = F.when(
        (total >= 5) & (share(-top["neg"]) > 0.5),
        signal(
            "H13", "Repetitive commit prefixes", 0.45, 0.35,
            F.concat(
                F.lit("'"), top["value"], F.lit("' starts "), (-top["neg"]).cast("string"), F.lit("/"),
                total.cast("string"), F.lit(" commits"),
            ),
        ),
    )
    return [conventional, repetitive]


def hour_signal() -> Column:
    """One hour of the day holds more than 40 % of at least ten dated commits."""
    total, top = F.col("dated"), F.col("top_hour")
    return F.when(
        (total >= 10) & (-top["neg"] / F.greatest(total, F.lit(1)) > 0.4),
        signal(
            "H14", "Time-concentrated commits", 0.35, 0.25,
            F.concat(
                (-top["neg"]).cast("string"), F.lit("/"), total.cast("string"), F.lit(" commits at "),
                top["value"].cast("string"), F.lit(":00"),
            ),
            F.array(F.lit("May indicate automated or batched work")),
        ),
    )


def ai_name_signals(names: Column) -> Column:
    """One signal per (distinct name, matching pattern), names in order."""
    def of(name: Column) -> Column:
        return compact(
            [
                F.when(
                    name.rlike(java_regex(pattern, "i")),
                    signal(
                        f"H15.{i:02d}", f"DEFINITIVE: {label}", score, 0.95,
                        F.concat(F.lit("Found AI author: "), name), F.array(name),
                    ),
                )
                for i, (pattern, label, score) in enumerate(AI_NAMES, 1)
            ]
        )

    return F.flatten(F.transform(names, of))


def ai_address_signals(addresses: Column) -> Column:
    """Vendor addresses; the first matching vendor wins."""
    (vendor, vendor_name), (pilot, pilot_name) = AI_ADDRESSES

    def of(address: Column) -> Column:
        return F.when(
            address.contains(vendor),
            signal(
                "H16", f"DEFINITIVE: {vendor_name} email author", 0.98, 0.95,
                F.concat(F.lit(f"Found {vendor_name} email: "), address), F.array(address),
            ),
        ).when(
            address.contains(pilot),
            signal(
                "H16", f"DEFINITIVE: GitHub {pilot_name} email", 0.98, 0.95,
                F.concat(F.lit(f"Found {pilot_name} email: "), address), F.array(address),
            ),
        )

    return F.array_compact(F.transform(addresses, of))


def name_signals(found: History) -> DataFrame:
    """(repo, name, ord, s) of authors named like a model or vendor."""
    names = found.of(NAME).withColumnRenamed("value", "name")
    return names.select("repo", "name", F.posexplode(ai_name_signals(F.array("name"))).alias("ord", "s"))


def address_signals(found: History) -> DataFrame:
    """(repo, name, ord, s) of vendor addresses."""
    names = found.of(ADDRESS).withColumnRenamed("value", "name")
    return names.select("repo", "name", F.posexplode(ai_address_signals(F.array("name"))).alias("ord", "s"))


def bot_signals(found: History) -> DataFrame:
    """(repo, s): distinct names that look like bots and match no AI pattern; the first three are shown."""
    name = F.col("name")
    bots = found.of(NAME).select("repo", F.col("value").alias("name")).where(
        any_of([name.rlike(java_regex(p)) for p in BOT_NAMES])
        & ~any_of([name.rlike(java_regex(p, "i")) for p, _, _ in AI_NAMES])
    )
    shown = leading_rows(bots, ["repo"], ["name"], 3).groupBy("repo").agg(F.sort_array(F.collect_list("name")).alias("bots"))
    return shown.select(
        "repo",
        signal("H17", "Bot authors detected", 0.3, 0.2, F.concat(F.lit("Found bot-like author names: "), F.array_join("bots", ", ")), F.col("bots")).alias("s"),
    )


def ratio_signal() -> Column:
    """Share of attributed commits above 10 %. Reads the statistics columns."""
    n, ratio = F.col("ai_commits"), F.col("ai_commit_ratio")
    return F.when(
        ratio > 0.1,
        signal(
            "D7", "Significant AI commit ratio", F.least(F.lit(0.95), F.lit(0.5) + ratio * 0.5), 0.9,
            F.concat(
                n.cast("string"), F.lit("/"), F.col("total_commits").cast("string"), F.lit(" commits ("),
                percent(ratio, 0), F.lit(") have AI markers"),
            ),
            F.when(
                F.size("ai_authors") > 0,
                F.array(F.concat(F.lit("AI authors: "), F.array_join("ai_authors", ", "))),
            ).otherwise(F.array().cast("array<string>")),
        ),
    )


def summary_signal() -> Column:
    n = F.col("ai_commits")
    return F.when(
        n > 0,
        signal(
            "D9", "DEFINITIVE: AI-attributed commits found", 0.95, 0.98,
            F.concat(n.cast("string"), F.lit(" commits have explicit AI attribution")), first(F.col("ai_authors"), 5),
        ),
    )


def history_signals(commits: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """(repo, path, ord, s): every commit-history signal as a row; ``path`` and ``ord`` give the assembly order.

    ``commits`` is the output of :func:`newest_commits`.
    """
    found = history(commits, config)
    age = F.lpad((F.lit(9_000_000_000_000_000_000) - F.col("at")).cast("string"), 20, "0")
    newest_first = F.concat(F.lit("0"), F.coalesce(age, F.lit("~")), F.lit(" "), F.col("sha"))
    per_commit = found.marked.select("repo", newest_first.alias("path"), F.posexplode("markers").alias("ord", "s"))
    statistics = repo_statistics(found, config)
    across = [ratio_signal(), burst_signal(config), *message_pattern_signals(), hour_signal()]
    places = [F.struct(F.lit(str(i)).alias("path"), F.lit(0).alias("ord"), s.alias("s")) for i, s in enumerate([*across, summary_signal()], 1)]
    places[-1] = F.struct(F.lit("9").alias("path"), F.lit(0).alias("ord"), summary_signal().alias("s"))
    of_repo = statistics.select("repo", F.inline(F.filter(F.array(*places), lambda p: p["s"].isNotNull())))
    named = lambda rows, digit: rows.select("repo", F.concat(F.lit(digit), "name").alias("path"), "ord", "s")
    bots = bot_signals(found).select("repo", F.lit("8").alias("path"), F.lit(0).alias("ord"), "s")
    out = per_commit
    for part in (of_repo, named(name_signals(found), "6"), named(address_signals(found), "7"), bots):
        out = out.unionByName(part)
    return out
