"""Report tables and per-repo JSON and Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScoringConfig
from ..functions.exprs import fixed, percent, thousands
from ..operators.topk import leading_rows
from ..plans.durable import durable
from ..plans.repositories import RepositoryScores
from ..schema import SCORED_TYPES, is_definitive, risk_band, snippet_verdict

TITLES = {"code": "Code", "documentation": "Documentation", "configuration": "Configuration"}
COMMIT_WORDS = ("commit", "author", "co-author", "attributed", "marker file")


def _top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """First ``k`` rows per repo with their rank ``r``."""
    return leading_rows(df, ["repo"], list(order), k).withColumnRenamed("rank", "r")


def title_case(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def flagged_files(file_scores: DataFrame, limit: int = 10) -> DataFrame:
    """Files above 0.4, highest first, with their first emitted signal."""
    return _top(
        file_scores.where(F.col("ai_probability") > 0.4), limit, F.col("ai_probability").desc(), "path"
    ).select(
        "repo",
        "r",
        "path",
        F.initcap(F.substring("content_type", 1, 4)).alias("type"),
        "line_count",
        percent(F.col("ai_probability"), 1).alias("ai_probability"),
        risk_band(F.col("ai_probability")).alias("band"),
        F.coalesce(F.get("signals", F.lit(0))["name"], F.lit("-")).alias("top_signal"),
    )


def detailed_files(file_scores: DataFrame) -> DataFrame:
    """Every file with its first five signals and two evidence texts each (cut at 60), highest first.

    ``sort_key`` orders the files of a repo; no global or per-repo sort is forced.
    """
    shown = F.transform(
        F.slice("signals", 1, 5),
        lambda s: F.struct(
            s["name"].alias("name"),
            percent(s["score"], 0).alias("score"),
            fixed(s["weight"], 1).alias("weight"),
            F.transform(F.slice(s["evidence"], 1, 2), lambda e: F.substring(e, 1, 60)).alias("evidence"),
        ),
    )
    return file_scores.select(
        "repo",
        (-F.col("ai_probability")).alias("sort_key"),
        "path",
        "content_type",
        percent(F.col("ai_probability"), 1).alias("ai_probability"),
        "confidence",
        shown.alias("signals"),
    )


def definitive_panel(scores: RepositoryScores, limit: int = 10) -> DataFrame:
    """First definitive signals per repo, files before repo-level signals, two evidence texts cut at 80."""
    of_files = scores.file_scores.where(F.col("max_definitive").isNotNull()).select(
        "repo", F.lit(-1).alias("phase"), "path", F.posexplode("signals").alias("ord", "s")
    )
    rows = of_files.unionByName(scores.signals.select("repo", "phase", "path", "ord", "s")).where(
        is_definitive(F.col("s"))
    )
    return _top(rows, limit, "phase", "path", "ord").select(
        "repo",
        "r",
        F.col("s.name").alias("name"),
        percent(F.col("s.score"), 0).alias("score"),
        F.col("s.description").alias("description"),
        F.transform(F.slice("s.evidence", 1, 2), lambda e: F.substring(e, 1, 80)).alias("evidence"),
    )


def commit_panel(signals: DataFrame, limit: int = 8) -> DataFrame:
    """First commit-related repo signals; evidence longer than 70 characters is cut and marked."""
    name = F.lower(F.col("s.name"))
    related = signals.where(name.rlike("|".join(COMMIT_WORDS)))
    return _top(related, limit, "phase", "path", "ord").select(
        "repo",
        "r",
        F.when(F.col("s.score") > 0.8, "🤖").otherwise("📝").alias("icon"),
        F.col("s.name").alias("name"),
        percent(F.col("s.score"), 0).alias("score"),
        F.col("s.description").alias("description"),
        F.transform(
            F.slice("s.evidence", 1, 2),
            lambda e: F.when(F.length(e) > 70, F.concat(F.substring(e, 1, 70), F.lit("..."))).otherwise(e),
        ).alias("evidence"),
    )


def category_breakdown(summary: DataFrame, categories: DataFrame) -> DataFrame:
    """Three rows per repo with display texts; "-" where a category is missing."""
    dimension = F.explode(F.array(*[F.lit(t) for t in SCORED_TYPES])).alias("content_type")
    rows = summary.select("repo", dimension).join(categories, ["repo", "content_type"], "left")
    dash = F.lit("-")
    return rows.select(
        "repo",
        F.initcap("content_type").alias("category"),
        F.coalesce(F.col("total_files").cast("string"), dash).alias("files"),
        F.coalesce(thousands(F.col("total_lines")), dash).alias("lines"),
        F.coalesce(percent(F.col("ai_probability"), 1), dash).alias("ai_probability"),
        F.when(F.col("ai_probability").isNull(), dash).otherwise(risk_band(F.col("ai_probability"))).alias("band"),
        F.coalesce(title_case(F.col("confidence")), dash).alias("confidence"),
    )


def wide_categories(categories: DataFrame) -> DataFrame:
    """One row per repo with a struct column per category (null when missing)."""
    body = F.struct(
        "total_files", "total_lines", "ai_probability", "ai_line_estimate", "confidence", "top_signals"
    )
    return categories.groupBy("repo").agg(
        *[F.first(F.when(F.col("content_type") == t, body), ignorenulls=True).alias(t) for t in SCORED_TYPES]
    )


def summary_texts(summary: DataFrame, categories: DataFrame) -> DataFrame:
    """Percent texts per repo, "N/A" for a missing category."""
    wide = summary.join(wide_categories(categories), "repo", "left")
    return wide.select(
        "repo",
        percent(F.col("overall_ai_probability"), 1).alias("overall_ai_probability"),
        F.col("overall_confidence").alias("confidence"),
        *[F.coalesce(percent(F.col(t)["ai_probability"], 1), F.lit("N/A")).alias(t) for t in SCORED_TYPES],
        "total_files",
        "total_lines",
        risk_band(F.col("overall_ai_probability")).alias("band"),
    )


def snippet_view(scored: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Strongest signals of each snippet (from its own array) with the snippet's verdict."""
    def strength(s: Column) -> Column:
        return s["score"] * s["weight"]

    ranked = F.slice(
        F.sort_array(
            F.transform(
                "signals",
                lambda s, i: F.struct(
                    (-strength(s)).alias("neg"),
                    i.alias("i"),
                    s["name"].alias("name"),
                    percent(s["score"], 0).alias("score"),
                    fixed(s["weight"], 1).alias("weight"),
                    F.transform(F.slice(s["evidence"], 1, 2), lambda e: F.substring(e, 1, 60)).alias("evidence"),
                ),
            )
        ),
        1,
        limit,
    )
    return scored.select(
        key,
        percent(F.col("ai_probability"), 1).alias("ai_probability"),
        title_case(F.col("confidence")).alias("confidence"),
        snippet_verdict(F.col("ai_probability")).alias("verdict"),
        F.posexplode_outer(ranked).alias("i", "s"),
    ).select(
        key, "ai_probability", "confidence", "verdict", (F.col("i") + 1).alias("r"),
        *[F.col(f"s.{c}").alias(c if c != "score" else "signal_score") for c in ("name", "score", "weight", "evidence")],
    )


def _report_struct(
    scores: RepositoryScores, analyzed_at: Column | None, url: Column | None, duration_seconds: float | None
) -> tuple[DataFrame, list[Column]]:
    """(a row per repo, the fields of its document but for the files)."""
    wide = scores.summary.join(wide_categories(scores.categories), "repo", "left")
    stamp = F.date_format(F.current_timestamp() if analyzed_at is None else analyzed_at, "yyyy-MM-dd'T'HH:mm:ss")
    fields = [
        F.col("repo").alias("repository"),
        (F.col("repo") if url is None else url).alias("url"),
        stamp.alias("timestamp"),
        F.struct(
            "overall_ai_probability", F.col("overall_confidence").alias("confidence"), "total_files", "total_lines",
            F.lit(duration_seconds).cast("double").alias("analysis_duration_seconds"),
        ).alias("summary"),
        F.struct(*SCORED_TYPES).alias("breakdown"),
        F.col("top_ai_signals"),
        F.col("top_human_signals"),
    ]
    return wide, fields


def json_report_lines(
    scores: RepositoryScores,
    analyzed_at: Column | None = None,
    url: Column | None = None,
    duration_seconds: float | None = None,
) -> DataFrame:
    """The report of every repo as rows (repo, path, line), sorted by (repo, path): a header line per repo, whose path
    is null, and one line per file. No row holds more than one file, and the sort spreads a repo over many tasks.

    ``url`` is an expression over ``repo``; the duration is that of the whole job, as measured by the caller.
    """
    return _report_lines(scores, analyzed_at, url, duration_seconds).orderBy("repo", F.col("path").asc_nulls_first())


def _report_lines(
    scores: RepositoryScores, analyzed_at: Column | None, url: Column | None, duration_seconds: float | None
) -> DataFrame:
    wide, fields = _report_struct(scores, analyzed_at, url, duration_seconds)
    header = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    heads = wide.select("repo", F.lit(None).cast("string").alias("path"), header.alias("line"))
    lines = scores.file_scores.select("repo", "path", F.to_json(_file_struct(), {"ignoreNullFields": "false"}).alias("line"))
    return heads.unionByName(lines)


def write_json_reports(
    scores: RepositoryScores,
    folder: str,
    analyzed_at: Column | None = None,
    url: Column | None = None,
    duration_seconds: float | None = None,
    file_bytes: int = 128 * 1024 * 1024,
) -> None:
    """Write :func:`json_report_lines` as text files of about ``file_bytes``, in order of (repo, path) within and across
    files, whose names sort. Lines are written once and measured, then cut into ranges of (repo, path): how many there are
    follows from their bytes, and a hot repo has as many as it needs. ``folder`` must not exist.
    """
    lines = durable(_report_lines(scores, analyzed_at, url, duration_seconds), "report-lines")
    size = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    order = [F.col("repo"), F.col("path").asc_nulls_first()]
    ranged = lines.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    ranged.select("line").write.text(folder)


def json_reports(
    scores: RepositoryScores,
    config: ScoringConfig | None = None,
    analyzed_at: Column | None = None,
    url: Column | None = None,
    duration_seconds: float | None = None,
) -> DataFrame:
    """One JSON document per repo, with all its files in one row: for repos whose file list fits in a row.

    Where that is not known use :func:`json_report_lines`, which has the same contents as rows. A ``config``, if given,
    must bound the list by ``max_files``. ``url`` and the duration are as there.
    """
    if config is not None and config.max_files is None:
        raise ValueError("this config sets no max_files; use json_report_lines for uncapped tables")
    files = scores.file_scores.select("repo", "path", _file_struct().alias("f"))
    listed = files.groupBy("repo").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("path", "f"))), lambda x: x["f"]).alias("files")
    )
    wide, fields = _report_struct(scores, analyzed_at, url, duration_seconds)
    document = F.struct(*fields, F.coalesce("files", F.array().cast(listed.schema["files"].dataType)).alias("files"))
    wide = wide.join(listed, "repo", "left")
    return wide.select("repo", F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))


def _file_struct() -> Column:
    return F.struct(
        "path",
        F.col("content_type").alias("type"),
        "ai_probability",
        "confidence",
        "line_count",
        F.transform(
            "signals",
            lambda s: F.struct(*[s[c].alias(c) for c in ("name", "score", "weight", "description")]),
        ).alias("signals"),
    )


def json_file_lines(file_scores: DataFrame) -> DataFrame:
    """One JSON line per file."""
    return file_scores.select("repo", F.to_json(_file_struct()).alias("line"))


def markdown_reports(scores: RepositoryScores, analyzed_at: Column | None = None) -> DataFrame:
    """One Markdown document per repo: summary, breakdown, top signals, top files."""
    stamp = F.date_format(F.current_timestamp() if analyzed_at is None else analyzed_at, "yyyy-MM-dd HH:mm:ss")
    leading = (
        _top(scores.file_scores, 15, F.col("ai_probability").desc(), "path")
        .where(F.col("ai_probability") > 0.3)
        .select(
            "repo",
            "r",
            F.concat_ws(
                " | ", "path", "content_type", F.col("line_count").cast("string"), percent(F.col("ai_probability"), 1)
            ).alias("cells"),
        )
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list(F.struct("r", "cells"))).alias("rows"))
        .select("repo", F.transform("rows", lambda x: F.concat(F.lit("| "), x["cells"], F.lit(" |"))).alias("file_rows"))
    )
    wide = scores.summary.join(wide_categories(scores.categories), "repo", "left").join(leading, "repo", "left")

    def category_row(kind: str) -> Column:
        c = F.col(kind)
        return F.when(c.isNull(), f"| {TITLES[kind]} | - | - | - | - |").otherwise(
            F.concat(
                F.lit(f"| {TITLES[kind]} | "),
                F.concat_ws(
                    " | ", c["total_files"].cast("string"), thousands(c["total_lines"]),
                    percent(c["ai_probability"], 1), c["confidence"],
                ),
                F.lit(" |"),
            )
        )

    def row(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))

    text = F.array(
        F.concat(F.lit("# Provenance report: "), F.col("repo")),
        F.lit(""),
        F.concat(F.lit("**Analyzed:** "), stamp),
        F.lit(""), F.lit("## Summary"), F.lit(""),
        F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        row("Overall AI Probability", percent(F.col("overall_ai_probability"), 1)),
        row("Confidence", title_case(F.col("overall_confidence"))),
        row("Files Analyzed", F.col("total_files").cast("string")),
        row("Lines Analyzed", thousands(F.col("total_lines"))),
        F.lit(""), F.lit("## Breakdown by Content Type"), F.lit(""),
        F.lit("| Category | Files | Lines | AI Probability | Confidence |"),
        F.lit("|----------|-------|-------|----------------|------------|"),
        *[category_row(t) for t in SCORED_TYPES],
        F.lit(""), F.lit("## Top AI Indicators"), F.lit(""),
    )
    bullets = F.when(
        F.size("top_ai_signals") > 0, F.transform("top_ai_signals", lambda n: F.concat(F.lit("- "), n))
    ).otherwise(F.array(F.lit("- No significant AI indicators found")))
    files_head = F.array(
        F.lit(""), F.lit("## Files with Highest AI Probability"), F.lit(""),
        F.lit("| File | Type | Lines | AI Probability |"), F.lit("|------|------|-------|----------------|"),
    )
    rows = F.coalesce("file_rows", F.array().cast("array<string>"))
    return wide.select("repo", F.array_join(F.concat(text, bullets, files_head, rows), "\n").alias("report"))
