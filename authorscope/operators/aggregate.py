"""Sums over scored files and repo-level signals: category summaries and the repository verdict.

Every shuffle here carries numbers or short names, and every grouping is either partially aggregated before the
shuffle or a top-k that is pruned per map task, so one dominating repo does not load one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..schema import SCORED_TYPES, confidence_band, confidence_ordinal, is_definitive, repo_verdict
from .topk import leading_rows

COMMIT_WEIGHT_DEFINITIVE = 2.0
COMMIT_WEIGHT = 0.1
DEFINITIVE_FLOOR = 0.85


def exploded_signals(file_scores: DataFrame) -> DataFrame:
    """One row per file signal with its position."""
    return file_scores.select(
        "repo", "path", "content_type", F.posexplode("signals").alias("ord", "s")
    )


def type_totals(file_scores: DataFrame) -> DataFrame:
    """Partial-aggregated numbers per repo and content type, data files included."""
    p, lines = F.col("ai_probability"), F.col("line_count")
    return file_scores.groupBy("repo", "content_type").agg(
        F.count("*").alias("total_files"),
        F.sum(lines.cast("long")).alias("total_lines"),
        (F.sum(p * lines) / F.sum(lines)).alias("ai_probability"),
        F.sum(F.col("ai_line_estimate").cast("long")).alias("ai_line_estimate"),
        F.stddev_pop(p).alias("spread"),
        F.max("max_definitive").alias("max_definitive"),
    )


def file_totals(scorable: DataFrame) -> DataFrame:
    """Number of files per repo and of their lines; sums of :func:`type_totals`, from rows without scores."""
    return scorable.groupBy("repo").agg(F.count("*").alias("total_files"), F.sum(F.col("line_count").cast("long")).alias("total_lines"))


def with_counts(repos: DataFrame, counts: DataFrame) -> DataFrame:
    """Every repo with its counts, 0 where it has none."""
    names = [c for c in counts.columns if c != "repo"]
    return repos.join(counts, "repo", "left").select("repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def category_confidence(files: Column, spread: Column, config: ScoringConfig = DEFAULT) -> Column:
    agreement = F.lit(1.0) - F.least(F.lit(1.0), spread / 0.3)
    file_part = F.least(F.lit(1.0), files / 10)
    return F.when(files < config.min_files_for_high_confidence, "low").otherwise(
        confidence_band(agreement * 0.6 + file_part * 0.4)
    )


def signal_names(file_scores: DataFrame) -> DataFrame:
    """Highest score and first appearance of every signal name per repo and content type."""
    return (
        exploded_signals(file_scores)
        .where(F.col("content_type").isin(list(SCORED_TYPES)))
        .groupBy("repo", "content_type", F.col("s.name").alias("name"))
        .agg(F.max("s.score").alias("score"), F.min(F.struct("path", "ord")).alias("seen"))
    )


def leading_names(names: DataFrame, k: int = 5) -> DataFrame:
    """Names with the highest score per repo and content type; ties by first appearance."""
    order = W.partitionBy("repo", "content_type").orderBy(F.col("score").desc(), "seen")
    return (
        names.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= k)
        .groupBy("repo", "content_type")
        .agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("top"))
        .select("repo", "content_type", F.transform("top", lambda t: t["name"]).alias("top_signals"))
    )


def category_top_signals(file_scores: DataFrame, k: int = 5) -> DataFrame:
    return leading_names(signal_names(file_scores), k)


def category_summary(file_scores: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    return category_summary_of(type_totals(file_scores), signal_names(file_scores), config)


def category_summary_of(totals: DataFrame, names: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """The summary from :func:`type_totals` and :func:`signal_names`."""
    totals = totals.where(F.col("content_type").isin(list(SCORED_TYPES)))
    return totals.join(leading_names(names), ["repo", "content_type"], "left").select(
        "repo",
        "content_type",
        "total_files",
        "total_lines",
        "ai_probability",
        "ai_line_estimate",
        category_confidence(F.col("total_files"), F.col("spread"), config).alias("confidence"),
        F.coalesce("top_signals", F.array().cast("array<string>")).alias("top_signals"),
    )


def repo_signals(history: DataFrame | None, markers: DataFrame, summary: DataFrame) -> DataFrame:
    """Repo-level signals in assembly order: commit history, marker files in path order, marker summary.

    Columns ``phase, path, ord`` order the rows of a repo.
    """
    rows = markers.select("repo", F.lit(1).alias("phase"), "path", F.col("k").alias("ord"), "s").unionByName(
        summary.select("repo", F.lit(2).alias("phase"), F.lit("").alias("path"), F.lit(0).alias("ord"), "s")
    )
    if history is None:
        return rows
    return history.select("repo", F.lit(0).alias("phase"), "path", "ord", "s").unionByName(rows)


def commit_totals(signals: DataFrame) -> DataFrame:
    s = F.col("s")
    return signals.groupBy("repo").agg(
        (F.sum(s["score"] * s["weight"]) / F.sum(s["weight"])).alias("commit_probability"),
        F.max(F.when(is_definitive(s), s["score"])).alias("commit_definitive"),
        F.count_if(F.lower(s["name"]).contains("commit") & (s["score"] > 0.8)).alias("ai_attributed_commits"),
    )


def slim_signals(signals: DataFrame) -> DataFrame:
    """Name, score and weight of repo-level signals; ``place`` orders them."""
    return signals.select(
        "repo", F.struct("phase", "path", "ord").alias("place"),
        F.col("s.name").alias("name"), F.col("s.score").alias("score"), F.col("s.weight").alias("weight"),
    )


def file_signals(file_scores: DataFrame) -> DataFrame:
    """The same of the signals of files, which come before those of the repo."""
    return slim_signals(exploded_signals(file_scores).withColumn("phase", F.lit(-1)))


def all_signals(file_scores: DataFrame, signals: DataFrame) -> DataFrame:
    """Name, score and weight of every signal of a repo; ``place`` orders them (files first)."""
    return file_signals(file_scores).unionByName(slim_signals(signals))


def strongest_signals(signals: DataFrame) -> DataFrame:
    """Those of ``signals`` that :func:`top_ai_signals` and :func:`top_human_signals` can name. The strongest of two
    tables are among the strongest of each, so tables of them can be merged."""
    score, weight = F.col("score"), F.col("weight")
    sides = ((score > 0.5, score * weight, 10), (score < 0.4, (F.lit(1.0) - score) * weight, 5))
    best = [leading_rows(signals.where(keep).withColumn("strength", s), ["repo"], [F.col("strength").desc(), "place"], k) for keep, s, k in sides]
    return best[0].unionByName(best[1]).select("repo", "place", "name", "score", "weight")


def top_names(signals: DataFrame, keep: Column, strength: Column, k: int, name: str) -> DataFrame:
    """Names of the ``k`` strongest kept signals per repo, repeats included; ties by place."""
    kept = signals.where(keep).select("repo", "place", "name", strength.alias("strength"))
    return (
        leading_rows(kept, ["repo"], [F.col("strength").desc(), "place"], k)
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("top"))
        .select("repo", F.transform("top", lambda t: t["name"]).alias(name))
    )


def top_ai_signals(signals: DataFrame) -> DataFrame:
    score, weight = F.col("score"), F.col("weight")
    return top_names(signals, score > 0.5, score * weight, 10, "top_ai_signals")


def top_human_signals(signals: DataFrame) -> DataFrame:
    score, weight = F.col("score"), F.col("weight")
    return top_names(signals, score < 0.4, (F.lit(1.0) - score) * weight, 5, "top_human_signals")


def repo_totals(totals: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Fold the (at most four) type rows of each repo into one."""
    factor = (
        F.when(F.col("content_type") == "code", config.code_weight)
        .when(F.col("content_type") == "documentation", config.docs_weight)
        .when(F.col("content_type") == "configuration", config.config_weight)
    )
    weight = factor * F.col("total_lines")
    level = F.when(
        factor.isNotNull(),
        confidence_ordinal(category_confidence(F.col("total_files"), F.col("spread"), config)),
    )
    return totals.groupBy("repo").agg(
        F.sum("total_files").alias("total_files"),
        F.sum("total_lines").alias("total_lines"),
        F.sum(F.col("ai_probability") * weight).alias("weighted"),
        F.sum(weight).alias("weight"),
        F.avg(level).alias("level"),
        F.max("max_definitive").alias("file_definitive"),
    )


def overall_probability(weighted: Column, weight: Column, commit_p: Column, definitive_commit: Column) -> Column:
    """Line-weighted category mean joined with the commit mean at its constant weight; 0 without either."""
    commit_weight = F.when(commit_p.isNull(), 0.0).when(definitive_commit, COMMIT_WEIGHT_DEFINITIVE).otherwise(
        COMMIT_WEIGHT
    )
    total = F.coalesce(weight, F.lit(0.0)) + commit_weight
    return F.when(
        total > 0,
        (F.coalesce(weighted, F.lit(0.0)) + F.coalesce(commit_p, F.lit(0.0)) * commit_weight) / total,
    ).otherwise(0.0)


def repo_summary(
    repos: DataFrame, file_scores: DataFrame, signals: DataFrame, config: ScoringConfig = DEFAULT
) -> DataFrame:
    """One row per repo in ``repos`` (column ``repo``), whether or not it has scored files or signals."""
    return repo_summary_of(repos, type_totals(file_scores), all_signals(file_scores, signals), signals, config)


def repo_summary_of(
    repos: DataFrame, totals: DataFrame, every: DataFrame, signals: DataFrame, config: ScoringConfig = DEFAULT
) -> DataFrame:
    """The summary from :func:`type_totals`, :func:`all_signals` (or the strongest of them) and repo-level signals."""
    joined = (
        repos.select("repo")
        .join(repo_totals(totals, config), "repo", "left")
        .join(commit_totals(signals), "repo", "left")
        .join(top_ai_signals(every), "repo", "left")
        .join(top_human_signals(every), "repo", "left")
    )
    mean = overall_probability(
        F.col("weighted"), F.col("weight"), F.col("commit_probability"), F.col("commit_definitive").isNotNull()
    )
    floor = F.greatest("file_definitive", "commit_definitive") * DEFINITIVE_FLOOR
    names = F.array().cast("array<string>")
    return joined.select(
        "repo",
        F.greatest(mean, F.coalesce(floor, F.lit(0.0))).alias("overall_ai_probability"),
        F.when(floor.isNotNull(), "very_high")
        .when(F.col("level").isNull(), "very_low")
        .otherwise(confidence_band(F.col("level") / 4))
        .alias("overall_confidence"),
        F.coalesce("total_files", F.lit(0)).alias("total_files"),
        F.coalesce("total_lines", F.lit(0)).alias("total_lines"),
        F.coalesce("top_ai_signals", names).alias("top_ai_signals"),
        F.coalesce("top_human_signals", names).alias("top_human_signals"),
        F.coalesce("ai_attributed_commits", F.lit(0)).alias("ai_attributed_commits"),
    ).withColumn("verdict", repo_verdict(F.col("overall_ai_probability")))
