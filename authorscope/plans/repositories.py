"""Repository, file, snippet and commit scoring for whole tables at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions import text as T
from ..operators import aggregate, commits as C, intake, markers
from ..operators.scoring import score_rows
from .durable import durable


@dataclass(frozen=True)
class RepositoryScores:
    """Tables keyed by repo. ``signals`` holds the repo-level signals (commit history and marker files)."""

    file_scores: DataFrame
    signals: DataFrame
    categories: DataFrame
    summary: DataFrame


def score_files(files: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Score each eligible file. Map-only, so it also runs on a streaming table of files."""
    return score_rows(_scorable(files), ["repo", "path"], config)


def _scorable(files: DataFrame) -> DataFrame:
    return intake.eligible(intake.classified(files.where(F.col("content").isNotNull())))


def score_texts(
    texts: DataFrame,
    text_col: str = "content",
    type_col: str | None = "content_type",
    config: ScoringConfig = DEFAULT,
) -> DataFrame:
    """Score snippets: no marker rules and no skipping; the type defaults to code. Other columns are kept."""
    keys = [c for c in texts.columns if c not in {text_col, type_col, "content_type", "line_count"}]
    kind = F.coalesce(F.col(type_col), F.lit("code")) if type_col else F.lit("code")
    rows = texts.select(
        *keys,
        F.col(text_col).alias("content"),
        kind.alias("content_type"),
        T.line_count(F.col(text_col)).alias("line_count"),
    )
    return score_rows(rows, keys, config, markers=False)


def score_commits(commits: DataFrame, config: ScoringConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Per-commit scores, and the history signals of each repo as rows (repo, path, ord, s)."""
    newest = C.newest_commits(commits, config)
    return C.commit_scores(newest), C.history_signals(newest, config)


def repository_signals(files: DataFrame, commits: DataFrame | None = None, config: ScoringConfig = DEFAULT) -> DataFrame:
    """The repo-level signals of :func:`score_repositories` alone. They follow from paths and commits, so no text is scored."""
    return _repository_signals(intake.cap_files(intake.select_files(files, config), config), commits, config)


def repository_totals(files: DataFrame, commits: DataFrame | None = None, config: ScoringConfig = DEFAULT) -> DataFrame:
    """``total_files`` and ``total_lines`` of :func:`score_repositories` alone. They follow from which files are scored,
    not from their scores, so no text is."""
    kept = intake.cap_files(intake.select_files(files, config), config)
    return aggregate.with_counts(_repositories(files, commits, config), aggregate.file_totals(_scorable(kept)))


def attributed_commits(files: DataFrame, commits: DataFrame | None = None, config: ScoringConfig = DEFAULT) -> DataFrame:
    """``ai_attributed_commits`` of :func:`score_repositories` alone, from the repo-level signals."""
    found = aggregate.commit_totals(repository_signals(files, commits, config)).select("repo", "ai_attributed_commits")
    return aggregate.with_counts(_repositories(files, commits, config), found)


def _repositories(files: DataFrame, commits: DataFrame | None, config: ScoringConfig) -> DataFrame:
    repos = files.select("repo").distinct()
    if commits is None or not config.enable_commit_analysis:
        return repos
    return repos.union(commits.select("repo").distinct()).distinct()


def _repository_signals(kept: DataFrame, commits: DataFrame | None, config: ScoringConfig) -> DataFrame:
    marks = durable(markers.marker_rows(kept), "marker-rows")
    history = None
    if commits is not None and config.enable_commit_analysis:
        history = C.history_signals(C.newest_commits(commits, config), config)
    return durable(aggregate.repo_signals(history, marks, markers.multiple_markers(marks)), "repo-signals")


def score_repositories(
    files: DataFrame, commits: DataFrame | None = None, config: ScoringConfig = DEFAULT
) -> RepositoryScores:
    """Score every repository in ``files`` and ``commits``.

    Scored files, marker rows and repo signals are written once to the shared folder: several aggregates read them,
    none re-runs the rules, and a lost executor costs only its own tasks.
    """
    kept = intake.cap_files(intake.select_files(files, config), config)
    file_scores = durable(score_files(kept, config), "file-scores")
    signals = _repository_signals(kept, commits, config)
    repos = _repositories(files, commits, config)
    return RepositoryScores(
        file_scores=file_scores,
        signals=signals,
        categories=aggregate.category_summary(file_scores, config),
        summary=aggregate.repo_summary(repos, file_scores, signals, config),
    )
