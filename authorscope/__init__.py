"""Provenance scoring of text and source-code tables on Spark."""

from .config import DEFAULT, ScoringConfig
from .plans.repositories import RepositoryScores, score_commits, score_files, score_repositories, score_texts

__all__ = [
    "DEFAULT",
    "RepositoryScores",
    "ScoringConfig",
    "score_commits",
    "score_files",
    "score_repositories",
    "score_texts",
]
