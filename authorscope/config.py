"""Job options. Defaults are the values the scoring rules are defined with; caps apply only when given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

# Batch of chunk texts -> one perplexity each (None where the scorer gives none).
Scorer = Callable[[list[str]], list[float | None]]


@dataclass(frozen=True)
class ScoringConfig:
    # Which rule families run. Attribution markers are always on.
    enable_heuristic: bool = True
    enable_statistical: bool = True
    enable_predictability: bool = False
    enable_commit_analysis: bool = True

    # Intake. Caps on files per repo, bytes per file and newest commits per repo; ``None`` is no cap.
    max_files: int | None = None
    max_file_size: int | None = None
    max_commits: int | None = None
    ignore_patterns: tuple[str, ...] | None = None
    # Bytes at the start of a file that tell text from binary; ``None`` looks at the whole content.
    sniff_bytes: int | None = 8192

    # Text guards
    min_content_length: int = 50
    min_tokens: int = 50
    ngram_sizes: tuple[int, ...] = (2, 3, 4)

    # Perplexity
    scorer: Scorer | None = None
    code_perplexity_threshold: float = 50.0
    text_perplexity_threshold: float = 30.0
    max_chunk_size: int = 512
    min_chunk_size: int = 50
    max_chunks: int | None = None

    # Commit bursts
    bulk_commit_window_hours: int = 1
    bulk_commit_threshold: int = 10
    # Zone in which the busiest hour is told
    time_zone: str = "UTC"

    # Aggregation
    code_weight: float = 0.5
    docs_weight: float = 0.3
    config_weight: float = 0.2
    min_signals_for_high_confidence: int = 5
    min_files_for_high_confidence: int = 3

    # Per-repo cut-off rows are broadcast up to this many bytes of text and shuffle-joined beyond it.
    broadcast_limit_bytes: int = 64 * 1024 * 1024


DEFAULT = ScoringConfig()
