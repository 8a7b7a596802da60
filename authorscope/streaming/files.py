"""Continuous scoring of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, ScoringConfig
from ..operators.intake import select_files
from ..plans.repositories import score_files


def write_file_scores(
    files: DataFrame, output: str, checkpoint: str, config: ScoringConfig = DEFAULT, **trigger
) -> StreamingQuery:
    """Score a streaming ``files`` table and append Parquet.

    The per-repo file cap needs a whole repository and is left to the batch job that reads the output.
    """
    scores = score_files(select_files(files, config), config)
    return (
        scores.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
