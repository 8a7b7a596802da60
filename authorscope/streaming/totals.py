"""Category and repository sums of a stream of files, kept by merging.

Batch ``b`` of a stream writes its file scores and markers under ``batch=b``, then the state of version ``b``: the state of
version ``b - 1`` merged with what the batch adds. A batch that is replayed overwrites what it wrote and starts again from
version ``b - 1``, so it counts once. The state holds a row per (repo, content type), per (repo, content type, signal name),
the few strongest signals of a repo, and its repos: it grows with the repos, not with their files.

A file that arrives again in a later batch is a file of its own, as it would be twice in a batch table. The file cap needs a
whole repository and is left to the batch job. Older versions and batches are not deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, ScoringConfig
from ..operators import aggregate as A
from ..operators.intake import select_files
from ..operators.markers import marker_rows, multiple_markers
from ..plans.repositories import RepositoryScores, score_files

PARTS = ("totals", "names", "strongest", "repos")


@dataclass(frozen=True)
class State:
    """What can be merged: ``totals`` (sums, and mean and squared deviations of probabilities), ``names``, ``strongest``,
    ``repos``."""

    totals: DataFrame
    names: DataFrame
    strongest: DataFrame
    repos: DataFrame


def state_of(files: DataFrame, file_scores: DataFrame) -> State:
    """The state of one batch: its files, and the scores of those that are scored."""
    p, lines = F.col("ai_probability"), F.col("line_count")
    totals = file_scores.groupBy("repo", "content_type").agg(
        F.count("*").alias("n"),
        F.sum(lines.cast("long")).alias("lines"),
        F.sum(p * lines).alias("weighted"),
        F.sum(F.col("ai_line_estimate").cast("long")).alias("ai_lines"),
        F.avg(p).alias("mean"),
        (F.var_pop(p) * F.count("*")).alias("squares"),
        F.max("max_definitive").alias("max_definitive"),
    )
    strongest = A.strongest_signals(A.file_signals(file_scores))
    return State(totals, A.signal_names(file_scores), strongest, files.select("repo").distinct())


def merged(one: State, other: State) -> State:
    """The state of both batches."""
    both = one.totals.unionByName(other.totals).groupBy("repo", "content_type")
    n = F.col("n")
    totals = both.agg(
        F.sum(n).alias("n"),
        F.sum("lines").alias("lines"),
        F.sum("weighted").alias("weighted"),
        F.sum("ai_lines").alias("ai_lines"),
        (F.sum(F.col("mean") * n) / F.sum(n)).alias("mean"),
        # of two batches the squared distance of the means is added, which loses nothing to rounding
        (F.sum("squares") + F.when(F.count("*") == 2, F.pow(F.max("mean") - F.min("mean"), 2.0) * F.min(n) * F.max(n) / F.sum(n)).otherwise(0.0)).alias("squares"),
        F.max("max_definitive").alias("max_definitive"),
    )
    names = one.names.unionByName(other.names).groupBy("repo", "content_type", "name")
    names = names.agg(F.max("score").alias("score"), F.min("seen").alias("seen"))
    strongest = A.strongest_signals(one.strongest.unionByName(other.strongest))
    return State(totals, names, strongest, one.repos.union(other.repos).distinct())


def _stored(spark: SparkSession, folder: str, version: int) -> State:
    return State(*[spark.read.parquet(f"{folder}/state/version={version}/{part}") for part in PARTS])


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_batch(files: DataFrame, batch: int, folder: str, config: ScoringConfig = DEFAULT) -> None:
    """Score one micro-batch and write the state of version ``batch``; calling it again with the same batch changes nothing.

    Batches are numbered from 0 without gaps, as Structured Streaming numbers them.
    """
    spark = files.sparkSession
    kept = select_files(files, config)
    scores = _store(score_files(kept, config), f"{folder}/files/batch={batch}")
    _store(marker_rows(kept), f"{folder}/markers/batch={batch}")
    state = state_of(files, scores)
    if batch:
        state = merged(_stored(spark, folder, batch - 1), state)
    for part in PARTS:
        _store(getattr(state, part), f"{folder}/state/version={batch}/{part}")
    _store(spark.range(1), f"{folder}/done/batch={batch}")


def write_repository_scores(files: DataFrame, folder: str, checkpoint: str, config: ScoringConfig = DEFAULT, **trigger) -> StreamingQuery:
    """Score a streaming ``files`` table and keep category and repository sums in ``folder``."""
    return (
        files.writeStream.foreachBatch(lambda df, batch: add_batch(df, batch, folder, config))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_repository_scores(spark: SparkSession, folder: str, config: ScoringConfig = DEFAULT, history: DataFrame | None = None) -> RepositoryScores:
    """The scores of all files of finished batches, as the batch job over them gives. ``history`` holds the signals of
    commits, if there are commits (``score_commits``)."""
    last = spark.read.parquet(f"{folder}/done").agg(F.max("batch")).first()[0]
    finished = lambda name: spark.read.parquet(f"{folder}/{name}").where(F.col("batch") <= last).drop("batch")
    state, marks = _stored(spark, folder, last), finished("markers")
    signals = A.repo_signals(history, marks, multiple_markers(marks))
    n = F.col("n")
    totals = state.totals.select(
        "repo",
        "content_type",
        n.alias("total_files"),
        F.col("lines").alias("total_lines"),
        (F.col("weighted") / F.col("lines")).alias("ai_probability"),
        F.col("ai_lines").alias("ai_line_estimate"),
        F.sqrt(F.col("squares") / n).alias("spread"),
        "max_definitive",
    )
    repos = state.repos if history is None else state.repos.union(history.select("repo")).distinct()
    every = state.strongest.unionByName(A.slim_signals(signals))
    return RepositoryScores(
        file_scores=finished("files"),
        signals=signals,
        categories=A.category_summary_of(totals, state.names, config),
        summary=A.repo_summary_of(repos, totals, every, signals, config),
    )
