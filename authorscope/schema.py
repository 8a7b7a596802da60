"""Table schemas, the signal struct and the score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNAL = (
    "struct<rule_id:string,name:string,score:double,weight:double,description:string,evidence:array<string>>"
)
SIGNALS = f"array<{SIGNAL}>"

FILES_SCHEMA = "repo string, path string, size bigint, content string"
RAW_FILES_SCHEMA = "repo string, path string, size bigint, content binary"
COMMITS_SCHEMA = (
    "repo string, sha string, message string, author string, author_email string, date timestamp, "
    "files_changed int, insertions int, deletions int"
)

CONTENT_TYPES = ("code", "documentation", "configuration", "data", "unknown")
SCORED_TYPES = ("code", "documentation", "configuration")
CONFIDENCE_LEVELS = ("very_low", "low", "medium", "high", "very_high")


def signal(
    rule_id: str,
    name: str | Column,
    score: Column | float,
    weight: float,
    description: Column | str,
    evidence: Column | None = None,
) -> Column:
    """One signal struct."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        as_col(name).alias("name"),
        as_col(score).cast("double").alias("score"),
        F.lit(float(weight)).alias("weight"),
        as_col(description).alias("description"),
        (F.array().cast("array<string>") if evidence is None else evidence).alias("evidence"),
    ).cast(SIGNAL)


def confidence_band(score: Column) -> Column:
    return (
        F.when(score < 0.2, "very_low")
        .when(score < 0.4, "low")
        .when(score < 0.6, "medium")
        .when(score < 0.8, "high")
        .otherwise("very_high")
    )


def confidence_ordinal(band: Column) -> Column:
    out = None
    for ordinal, name in enumerate(CONFIDENCE_LEVELS):
        out = F.when(band == name, ordinal) if out is None else out.when(band == name, ordinal)
    return out


def risk_band(probability: Column) -> Column:
    return (
        F.when(probability < 0.3, "green")
        .when(probability < 0.5, "yellow")
        .when(probability < 0.7, "orange1")
        .otherwise("red")
    )


def repo_verdict(probability: Column) -> Column:
    return F.when(probability < 0.3, 0).when(probability < 0.7, 1).otherwise(2)


def snippet_verdict(probability: Column) -> Column:
    return F.when(probability < 0.5, 0).otherwise(1)


def is_definitive(sig: Column) -> Column:
    return sig["name"].startswith("DEFINITIVE:") | (sig["weight"] >= 0.9)
