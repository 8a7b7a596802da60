"""Reading tables, row identity and clashing column names, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authorscope.plans.durable import durable

__all__ = ["durable", "read", "text_of", "without", "spread_join", "ascii_words", "WORD"]

#: Groups with more than one part in HOT of all rows are hot: there are fewer than HOT of them, whatever the data.
HOT = 10_000

#: A word as the contracts of mixing and substring dedup define it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(df[column], F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add, compared as Spark does, without regard to case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def ascii_words(text: Column) -> Column:
    """Number of words, runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, salt: Column) -> DataFrame:
    """Left join of ``rows`` with ``groups`` on the string ``key``; ``groups`` is a stored table of a row per group with
    ``size``, its number of rows, which is not returned. Hot groups are broadcast, and their rows, as those without a
    key, go through the shuffle under keys made of ``salt`` instead of meeting in one task. No key may begin with "~"
    and go on with a number alone."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > total // HOT
    added = [c for c in groups.columns if c not in (key, size)]
    few = groups.where(hot).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in added])
    many = groups.where(~hot).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in added])
    cold = F.col("_hot_key").isNull() & F.col(key).isNotNull()
    joined = rows.join(F.broadcast(few), F.col(key) == F.col("_hot_key"), "left")
    joined = joined.withColumn("_at", F.when(cold, F.col(key)).otherwise(F.concat(F.lit("~"), salt.cast("string"))))
    joined = joined.join(many, F.col("_at") == F.col("_cold_key"), "left")
    return joined.select(*[joined[f"`{c}`"] for c in rows.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in added])
