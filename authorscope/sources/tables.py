"""Tables of files, commits and changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession, location: str, schema: str | None = None, fmt: str = "parquet", *, spread: bool = False
) -> DataFrame:
    """Read a Parquet or JSON table; give ``schema`` for JSON so no pass over the data infers it.

    ``spread`` is for text tables stored as a few large splits, see :func:`spread_rows`.
    """
    reader = spark.read.format(fmt)
    table = (reader.schema(schema) if schema else reader).load(location)
    return spread_rows(table) if spread else table


def spread_rows(scan: DataFrame, per_core: int = 3) -> DataFrame:
    """Deal rows to all cores when the scan has fewer splits than that; large tables pass unchanged.

    Scoring costs far more per byte than a shuffle, and a Parquet file cannot be split inside a row group, so a table
    of a few big row groups would leave most cores idle. Only for plain scans: the split count is read from the plan.
    Rows are dealt by their place in the scan, which a task that runs again finds the same; dealing them in turn would sort
    each split by the hash of its rows first.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism * per_core
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.withColumn("_place", F.monotonically_increasing_id()).repartition(wanted, "_place").drop("_place")
