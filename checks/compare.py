"""Run every query beside its SQL and compare rows; prints one line per query that differs.

``python -m checks.compare [sf] [key prefix ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("authorscope")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 9)
    return value


SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
}


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose SQL type is not the counterpart of the Spark type."""
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{n} {t}/{described.get(n)}" for n, t in df.dtypes if SAME_TYPE.get(t) != described.get(n)]


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, key: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got_rows = df.collect()
    spent = time.time() - start
    if sql is None:
        return True, f"{key}: {len(got_rows)} rows, no SQL, {spent:.1f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return False, f"{key}: columns {sorted(df.columns)} against {sorted(names)}"
    got, want = rows_of(df.columns, got_rows), rows_of(names, cursor.fetchall())
    types = type_differences(df, con, sql)
    if got == want:
        note = f", types {types}" if types else ""
        return not types, f"{key}: {len(got_rows)} rows, {spent:.1f}s{note}"
    extra, missing = list((got - want).items()), list((want - got).items())
    return False, (
        f"{key}: {sum(got.values())} against {sum(want.values())} rows, {len(extra)} differ\n   spark {sorted(map(str, extra))[:3]}"
        f"\n   sql   {sorted(map(str, missing))[:3]}"
    )


def main() -> int:
    from .queries import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for key, query in QUERIES.items():
        if prefixes and not key.startswith(prefixes):
            continue
        try:
            ok, line = compare(spark, con, key, query, ORACLES.get(key), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, line = False, f"{key}: {type(error).__name__} {str(error)[:600]}"
        bad += not ok
        print(("ok   " if ok else "DIFF ") + line, flush=True)
    print(f"{bad} of {len(QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
