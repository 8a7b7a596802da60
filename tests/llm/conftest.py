import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
LONG = "far away words in rows " * 12_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, ties, and columns with taken names."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
        (1, "another text of the same id", "en", "a", 2),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \n\t ", "en", "b", 4),
        (None, "a text without an id but with words enough to count", "de", None, 5),
        (None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG)),
        (6, "One two, three four five six seven eight nine ten eleven TWELVE!", "fr", "c", 9),
        (7, "été über 中文 \U0001f600", "fr", "c", 7),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, names)
    taken = (
        "size text_crc32 law shard slot grown_shard n_words n_hit n_items items_sha256 contaminated n_removed kept kept_sha256 "
        "held_out score predicted evidence site_rate n_links component_id"
    ).split()
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("theirs") for name in taken})


@pytest.fixture(scope="session")
def stored(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(stored):
    return stored.limit(0)
