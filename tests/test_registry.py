"""Registered queries against their SQL on the smallest tables. ``AUTHORSCOPE_ALL=1`` runs every key."""

import os

import pytest

from checks.compare import compare, duck
from checks.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "a02 a03 a05 a06 a07 a08 a10 a11 a12 a13 b01 b04 c02 c04 c05 c08 c09 c10 d01 d02 d03_attribution_04 d04 d08 e01 e24 "
    "e28 e33 e38 e46 e47 f02 f03 f04 f06_repeated_3 f07 f10 f11 g01 g03 h01 h09 h11 h13 h18 i01 i06 i10 j01 j02 j03 j05 j09 j11 k01 k03"
).split()
KEYS = [k for k in QUERIES if os.environ.get("AUTHORSCOPE_ALL") or k.startswith(tuple(SAMPLE))]


@pytest.fixture(scope="module")
def sql():
    return duck(SF)


def test_every_operator_is_registered():
    families = {"a": 14, "b": 4, "c": 11, "d": 9, "e": 47, "f": 13, "g": 4, "h": 18, "i": 14, "j": 11, "k": 4}
    numbers = {(k[0], int(k[1:3])) for k in QUERIES}
    missing = {(f, n) for f, top in families.items() for n in range(1, top + 1)} - numbers
    assert not missing
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, sql, key):
    ok, line = compare(spark, sql, key, QUERIES[key], ORACLES.get(key), SF)
    assert ok, line
