"""Every pN query on empty tables, and on tables with more columns than it needs."""

import os

import pytest

from textlake.llm import queries


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for f in os.listdir(data):
        spark.read.parquet(f"{data}/{f}").limit(0).write.parquet(str(at / f))
    return str(at)


@pytest.fixture(scope="module")
def wide(spark, data, tmp_path_factory):
    """The documents with clashing names, a null row and a repeated row."""
    at = tmp_path_factory.mktemp("wide")
    for f in os.listdir(data):
        d = spark.read.parquet(f"{data}/{f}")
        if f in ("documents.parquet", "adapted_document.parquet"):
            null = d.limit(1).selectExpr(*(f"cast(null as {t}) as {c}" for c, t in d.dtypes))
            d = d.unionByName(d.limit(3)).unionByName(null).selectExpr("*", "'x' as k", "1 as keys", "'y' as n_tokens", "2 as subject", "3 as form", "4 as h", "5 as t", "6 as part", "7 as grp")
        d.write.parquet(str(at / f))
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert not rows or name in ("p3_found", "p3_shares")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_wide(spark, wide, name):
    queries.QUERIES[name](spark, wide).write.format("noop").mode("overwrite").save()
