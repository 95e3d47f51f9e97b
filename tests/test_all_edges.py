"""Every query on empty tables, and on tables with nulls in every column, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tracelink.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CLASHING = "record_id cluster_id attribute value count n rank score node component label key place name location".split()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Up to 40 rows of each table, some of them twice, a row of nulls, and one with a null in each column in turn."""
    at = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet").limit(40)
        rows = df.collect()
        nulls = [tuple(None if i == j else v for j, v in enumerate(rows[0])) for i in range(len(df.columns))]
        own = spark.createDataFrame([*rows, *rows[:5], (None,) * len(df.columns), *nulls], df.schema)
        for c in CLASHING:
            if c not in df.columns:
                own = own.withColumn(c, F.lit("own"))
        own.coalesce(1).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty(spark, empty, name):
    registry.queries()[name](spark, empty).collect()


#: Many jobs each, and held to such rows in tests of their own.
OWN_TESTS = ("h1_", "h2_", "h3_", "h4_", "h6_", "h8_", "i1_", "i2_", "j2_", "linked_")


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if not n.startswith(OWN_TESTS)))
def test_odd(spark, odd, name):
    registry.queries()[name](spark, odd).collect()
