import glob
import os

import duckdb
import pytest

from ledgerlark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    other = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())


def test_natural_order(spark):
    from pyspark.sql import functions as F

    from ledgerlark.functions import sortkeys

    df = spark.createDataFrame([("a.10",), ("a.9",), ("B",), ("a.09",), ("A.9b2",), ("a.9B10",)], "name string")
    assert [r[0] for r in df.orderBy(*sortkeys.natural(F.col("name"))).collect()] == ["a.09", "a.9", "A.9b2", "a.9B10", "a.10", "B"]


@pytest.mark.parametrize("name", ["content_groups", "duplicate_counts"])
def test_texts_of_one_crc_are_as_in_sql(spark, tmp_path, name):
    """At 1 GB some texts share the CRC; a text may be null."""
    texts = ["text 51847", "text 130841", "text 74707", "text 208378", "text 51847", None, "", "text 1", "text 130841"]
    docs = spark.createDataFrame([(i, x, "en", f"src{i % 3}") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    other = c.sql(plans.SQL[name])
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())
