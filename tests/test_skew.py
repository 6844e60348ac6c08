"""Joins and rankings with broadcasts off, a hot key, and maps among the columns."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from sparkproof.operators.skew import rank_in_group, skew_join

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield spark
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", ["join01_link_results", "agg13_link_status_counts", "rul04_broken_links", "join13_chosen_extraction", "agg02_verdict_per_report"])
def test_queries_without_broadcast(no_broadcast, name):
    import __spark_entry__ as entry
    from check import compare, duck

    problem, n = compare(no_broadcast, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and n > 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_with_maps(no_broadcast, how):
    spark = no_broadcast
    big = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m")
    )
    other = spark.range(30).groupBy(F.col("id").alias("k")).agg(F.max("id").alias("v"))
    got = skew_join(big, other, ["k"], how)
    want = big.join(other, ["k"], how)
    assert got.columns == want.columns and got.count() == want.count()


def test_rank_in_group_equals_row_number(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.pmod(F.hash("id"), F.lit(97))).alias("o"), "id"
    )
    got = rank_in_group(rows, ["g"], "o", ["id"])
    want = rows.selectExpr("g", "o", "id", "CAST(row_number() OVER (PARTITION BY g ORDER BY o, id) AS BIGINT) AS rank")
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 3000
