"""Histories of one key that are too long for one row."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators.gate import confirm_changes
from tidemark.plans.queries import QUERIES


def test_a_hot_key_is_confirmed_as_rows(spark):
    n = 120_000
    # Prints come in pairs that alternate, so each second reading confirms a change.
    rows = spark.range(n).select(F.lit(1).alias("vendor"), F.col("id").alias("seq"), (F.floor(F.col("id") / 2) % 2).alias("print"))
    got = confirm_changes(rows, "vendor", "seq", "print")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert got.agg(F.count("*"), F.min("seq"), F.max("seq")).first()[:] == (n // 2 - 1, 3, n - 1)


def test_null_prints_confirm_nothing(spark):
    prints = [None, None, 1, None, 2, None, 2, 2, 1, None, 1, 1, 1]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(prints)], "vendor int, seq int, print int")
    assert [tuple(r) for r in confirm_changes(df, "vendor", "seq", "print").orderBy("seq").collect()] == [(1, 7, 1, 2), (1, 11, 2, 1)]


@pytest.mark.parametrize("name", ["price_series", "spark_target_plan", "sparkline_points"])
def test_no_history_is_gathered(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
