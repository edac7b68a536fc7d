"""How many rows the comparisons of vendors write to disk on their way, and that what they leave out changes nothing."""

from functools import partial

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators import benchmarks
from tidemark.operators.pairs import block_pairs
from tidemark.plans import views
from tidemark.plans.queries import QUERIES


def shuffled(df):
    """Rows written by each shuffle of a run of ``df``."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]

    return walk(plan)


def test_rows_of_pairs_are_not_written_for_each_block_they_meet(spark):
    for n in (400, 1600):
        rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i"), (F.col("id") % 4 > 0).alias("lively"))
        pairs = block_pairs(rows, "g", "i", "lively", block=10, task=20_000)
        # 40 and 160 blocks: each row was written 2 x 40 and 2 x 160 times for either side.
        assert n <= sum(shuffled(pairs)) <= 4 * n
        assert pairs.count() == n * n - (n // 4) ** 2
        assert pairs.select("i_a", "i_b").distinct().count() == n * n - (n // 4) ** 2


def test_large_and_small_groups_meet_in_one_result(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 200, "large").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("g"), F.col("id").alias("i"))
    pairs = block_pairs(rows, "g", "i", block=50, task=5000)
    assert sorted(map(tuple, pairs.groupBy("g").count().collect())) == sorted([("large", 40_000), *((f"s{i}", 25) for i in range(20))])


def test_lines_of_older_years_are_not_shuffled_for_heads(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_LINES", 10_000)
    lines = views.table(spark, SF, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"))
    newest = lines.join(lines.groupBy("l_suppkey").agg(F.max("year").alias("year")), ["l_suppkey", "year"]).count()
    assert max(shuffled(views.heads(spark, SF))) == newest < lines.count() / 4


def test_heads_of_a_vendor_whose_newest_lines_have_no_known_part(spark, tmp_path):
    con = duckdb.connect()
    for t in "region nation supplier part events lineitem".split():
        part = "CASE WHEN l_suppkey = 3 AND year(l_shipdate) >= 2000 OR l_suppkey = 4 THEN -1 ELSE l_partkey END AS l_partkey"
        rows = f"SELECT * {f'REPLACE ({part})' if t == 'lineitem' else ''} FROM '{SF}/{t}.parquet'"
        con.execute(f"COPY ({rows}) TO '{tmp_path / t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path / t}.parquet'")
    years = {r["vendor"]: (r["year"], r["plan_year"]) for r in views.newest_years(spark, str(tmp_path)).collect()}
    assert years[3] == (2001, 1999) and years[4] == (2001, None) and years[5] == (2001, 2001)
    columns = "vendor, category, currency, entry_price, top_price, has_free, per_seat, custom, plans, trial_days, changes"
    want = con.execute(f"WITH {views.HEADS} SELECT {columns}, array_to_string(list_sort(features), ',') FROM heads_v").fetchall()
    got = views.heads(spark, str(tmp_path)).selectExpr(*columns.split(", "), "array_join(array_sort(features), ',')").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r["vendor"] == 3 and r["plans"] > 0 for r in got) and any(r["vendor"] == 4 and r["plans"] == 0 for r in got)


@pytest.mark.parametrize("name", ["compare_verdict", "compare_facts"])
def test_query_of_pairs_writes_a_vendor_a_few_times(spark, monkeypatch, name):
    whole = sorted(map(str, QUERIES[name](spark, SF).collect()))
    vendors = views.heads(spark, SF).where("entry_price IS NOT NULL").count()
    monkeypatch.setattr(benchmarks, "block_pairs", partial(block_pairs, block=5, task=500))
    dealt = QUERIES[name](spark, SF)
    # Some four blocks a category: a vendor was written 16 times.
    assert vendors <= sum(shuffled(dealt)) <= 4 * vendors
    assert sorted(map(str, dealt.collect())) == whole
