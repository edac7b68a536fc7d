"""Pairs of a group in blocks against all pairs in plain Python."""

from tidemark.functions.text import pair_slug
from tidemark.operators.benchmarks import comparison_pairs
from tidemark.operators.pairs import block_pairs

from pyspark.sql import functions as F


def test_blocks_give_every_pair_once(spark):
    rows = [(g, i, i % 3 == 0) for g, n in (("a", 61), ("b", 7), ("c", 1), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, lively boolean")
    both = [(g, i, j, x, y) for g, i, x in rows for h, j, y in rows if g is not None and g == h]
    for block in (4, 1000):
        got = block_pairs(df, "g", "i", block=block, task=50).select("g", "i_a", "i_b").collect()
        assert sorted(map(tuple, got)) == sorted((g, i, j) for g, i, j, *_ in both)
        got = block_pairs(df, "g", "i", "lively", block=block, task=50).select("g", "i_a", "i_b").collect()
        assert sorted(map(tuple, got)) == sorted((g, i, j) for g, i, j, x, y in both if x or y)
    assert block_pairs(df.where("i < 0"), "g", "i").isEmpty()


def test_one_category_is_dealt_to_many_tasks(spark):
    """Few bytes make many pairs: partitions that are put together by their bytes left all pairs of a category to one task."""
    heads = spark.range(3000).select(
        F.col("id").alias("vendor"), F.lit("crm").alias("category"), F.format_string("v%05d", "id").alias("name"), F.format_string("v%05d", "id").alias("slug"),
        F.lit("daily").alias("tier"), F.lit(1.0).alias("entry_price"),
    )
    pairs = comparison_pairs(heads, heads.select("vendor").limit(1))
    assert pairs.count() == 3000 * 2999 // 2
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000 * 2999 // 2


def test_slug_of_a_pair_is_in_order_and_leaves_nulls_out(spark):
    rows = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), (None, "b"), ("a", None), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(pair_slug(F.col("a"), F.col("b"))).collect()] == ["a-vs-b", "a-vs-b", "a-vs-a", "b", "a", ""]


def test_pages_of_a_small_table_are_parsed_in_many_tasks(spark):
    from conftest import SF
    from tidemark.plans import pages

    assert pages.V.table(spark, SF, "customer").rdd.getNumPartitions() < 4
    assert pages._markup(spark, SF).rdd.getNumPartitions() >= 4


def test_pairs_are_not_shuffled_for_their_day(spark):
    from conftest import SF
    from tidemark.plans.pages import pair_lastmod as lastmod

    plan = lastmod(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_lines_of_heads_are_grouped_in_tasks_of_their_number(spark, monkeypatch):
    """The sets of features of all plans in a scan's few tasks outgrew their memory and were spilled."""
    from conftest import SF
    from tidemark.plans import views

    def line_tasks(heads):
        plan = heads._jdf.queryExecution().executedPlan().toString()
        return [x.split("]")[0] for x in plan.split("hashpartitioning(")[1:] if "REPARTITION_BY_NUM" in x.split("\n")[0]]

    few = views.heads(spark, SF)
    assert line_tasks(few) == []
    monkeypatch.setattr(views, "TASK_LINES", 10_000)
    many = views.heads(spark, SF)
    found = line_tasks(many)
    assert len(found) == 1 and "l_suppkey" in found[0] and ", 6)" in found[0]
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_largest_task_does_not_grow_with_the_rows(spark):
    largest = {}
    for n in (200, 400):
        rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i"))
        met = block_pairs(rows, "g", "i", block=10, task=2000).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in met) == n * n
        largest[n] = max(r["count"] for r in met)
    assert largest[400] < 2 * largest[200] and largest[400] < 4 * 2000


def test_lines_are_not_sorted_to_meet_many_parts(spark, monkeypatch):
    """Lines sorted by their part in a fixed number of tasks were spilled, and made the longest task of vendors' heads."""
    from conftest import SF
    from tidemark.plans import views

    def of_parts(plans):
        plan = plans._jdf.queryExecution().executedPlan().toString()
        return [x.split(" [")[0].split()[-1] for x in plan.split("\n") if "Join [l_partkey" in x]

    few = views.plans(spark, SF)
    assert of_parts(few) == ["BroadcastHashJoin"]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert of_parts(views.plans(spark, SF)) == ["SortMergeJoin"]
        monkeypatch.setattr(views, "MANY_PARTS", 1000)
        many = views.plans(spark, SF)
        assert of_parts(many) == ["ShuffledHashJoin"]
        assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
        # A table of more parts than a task may hold is sorted as before.
        monkeypatch.setattr(views, "TABLE_PARTS", 100)
        assert of_parts(views.plans(spark, SF)) == ["SortMergeJoin"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
