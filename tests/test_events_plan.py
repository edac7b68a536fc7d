"""The diff shuffles its sides once and joins nothing, so nothing grows on the driver."""

import re

from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators import diff
from tidemark.plans import pages  # noqa: F401
from tidemark.plans.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_made_up_history_joins_nothing(spark):
    plan = _plan(QUERIES["made_up_history"](spark, SF))
    assert "Broadcast" not in plan and "Join" not in plan


def test_events_are_not_shuffled(spark):
    plan = _plan(QUERIES["diff_all_events"](spark, SF))
    # Lines with their parts, and at most that.
    assert len(re.findall("Join ", plan)) <= 1


def test_number_of_tasks_changes_nothing(spark):
    readings = spark.createDataFrame([(v, n, "USD", v % 2 == 0 or n, "") for v in range(6) for n in (False, True) if v or n], "vendor int, new boolean, currency string, pricing_is_public boolean, extraction_notes string")
    fields = "vendor int, new boolean, key string, pos int, name string, monthly_price double, annual_price_per_month double, is_custom_pricing boolean, is_per_seat boolean, limits map<string,double>, features array<string>"
    plans = [(v, n, k, p, f"{k}{p}", 10.0 + v * n + p, None, False, n, {"seats": 1.0 + n}, ["x"] if n else ["y"]) for v in range(7) for n in (False, True) for k, p in (("a", 0), ("a", 1), (None, 2), ("b" if n else "c", 3))]
    plans = spark.createDataFrame(plans, fields)
    got = [sorted(map(str, diff.diff_sides(plans, readings, tasks).collect())) for tasks in (None, 1, 5)]
    assert got[0] == got[1] == got[2]
    old, new = (plans.where(F.col("new") == n).drop("new") for n in (False, True))
    was, now = (readings.where(F.col("new") == n).drop("new") for n in (False, True))
    rows = diff.diff_readings(old, new, was, now).collect()
    assert sorted(map(str, rows)) == got[0] and {r.vendor for r in rows} == {1, 2, 3, 4, 5}
    # Of equal keys the last counts; plans without a key are no two sides of one.
    kinds = {(r.key, r.change_type) for r in rows if r.vendor == 2}
    assert {("b", "plan_added"), ("c", "plan_removed"), (None, "plan_added"), (None, "plan_removed"), ("a", "price_increase")} <= kinds
    assert ("a", "plan_renamed") not in kinds


def test_lines_in_more_tasks_give_the_same_events(spark, monkeypatch):
    from tidemark.plans import views

    few = QUERIES["diff_all_events"](spark, SF)
    rows, total = few.count(), few.agg(F.sum(F.xxhash64(*few.columns).cast("decimal(38,0)"))).first()[0]
    monkeypatch.setattr(views, "TASK_LINES", 10_000)
    assert views.line_tasks(spark, SF) == 6
    many = QUERIES["diff_all_events"](spark, SF)
    assert (many.count(), many.agg(F.sum(F.xxhash64(*many.columns).cast("decimal(38,0)"))).first()[0]) == (rows, total)
