"""Every registered query against its SQL on the small tables, and what the SQL can't show."""

import duckdb
import pytest

from conftest import SF
from tidemark.plans import pages  # noqa: F401
from tidemark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame, columns):
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) and plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_plans_scan_and_join_as_meant(spark, capsys):
    QUERIES["plan_diff_outer"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_discount" not in plan.split("ReadSchema")[1].split("\n")[0]
    QUERIES["top_changes"](spark, SF).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
    QUERIES["due_vendors"](spark, SF).explain("formatted")
    assert "GreaterThanOrEqual(s_acctbal,0.0)" in capsys.readouterr().out
