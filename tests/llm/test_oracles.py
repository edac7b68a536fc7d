"""The registered queries against their SQL on the smallest tables, and the entry's guard."""

import subprocess
import sys

import duckdb
import pytest

from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_covers_its_table(spark, name):
    assert QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_entry_adds_the_queries():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], capture_output=True, text=True, check=True).stdout
    assert {*QUERIES, "pipeline"} <= set(said.split())
