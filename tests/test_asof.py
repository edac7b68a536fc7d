"""The as-of join against a loop, with one key that holds most rows."""

import numpy as np
import pytest

from tidemark.operators.asof import latest_before


def plain(readings, records, inclusive):
    out = []
    for r in readings:
        _, key, at = r
        earlier = [(t, p, n) for k, t, p, n in records if None not in (k, t, key, at) and k == key and (t <= at if inclusive else t < at)]
        out.append((*r, *(max(earlier)[1:] if earlier else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("keys", [[1], [1, 1, 1, 1, 1, 2, 3, None]])
def test_equals_a_loop(spark, inclusive, keys):
    rng = np.random.default_rng(len(keys))
    pick = lambda: keys[rng.integers(len(keys))]
    when = lambda: int(rng.integers(60)) if rng.random() > 0.05 else None
    readings = [(i % 150, pick(), when()) for i in range(300)]  # ids repeat
    records = [(pick(), when(), float(rng.integers(5)), f"n{rng.integers(3)}") for _ in range(25)]
    got = latest_before(
        spark.createDataFrame(readings, "id int, k int, at int").repartition(5), spark.createDataFrame(records, "k int, at int, price double, name string"), "k", "at", ["price", "name"], inclusive
    )
    assert got.columns == ["id", "k", "at", "price", "name"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(readings, records, inclusive)


def test_one_history_in_many_ranges(spark):
    """A record at the start is carried over all borders after it."""
    readings = spark.range(20_000).selectExpr("1 AS k", "id + 10 AS at", "id")
    records = spark.createDataFrame([(1, 5, "first"), (1, 15_000, "late"), (2, 0, "other")], "k int, at long, name string")
    got = {r["name"]: r["count"] for r in latest_before(readings, records, "k", "at", ["name"]).groupBy("name").count().collect()}
    assert got == {"first": 14_991, "late": 5_009}


def test_empty_sides(spark):
    rows, none = spark.createDataFrame([(1, 2)], "k int, at int"), spark.createDataFrame([], "k int, at int, p int")
    assert [tuple(r) for r in latest_before(rows, none, "k", "at", ["p"]).collect()] == [(1, 2, None)]
    assert latest_before(rows.limit(0), none, "k", "at", ["p"]).count() == 0
