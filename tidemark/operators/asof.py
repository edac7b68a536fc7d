"""Readings beside the latest record before them, without a task that sees a whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import reliable_checkpoint

#: Rows of a partition are numbered in the lower bits of their monotonic ids.
_ROW_BITS = 33


def latest_before(readings: DataFrame, records: DataFrame, key: str, at: str, columns: list[str], inclusive: bool = False) -> DataFrame:
    """``readings`` with ``columns`` of the latest of ``records`` of the same ``key`` before them, by ``at``.

    ``inclusive`` counts a record of the reading's own time too. Of records of one key and time that with
    the largest columns counts. Readings without an earlier record, a key or a time have nulls; each reading comes back
    once, repeated ones as often as they occur. The columns must not be named like those of ``readings``.

    Both sides are merged in one order by key and time, cut into ranges over all tasks, so that a history of any
    length is split. Inside a range the last record seen is carried from row to row. A key that goes on in further ranges, of which there is
    one for each border at most, has its last record carried into them by a small table.
    """
    one = records.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(F.struct(*columns)).alias("_found"))
    own = F.struct(*(F.col(f"`{c}`") for c in readings.columns))
    row_type = readings.select(own.alias("x")).schema["x"].dataType
    found_type = one.schema["_found"].dataType
    # Rows of one time: a record comes first where it counts for the readings beside it.
    left = readings.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_turn"), own.alias("_row"), F.lit(None).cast(found_type).alias("_found"))
    right = one.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0 if inclusive else 2).alias("_turn"), F.lit(None).cast(row_type).alias("_row"), "_found")
    order = ["_key", "_at", "_turn"]
    number = F.monotonically_increasing_id()
    ranged = reliable_checkpoint(left.unionByName(right).orderBy(*order))
    ranged = ranged.withColumn("_range", F.shiftright(number, _ROW_BITS))
    inside = Window.partitionBy("_range", "_key").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("_in", F.last("_found", ignorenulls=True).over(inside)).where("_row IS NOT NULL")

    # Keys that go on past a border, the ranges that they span, and the last record of each.
    spans = ranged.where("_key IS NOT NULL").groupBy("_key").agg(F.min("_range").alias("_low"), F.max("_range").alias("_high")).where("_low < _high")
    spans = reliable_checkpoint(spans)
    ends = ranged.where("_found IS NOT NULL").join(F.broadcast(spans.select("_key")), "_key").groupBy("_key", "_range").agg(F.max_by("_found", "_at").alias("_last"))
    steps = spans.select("_key", F.explode(F.sequence("_low", "_high")).alias("_range")).join(ends, ["_key", "_range"], "left")
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("_key", "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    joined = seen.join(F.broadcast(carried), ["_key", "_range"], "left")
    got = F.coalesce("_in", "_before")
    return joined.select(*(F.col("_row").getField(c).alias(c) for c in readings.columns), *(got.getField(c).alias(c) for c in columns))
