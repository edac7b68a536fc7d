"""Places in an order over all rows, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import reliable_checkpoint

#: Rows of a partition are numbered in the lower bits of their monotonic ids.
_ROW_BITS = 33


def places(rows: DataFrame, order: list, within: list[str] | None = None, name: str = "place") -> DataFrame:
    """``rows`` with ``name``: their place from 1 in the given order, in each group of ``within``.

    Rows are sorted by ranges over all tasks, so a group of a third of them, or rows that all
    share the first sort column, are split. A row's place is its number inside its range plus the
    sizes of the ranges before, of which there are as many as partitions, less what lies before
    its group. ``within`` must not be null.
    """
    within = within or []
    at = F.monotonically_increasing_id()
    ranged = reliable_checkpoint(rows.orderBy(*within, *order))
    numbered = ranged.withColumns({"_range": F.shiftright(at, _ROW_BITS), "_number": at.bitwiseAND((1 << _ROW_BITS) - 1) + 1})
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = numbered.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_number"))
    placed = placed.drop("_range", "_number", "_before")
    if not within:
        return placed
    # The checkpoint takes the sum's partitioning away, so that a hot group can be split.
    starts = reliable_checkpoint(placed.groupBy(*within).agg((F.min(name) - 1).alias("_start")))
    return placed.join(starts, within).withColumn(name, F.col(name) - F.col("_start")).drop("_start")
