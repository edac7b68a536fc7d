"""Price histories and the change log: ``changes(event_id, vendor, plan, field, old_value, new_value, detected_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import html_escape


def price_series(changes: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Per (vendor, plan) the prices over time: the first old value, then each new one.

    ``current(vendor, plan, current)`` adds today's price where it differs from the last.
    Changes without both numbers are passed over. A history is one plan's: its length is
    the number of its changes, and the array is the result itself.
    """
    known = changes.where("old_value IS NOT NULL AND new_value IS NOT NULL")
    ordered = known.groupBy("vendor", "plan").agg(
        F.sort_array(F.collect_list(F.struct("detected_at", "event_id", "old_value", "new_value"))).alias("c")
    )
    series = F.concat(F.array(F.get("c", F.lit(0))["old_value"]), F.transform("c", lambda x: x["new_value"]))
    out = ordered.select("vendor", "plan", series.alias("series"))
    if current is None:
        return out
    joined = out.join(current, ["vendor", "plan"], "left")
    moved = F.col("current").isNotNull() & (F.element_at("series", -1) != F.col("current"))
    return joined.select("vendor", "plan", F.when(moved, F.array_append("series", F.col("current"))).otherwise(F.col("series")).alias("series"))


def series_rows(changes: DataFrame) -> DataFrame:
    """(vendor, plan, pos, price): the points of :func:`price_series` as rows, so that no
    history has to fit one row."""
    known = changes.where("old_value IS NOT NULL AND new_value IS NOT NULL")
    line = Window.partitionBy("vendor", "plan").orderBy("detected_at", "event_id", "old_value", "new_value")
    placed = known.select("vendor", "plan", "old_value", "new_value", F.row_number().over(line).alias("pos"))
    point = lambda pos, price: F.struct(pos.cast("int").alias("pos"), F.col(price).alias("price"))
    points = F.when(F.col("pos") == 1, F.array(point(F.lit(0), "old_value"), point(F.col("pos"), "new_value"))).otherwise(
        F.array(point(F.col("pos"), "new_value"))
    )
    return placed.select("vendor", "plan", F.explode(points).alias("p")).select("vendor", "plan", "p.pos", "p.price")


def longest_history(changes: DataFrame) -> DataFrame:
    """(vendor, plan, points, first, last) of the plan that :func:`best_history` chooses, from sums alone."""
    known = changes.where("old_value IS NOT NULL AND new_value IS NOT NULL")
    at = F.struct("detected_at", "event_id", "old_value", "new_value")
    ends = known.groupBy("vendor", "plan").agg((F.count("*") + 1).alias("points"), F.min(at).alias("a"), F.max(at).alias("z"))
    rank = F.struct(-F.col("points"), F.col("z.new_value"), "plan")
    row = F.struct("plan", F.col("points").cast("int").alias("points"), F.col("a.old_value").alias("first"), F.col("z.new_value").alias("last"))
    return ends.groupBy("vendor").agg(F.min_by(row, rank).alias("b")).select("vendor", "b.*")


def sparkline_rows(rows: DataFrame, width: float = 260.0, height: float = 56.0) -> DataFrame:
    """(vendor, plan, pos, x, y) of :func:`series_rows`, as :func:`sparkline` places them."""
    boxes = rows.groupBy("vendor", "plan").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.max("pos").alias("steps"))
    span = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    return rows.join(boxes, ["vendor", "plan"]).select(
        "vendor", "plan", "pos",
        F.round(F.col("pos") / F.col("steps") * width, 1).alias("x"),
        F.round(height - (F.col("price") - F.col("low")) / span * height, 1).alias("y"),
    )


def series_delta(series: Column) -> Column:
    """Change from first to last in per cent, 0 from 0."""
    first, last = F.get(series, F.lit(0)), F.element_at(series, -1)
    return F.when(first == 0, 0.0).otherwise((last - first) / first * 100)


def best_history(series: DataFrame) -> DataFrame:
    """Per vendor the plan with the longest history; then the cheaper last price, then the name."""
    rank = F.struct(-F.size("series"), F.element_at("series", -1), "plan")
    best = series.groupBy("vendor").agg(F.min_by(F.struct("plan", "series"), rank).alias("b"))
    return best.select("vendor", "b.plan", "b.series")


def sparkline(series: Column, width: float = 260.0, height: float = 56.0) -> Column:
    """Points of a line in a box, lowest value at the bottom; empty for fewer than two."""
    steps = F.size(series) - 1
    # The box is bound once by a lambda; named inside the inner one it would be made anew for each point.
    box = F.array(F.struct(F.array_min(series).alias("low"), F.array_max(series).alias("high")))
    span = lambda b: F.when(b["high"] == b["low"], 1.0).otherwise(b["high"] - b["low"])
    points = F.transform(
        box,
        lambda b: F.transform(
            series,
            lambda v, i: F.struct(F.round(i / steps * width, 1).alias("x"), F.round(height - (v - b["low"]) / span(b) * height, 1).alias("y")),
        ),
    )
    return F.when(F.size(series) > 1, F.get(points, F.lit(0)))


def newest_first(changes: DataFrame, k: int | None = None) -> DataFrame:
    """The change log from the newest on, with its rank; ``k`` bounds a top-k report."""
    order = (F.desc("detected_at"), F.desc("event_id"))
    if k is None:
        return changes.orderBy(*order)
    top = changes.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def changes_per_vendor(changes: DataFrame) -> DataFrame:
    return changes.groupBy("vendor").agg(F.count("*").alias("changes"), F.max("detected_at").alias("latest"))


def feed_items(changes: DataFrame, k: int = 50) -> DataFrame:
    """Items of a feed from the newest ``k`` changes; the event id keeps guids apart."""
    top = newest_first(changes, k)
    title = F.concat_ws(" ", F.col("vendor").cast("string"), "plan", F.lit("changed"))
    return top.select(
        "rank",
        html_escape(title).alias("title"),
        F.concat(F.lit("vendor/"), F.col("vendor").cast("string"), F.lit(".html")).alias("link"),
        F.concat_ws("-", F.date_format("detected_at", "yyyy-MM-dd"), F.col("vendor").cast("string"), F.col("event_id").cast("string")).alias("guid"),
    )


def page_lastmod(changes: DataFrame, categories: DataFrame, since: Column) -> DataFrame:
    """Latest change day by page: a vendor's, its category's and the whole site's.

    One pass of grouping sets over the changes of each vendor; a vendor without changes
    has the day on which recording began.
    """
    latest = changes.groupBy("vendor").agg(F.max(F.to_date("detected_at")).alias("day"))
    known = categories.select("vendor", "category").join(latest, "vendor", "left")
    sets = known.groupingSets([["vendor"], ["category"], []], "vendor", "category").agg(
        F.grouping_id("vendor", "category").alias("g"), F.coalesce(F.max("day"), since).alias("lastmod")
    )
    page = (
        F.when(F.col("g") == 1, F.concat(F.lit("vendor/"), F.col("vendor").cast("string")))
        .when(F.col("g") == 2, F.concat(F.lit("category/"), F.col("category")))
        .otherwise("index")
    )
    return sets.select(page.alias("page"), "lastmod")


def latest_change(changes: DataFrame) -> DataFrame:
    """(vendor, latest): the day of each vendor's newest change."""
    return changes.groupBy("vendor").agg(F.to_date(F.max("detected_at")).alias("latest"))


def pair_lastmod(pairs: DataFrame, since: Column) -> DataFrame:
    """(pair, lastmod) of ``pairs(pair, latest_a, latest_b)``: the newest change of either, or the day on which recording began.

    :func:`latest_change` joins the vendors before they meet, so that no pair is shuffled."""
    return pairs.select("pair", F.coalesce(F.greatest("latest_a", "latest_b"), since).alias("lastmod"))
