"""Digests, the review queue, snapshots, status and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import places

#: Days after which a vendor is stale, snapshots always kept, spend that alarms.
STALE_DAYS, KEEP_RECENT, SPEND_ALARM = 14, 60, 3.0

#: Statuses that count as failing, and what they mean.
FAILING = {
    "error": "could not be read", "extraction_error": "extraction failed", "not_a_pricing_page": "no price page",
    "robots_disallowed": "blocked by robots.txt", "suspicious_extraction": "fewer than 2 plans found",
}

#: Days of recording that are worth a note.
MILESTONES = (7, 30, 90, 365)


def recent(changes: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return changes.where(F.col("detected_at") >= now - F.make_dt_interval(F.lit(days)))


def digest_by_category(changes: DataFrame, categories: DataFrame) -> DataFrame:
    """Changes and vendors per category; vendors without one are uncategorised."""
    joined = changes.join(categories.select("vendor", "category"), "vendor", "left")
    return joined.groupBy(F.coalesce("category", F.lit("uncategorised")).alias("category")).agg(
        F.count("*").alias("changes"), F.count_distinct("vendor").alias("vendors"), F.max("detected_at").alias("latest")
    )


def review_queue(changes: DataFrame, order: list[str], k: int | None = None) -> DataFrame:
    """Changes below the publishing threshold, least certain first and numbered from 1; ``k``
    bounds a top-k report. Ranks come from ranges, as confidences take a few values and one
    may hold most of the queue."""
    queue = changes.where("NOT publishable")
    if k is not None:
        queue = queue.orderBy("confidence", *order).limit(k)
        return queue.withColumn("rank", F.row_number().over(Window.orderBy("confidence", *order)))
    return places(queue, ["confidence", *order], name="rank")


def find_rows(rows: DataFrame, term: str, columns: list[str], group: str) -> DataFrame:
    """Rows that hold a term anywhere, with the number found and the number there were, per group."""
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    hit = text.contains(term.strip().lower())
    return rows.groupBy(group).agg(F.count_if(hit).alias("shown"), F.count("*").alias("total")).where("shown > 0")


def numeric_order(text: Column, descending: bool = False) -> Column:
    """Sort key of a table cell: what is left of digits, dots and signs; blanks last both ways."""
    number = F.nullif(F.regexp_replace(text, "[^0-9.-]", ""), F.lit("")).try_cast("double")
    return number.desc_nulls_last() if descending else number.asc_nulls_last()


def prunable_snapshots(snapshots: DataFrame, keep_recent: int = KEEP_RECENT) -> DataFrame:
    """Snapshot days to delete: all but the newest ``keep_recent`` and the first of each month."""
    line = Window.partitionBy("slug")
    old = snapshots.withColumn("_r", F.row_number().over(line.orderBy(F.desc("day")))).where(F.col("_r") > keep_recent)
    month = Window.partitionBy("slug", F.trunc("day", "month"))
    return old.withColumn("_first", F.min("day").over(month)).where("day <> _first").drop("_r", "_first")


def recording_since(snapshots: DataFrame, today: Column) -> DataFrame:
    return snapshots.agg(F.coalesce(F.min("day"), today).alias("since"))


def spend_by_month(charges: DataFrame, at: str, usd: str) -> DataFrame:
    return charges.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.round(F.sum(usd), 6).alias("usd"))


def failing_vendors(state: DataFrame) -> DataFrame:
    """Vendors in a failing status with what it means."""
    reasons = F.create_map(*(F.lit(x) for pair in FAILING.items() for x in pair))
    return state.withColumn("reason", F.coalesce(reasons[F.col("status")])).where("reason IS NOT NULL")


def stale_vendors(state: DataFrame, today: Column, days: int = STALE_DAYS) -> DataFrame:
    return state.where(F.col("last_checked") < F.date_sub(today, days))


def status_rollup(
    state: DataFrame, changes: DataFrame, snapshots: DataFrame, today: Column, records: DataFrame | None = None, pending: DataFrame | None = None, review: DataFrame | None = None
) -> DataFrame:
    """One row of counts over vendors, changes and snapshots, and over confirmed records, held
    readings and changes under review where they are given."""
    reasons = F.col("status").isin(list(FAILING))
    a = state.agg(
        F.count("*").alias("vendors"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(reasons).alias("failing"),
        F.count_if(F.col("last_checked") < F.date_sub(today, STALE_DAYS)).alias("stale"),
        F.max("last_checked").alias("last_run"),
    )
    b = changes.agg(F.count("*").alias("changes"))
    c = snapshots.agg(F.count("*").alias("snapshots"))
    health = F.when(F.col("vendors") == 0, "unknown").when((F.col("failing") > 0) | (F.col("stale") > 0), "problems").otherwise("ok")
    counted = [b, c, *(f.agg(F.count("*").alias(n)) for n, f in (("records", records), ("pending", pending), ("review", review)) if f is not None)]
    # Single rows: the products hold one row each.
    return reduce(lambda x, y: x.join(y, how="cross"), counted, a).withColumn("health", health)


def digest_rows(changes: DataFrame, categories: DataFrame) -> DataFrame:
    """``changes`` with ``category``, the rows of a digest; vendors without one are uncategorised."""
    joined = changes.join(categories.select("vendor", F.col("category").alias("_category")), "vendor", "left")
    return joined.withColumn("category", F.coalesce("_category", F.lit("uncategorised"))).drop("_category")


def digest_header(changes: DataFrame) -> DataFrame:
    """How many changes a digest has, and of how many vendors over all categories."""
    return changes.agg(F.count("*").alias("changes"), F.count_distinct("vendor").alias("vendors"))


def grand_totals(vendors: DataFrame, plans: DataFrame, changes: DataFrame, since: Column) -> DataFrame:
    """One row: vendors, real plans of their current records, changes, and since when."""
    real = plans.where(~F.coalesce("is_addon", F.lit(False))).agg(F.count("*").alias("plans"))
    one = vendors.agg(F.count("*").alias("vendors")).join(real, how="cross").join(changes.agg(F.count("*").alias("changes")), how="cross")
    return one.withColumn("since", since)


def milestone_text(days: Column) -> Column:
    """Words for the way to the next milestone."""
    target = F.lit(None).cast("int")
    for at in reversed(MILESTONES):
        target = F.when(days < at, at).otherwise(target)
    left = F.concat((target - days).cast("string"), F.lit(" days to "), target.cast("string"))
    return F.coalesce(left, F.lit("past every milestone"))


def days_recording(since: Column, today: Column) -> Column:
    """Days since a date given as text; 0 for what is no date or lies ahead."""
    parsed = F.to_date(F.try_to_timestamp(since))
    return F.greatest(F.lit(0), F.coalesce(F.date_diff(today, parsed), F.lit(0)))


def next_milestone(days: Column) -> Column:
    """Days left to the next milestone, or null after the last."""
    left = F.lit(None).cast("int")
    for at in reversed(MILESTONES):
        left = F.when(days < at, F.lit(at) - days).otherwise(left)
    return left


def next_check(now: Column) -> Column:
    """Words for the time until the next 06:00 UTC."""
    due = F.date_trunc("day", now) + F.expr("INTERVAL 6 HOURS")
    due = F.when(due <= now, due + F.expr("INTERVAL 1 DAY")).otherwise(due)
    seconds = F.timestamp_diff("SECOND", now, due)
    hours = F.floor(seconds / 3600).cast("int")
    minutes = F.floor(seconds / 60).cast("int")
    return (
        F.when(hours < 1, F.concat(F.lit("in "), minutes.cast("string"), F.lit(" minutes")))
        .when(hours >= 2, F.concat(F.lit("in "), hours.cast("string"), F.lit(" hours")))
        .otherwise("in about an hour")
    )


def advise(site_up: Column, crawl_problem: Column, problems: Column, days: Column, changes: Column) -> Column:
    """The first rule that holds, as a short name."""
    return (
        F.when(~site_up, "site down")
        .when(crawl_problem, "wake the crawl")
        .when(problems > 0, "clear problems")
        .when(days < 7, "wait")
        .when((changes == 0) & (days >= 21), "widen")
        .when(changes == 0, "keep waiting")
        .when((changes >= 1) & (days < 30), "tell one person")
        .when(days >= 30, "check who came")
        .otherwise("nothing")
    )


def diagnose(ok: Column, http_status: Column, raw_prices: Column, clean_prices: Column, raw_length: Column, has_json: Column) -> Column:
    """Why a page gave no plans."""
    return (
        F.when(http_status.isin(403, 429), "blocked")
        .when(ok, "ok")
        .when((raw_prices > 0) & (clean_prices == 0), F.when(has_json, "js_json").otherwise("over_cleaned"))
        .when(raw_prices == 0, F.when(raw_length > 20_000, "js_empty").otherwise("wrong_page"))
        .otherwise("wrong_page")
    )


def summarise(facts: DataFrame, snapshots: DataFrame, changes: DataFrame, today: Column, site_up: Column, crawl_problem: Column, problems: Column) -> DataFrame:
    """Advice with the context that is shown beside it: one row of (advice, days, milestone, changes).

    ``facts`` is one row; the last three columns say of it whether the site is up, whether runs are late and how many problems there are.
    """
    days = days_recording(F.col("since").cast("string"), today)
    one = facts.join(recording_since(snapshots, today), how="cross").join(changes.agg(F.count("*").alias("changes")), how="cross")
    one = one.withColumn("days", days)
    return one.select(advise(site_up, crawl_problem, problems, F.col("days"), F.col("changes")).alias("advice"), "days", milestone_text(F.col("days")).alias("milestone"), "changes")
