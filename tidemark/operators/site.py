"""Rows behind the published pages, and small facts that several of them show."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import money
from tidemark.operators.records import plan_price

#: Hours after which a run is late.
STALE_RUN_HOURS = 36

#: Labels of a vendor's status.
STATUS_LABELS = {
    "ok": "read", "error": "unreachable", "extraction_error": "not understood", "not_a_pricing_page": "no price page",
    "robots_disallowed": "not allowed", "suspicious_extraction": "incomplete",
}


def trial_days(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Longest trial of any plan, null without one."""
    return plans.groupBy(*keys).agg(F.max(F.when(F.col("trial_days") > 0, F.col("trial_days"))).alias("trial_days"))


def versions(vendors: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Page versions of each vendor, 1 where none is stored."""
    counted = snapshots.groupBy(key).agg(F.count("*").alias("n"))
    return vendors.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(1)).alias("versions"))


def has_real_data(records: DataFrame) -> DataFrame:
    """Whether any record is not made up, and whether any is."""
    demo = F.coalesce("demo", F.lit(False))
    return records.agg(F.coalesce(F.bool_or(~demo), F.lit(False)).alias("real"), F.coalesce(F.bool_or(demo), F.lit(False)).alias("made_up"))


def with_plans(vendors: DataFrame, plans: DataFrame, key: str = "vendor") -> DataFrame:
    """Vendors whose record holds plans: the others get no page."""
    return vendors.join(plans.select(key).distinct(), key, "left_semi")


def head_columns() -> list[Column]:
    """What a vendor's plans say at a glance, as aggregates over the plans of one record: headline
    prices over real, priced, non-custom plans, flags over real plans, and what they name."""
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    real = ~truth("is_addon")
    price, basis = plan_price(F.col("monthly_price"), F.col("annual_price_per_month"))
    priced = F.when(real & ~truth("is_custom_pricing"), price)
    any_of = lambda c: F.coalesce(F.bool_or(F.when(real, truth(c))), F.lit(False))
    named = F.flatten(F.collect_set(F.when(real, F.coalesce("features", F.array().cast("array<string>")))))
    return [
        F.min(priced).alias("entry_price"), F.max(priced).alias("top_price"),
        F.when(F.bool_and(F.when(priced.isNotNull(), basis == "annual")), "annual").when(F.count(priced) > 0, "monthly").alias("basis"),
        any_of("is_free").alias("has_free"), any_of("is_per_seat").alias("per_seat"), any_of("is_custom_pricing").alias("custom"),
        F.count_if(real).alias("plans"), F.max("trial_days").alias("trial_days"),
        F.array_compact(F.sort_array(F.array_distinct(named))).alias("features"),
    ]


def vendor_heads(vendors: DataFrame, records: DataFrame, changes: DataFrame, key: str = "vendor") -> DataFrame:
    """Registered vendors that have a record, with its head and how often they changed.

    ``records(key, currency, head)`` holds the aggregates of :func:`head_columns` as a struct, null
    where the record has no plans; ``changes`` has a row per change.
    """
    counted = changes.groupBy(key).agg(F.count("*").alias("changes"))
    joined = vendors.join(records, key).join(counted, key, "left")
    head = lambda c, default=None: (F.col(f"head.{c}") if default is None else F.coalesce(f"head.{c}", default)).alias(c)
    no = F.lit(False)
    return joined.select(
        *vendors.columns, "currency", head("entry_price"), head("top_price"), head("has_free", no), head("per_seat", no), head("custom", no),
        head("plans", F.lit(0).cast("long")), head("trial_days"), head("features", F.array().cast("array<string>")), F.coalesce("changes", F.lit(0).cast("long")).alias("changes"),
    )


#: Labels of a comparison, in order.
CELL_LABELS = (
    "Cheapest paid plan", "Highest listed plan", "Free tier", "Billing", "Free trial", "Plans published", "Enterprise quote only", "Price changes recorded",
)


def compare_cells(heads: DataFrame) -> DataFrame:
    """``heads`` with ``cells``: what a vendor shows in each comparison, said once and not in every pair."""
    word = lambda when, yes, no: F.when(F.col(when), yes).otherwise(no)
    cells = (
        money(F.col("currency"), F.col("entry_price")), money(F.col("currency"), F.col("top_price")), word("has_free", "Yes", "No"), word("per_seat", "Per seat", "Flat"),
        F.coalesce(F.concat(F.col("trial_days").cast("string"), F.lit(" days")), F.lit("—")), F.col("plans").cast("string"), word("custom", "Yes", "No"), F.col("changes").cast("string"),
    )
    return heads.withColumn("cells", F.array(*cells))


def compare_table(pairs: DataFrame) -> DataFrame:
    """(pair, place, label, first, second): the cells of a comparison, in order, from ``pairs(pair, cells_a, cells_b)``."""
    cell = lambda s, i: F.get(f"cells_{s}", F.lit(i))
    rows = F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(n).alias("label"), cell("a", i).alias("first"), cell("b", i).alias("second")) for i, n in enumerate(CELL_LABELS)))
    return pairs.select("pair", F.inline(rows))


def vendor_page(plans: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Plans of each vendor in stored order, add-ons apart: price, basis, billing, first limits, and
    ``more`` columns."""
    price, basis = plan_price(F.col("monthly_price"), F.col("annual_price_per_month"))
    shown = F.when(F.coalesce("is_custom_pricing", F.lit(False)), "contact").when(F.coalesce("is_free", F.lit(False)), "free").otherwise(basis)
    first = F.slice(F.array_sort(F.map_entries("limits")), 1, 3)
    limit = F.transform(first, lambda x: F.concat(x["key"], F.lit(" "), F.when(x["value"] == -1, "unlimited").otherwise(F.round(x["value"]).cast("bigint").cast("string"))))
    return plans.select(
        "vendor", "name", F.coalesce("is_addon", F.lit(False)).alias("addon"), price.alias("price"), shown.alias("shown"),
        F.when(F.col("is_per_seat"), "per seat").otherwise("flat").alias("billing"), F.array_join(limit, ", ").alias("limits"), *(more or []),
    )


def category_page(vendors: DataFrame, plans: DataFrame, changes: DataFrame) -> DataFrame:
    """Vendors of a category with flags over all plans, add-ons too, and their change counts."""
    flags = plans.groupBy("vendor").agg(
        F.bool_or(F.coalesce("is_free", F.lit(False))).alias("free"),
        F.bool_or(F.coalesce("is_custom_pricing", F.lit(False))).alias("custom"),
        F.bool_or(F.coalesce("is_per_seat", F.lit(False))).alias("per_seat"),
    )
    counted = changes.groupBy("vendor").agg(F.count("*").alias("changes"))
    rows = vendors.select("category", "name", "vendor").join(flags, "vendor").join(counted, "vendor", "left")
    return rows.withColumn("changes", F.coalesce("changes", F.lit(0)))


def category_header(benchmark: DataFrame) -> DataFrame:
    """The line above a category's vendors: how many there are, their median entry price, how many in
    other currencies it leaves out, and the share with a free plan."""
    return benchmark.select("category", "vendors", money(F.col("currency"), F.col("median_entry")).alias("median"), "excluded", F.round("pct_free").cast("int").alias("pct_free"))


def status_page(state: DataFrame, hash_changes: DataFrame) -> DataFrame:
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    joined = state.join(hash_changes, "slug", "left")
    return joined.select("slug", F.coalesce(labels[F.col("status")], F.col("status")).alias("label"), "last_checked", F.coalesce("hash_changes", F.lit(0)).alias("hash_changes"))


def hours_since(at: Column, now: Column) -> Column:
    return F.timestamp_diff("HOUR", at, now)


#: A health check looks at named frames and returns rows ``(check, problem)``.
Check = Callable[[dict[str, DataFrame]], DataFrame]


def late_run(now: str) -> Check:
    def check(frames: dict[str, DataFrame]) -> DataFrame:
        last = frames["checks"].agg(F.max("checked_at").alias("at"))
        late = last.where(hours_since(F.col("at"), F.lit(now).cast("timestamp")) > STALE_RUN_HOURS)
        return late.select(F.lit("run").alias("check"), F.lit("the last run is late").alias("problem"))

    return check


def overspent(limit: float) -> Check:
    def check(frames: dict[str, DataFrame]) -> DataFrame:
        over = frames["spend"].where(F.col("usd") > limit)
        return over.select(F.lit("spend").alias("check"), F.concat(F.lit("over the limit in "), F.col("month")).alias("problem"))

    return check


def failing(reasons: dict[str, str]) -> Check:
    def check(frames: dict[str, DataFrame]) -> DataFrame:
        known = F.create_map(*(F.lit(x) for pair in reasons.items() for x in pair))
        bad = frames["state"].withColumn("why", known[F.col("status")]).where("why IS NOT NULL")
        return bad.groupBy("why").agg(F.count("*").alias("n")).select(
            F.lit("vendors").alias("check"), F.concat(F.col("n").cast("string"), F.lit(" vendors: "), F.substring(F.replace("why", F.lit("_"), F.lit(" ")), 1, 70)).alias("problem")
        )

    return check


def health(frames: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """Problems of all checks."""
    return reduce(DataFrame.unionByName, (c(frames) for c in checks))
