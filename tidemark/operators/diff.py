"""Typed changes between two readings of a vendor's plans, with confidence and routing.

Plans are rows ``(vendor, key, pos, name, monthly_price, annual_price_per_month,
is_custom_pricing, is_per_seat, limits map<string,double>, features array<string>)``;
readings are rows ``(vendor, currency, pricing_is_public, extraction_notes)``. Every rule
is one projection of the joined plans, so the whole diff shuffles the plans once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the rules.
PUBLISH_AT, IMPLAUSIBLE_MULTIPLE, MIN_PERCENT = 0.80, 4.0, 1.0

#: Confidence of each rule as a share of the base.
RULE_SHARE = {
    "currency_changed": 0.4, "price_availability_changed": 0.7, "billing_model_changed": 0.8,
    "limit_changed": 0.9, "feature_added": 0.6, "feature_moved_out": 0.6,
}
IMPLAUSIBLE_SHARE = 0.3


def base_confidence(notes: Column, plans: Column, currency: Column) -> Column:
    """0.95, less for notes, no plans or a single one, or no currency."""
    lost = (
        F.when(F.coalesce(notes, F.lit("")) != "", 0.15).otherwise(0.0)
        + F.when(plans == 0, 0.4).when(plans == 1, 0.1).otherwise(0.0)
        + F.when(F.coalesce(currency, F.lit("")) == "", 0.1).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), 0.95 - lost), 2)


def last_by_key(plans: DataFrame) -> DataFrame:
    """One row per (vendor, key): the last of duplicates by position."""
    rest = [c for c in plans.columns if c not in ("vendor", "key")]
    best = plans.groupBy("vendor", "key").agg(F.max_by(F.struct(*rest), "pos").alias("p"))
    return best.select("vendor", "key", "p.*")


def join_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both versions of each plan: columns ``vendor, key, old, new`` with null structs where absent."""
    side = lambda df, name: df.select("vendor", "key", F.struct(*(c for c in df.columns if c not in ("vendor", "key"))).alias(name))
    return side(old, "old").join(side(new, "new"), ["vendor", "key"], "full_outer")


def plans_added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("vendor", "key"), ["vendor", "key"], "left_anti")


def plans_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("vendor", "key"), ["vendor", "key"], "left_anti")


def is_noise(old: Column, new: Column) -> Column:
    """A move below one per cent of a price that is not 0."""
    return F.coalesce((old != 0) & (F.abs((new - old) / F.nullif(old, F.lit(0.0)) * 100) < MIN_PERCENT), F.lit(False))


def is_implausible(old: Column, new: Column) -> Column:
    """More than a fourfold move from a positive price, or a fall to nothing."""
    low, high = F.least(old, new), F.greatest(old, new)
    return F.coalesce((old > 0) & ((low <= 0) | (F.try_divide(high, low) > IMPLAUSIBLE_MULTIPLE)), F.lit(False))


def _event(kind: str, when: Column, plan, field, old_num=None, new_num=None, old_text=None, new_text=None, share: Column | float = 1.0) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    number = lambda x: F.lit(None).cast("double") if x is None else x.cast("double")
    body = F.struct(
        F.lit(kind).alias("change_type") if isinstance(kind, str) else kind.alias("change_type"),
        text(plan).alias("plan"),
        text(field).alias("field"),
        number(old_num).alias("old_num"),
        number(new_num).alias("new_num"),
        text(old_text).alias("old_text"),
        text(new_text).alias("new_text"),
        (F.lit(share) if isinstance(share, float) else share).cast("double").alias("share"),
    )
    return F.when(F.coalesce(when, F.lit(False)), body)


def plan_events(joined: DataFrame, compare_prices: Column) -> DataFrame:
    """All events of the plan rules: (vendor, key, event struct), one row per event."""
    return joined.select("vendor", "key", F.explode(_plan_events(compare_prices)).alias("event")).where("event IS NOT NULL")


def _plan_events(compare_prices: Column) -> Column:
    """An event or null per rule for the structs ``old`` and ``new`` of a plan."""
    old, new = F.col("old"), F.col("new")
    both = old.isNotNull() & new.isNotNull()
    name = new["name"]
    events = [
        _event("plan_added", old.isNull(), name, None, new_num=new["monthly_price"]),
        _event("plan_removed", new.isNull(), old["name"], None, old_num=old["monthly_price"]),
        _event("plan_renamed", both & (old["name"] != name), name, F.lit("name"), old_text=old["name"], new_text=name),
        _event("custom_pricing_changed", both & (old["is_custom_pricing"] != new["is_custom_pricing"]), name, F.lit("is_custom_pricing"),
               old_text=old["is_custom_pricing"].cast("string"), new_text=new["is_custom_pricing"].cast("string")),
        _event("billing_model_changed", both & (old["is_per_seat"] != new["is_per_seat"]), name, F.lit("is_per_seat"),
               old_text=old["is_per_seat"].cast("string"), new_text=new["is_per_seat"].cast("string"), share=RULE_SHARE["billing_model_changed"]),
    ]
    for field in ("monthly_price", "annual_price_per_month"):
        a, b = old[field], new[field]
        events.append(
            _event("price_availability_changed", both & compare_prices & (a.isNull() != b.isNull()), name, F.lit(field), a, b,
                   share=RULE_SHARE["price_availability_changed"])
        )
        moved = both & compare_prices & (a != b) & ~is_noise(a, b)
        kind = F.when(b > a, "price_increase").otherwise("price_decrease")
        events.append(_event(kind, moved, name, F.lit(field), a, b, share=F.when(is_implausible(a, b), IMPLAUSIBLE_SHARE).otherwise(1.0)))
    metrics = F.array_intersect(F.map_keys(old["limits"]), F.map_keys(new["limits"]))
    limits = F.transform(
        F.when(both, metrics),
        lambda m: _event("limit_changed", ~old["limits"][m].eqNullSafe(new["limits"][m]), name, m, old["limits"][m], new["limits"][m], share=RULE_SHARE["limit_changed"]),
    )
    gained = F.transform(F.when(both, F.array_except(new["features"], old["features"])),
                         lambda f: _event("feature_added", F.lit(True), name, F.lit("features"), new_text=f, share=RULE_SHARE["feature_added"]))
    lost = F.transform(F.when(both, F.array_except(old["features"], new["features"])),
                       lambda f: _event("feature_moved_out", F.lit(True), name, F.lit("features"), old_text=f, share=RULE_SHARE["feature_moved_out"]))
    empty = F.array().cast("array<struct<change_type:string,plan:string,field:string,old_num:double,new_num:double,old_text:string,new_text:string,share:double>>")
    return reduce(F.concat, (F.coalesce(x, empty) for x in (limits, gained, lost)), F.array(*events))


def _reading_events() -> Column:
    """An event or null per rule for a whole reading, from the structs ``was`` and ``now``."""
    old, new = F.col("was"), F.col("now")
    was, now = (F.coalesce(x["pricing_is_public"], F.lit(False)) for x in (old, new))
    before, after = (F.coalesce(x["currency"], F.lit("")) for x in (old, new))
    return F.array(
        _event("pricing_hidden", was & ~now, None, None, old_text=F.lit("true"), new_text=F.lit("false")),
        _event("pricing_published", ~was & now, None, None, old_text=F.lit("false"), new_text=F.lit("true")),
        _event("currency_changed", (before != "") & (before != after), None, F.lit("currency"), old_text=before, new_text=after, share=RULE_SHARE["currency_changed"]),
    )


def diff_readings(old_plans: DataFrame, new_plans: DataFrame, old_readings: DataFrame, new_readings: DataFrame) -> DataFrame:
    """All events between two readings of each vendor that has both, as :func:`diff_sides` says."""
    both = lambda old, new: old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    return diff_sides(both(old_plans, new_plans), both(old_readings, new_readings))


def diff_sides(plans: DataFrame, readings: DataFrame, tasks: int | None = None) -> DataFrame:
    """All events between two readings of each vendor that has both; ``new`` tells the side of a plan or reading.

    A first reading has no events. Prices are not compared when both currencies are known
    and differ. Returns (vendor, key, change_type, plan, field, old_num, new_num, old_text,
    new_text, confidence, publishable).

    Plans and readings of both sides are shuffled once, by vendor; sides meet in a group-by and readings reach
    their plans in a window, so nothing is joined or broadcast and no event is shuffled. ``tasks`` bounds what a task sorts.
    """
    of = lambda rows, *more: F.struct(*(c for c in rows.columns if c not in ("vendor", "new", *more)))
    # Plans without a key are no two sides of one plan; a reading is a row of its own.
    side = F.when(F.col("key").isNull(), F.col("new").cast("int"))
    rows = plans.select("vendor", "key", side.alias("_apart"), "new", of(plans, "key").alias("plan"))
    said = readings.select("vendor", F.lit(None).cast("string").alias("key"), F.lit(2).alias("_apart"), "new", F.struct("currency", "pricing_is_public", "extraction_notes").alias("reading"))
    rows = rows.unionByName(said, allowMissingColumns=True)
    rows = rows.repartition("vendor") if tasks is None else rows.repartition(tasks, "vendor")

    new, plan = F.col("new"), F.col("plan").isNotNull()
    last = lambda on: F.max_by("plan", F.when(plan & on, F.coalesce("plan.pos", F.lit(-(2**31)))))
    grouped = rows.groupBy("vendor", "key", "_apart").agg(
        last(~new).alias("old"), last(new).alias("new"), F.count_if(plan & new).alias("plans"),
        F.max(F.when(~new, F.col("reading"))).alias("was"), F.max(F.when(new, F.col("reading"))).alias("now"),
    )
    vendor = Window.partitionBy("vendor")
    known = grouped.withColumns({"was": F.max("was").over(vendor), "now": F.max("now").over(vendor), "plans": F.sum("plans").over(vendor)})
    known = known.where("was IS NOT NULL AND now IS NOT NULL AND vendor IS NOT NULL")
    before, after = (F.coalesce(F.col(f"{x}.currency"), F.lit("")) for x in ("was", "now"))
    base = base_confidence(F.col("now.extraction_notes"), F.col("plans"), after)
    comparable = (before == "") | (after == "") | (before == after)
    listed = F.when(F.coalesce("_apart", F.lit(0)) == 2, _reading_events()).otherwise(_plan_events(comparable))
    events = known.select("vendor", "key", base.alias("base"), F.explode(listed).alias("event")).where("event IS NOT NULL")
    confident = events.select("vendor", "key", "event.*", F.round(F.col("base") * F.col("event.share"), 4).alias("confidence"))
    return confident.drop("share").withColumn("publishable", is_publishable(F.col("confidence")))


def is_publishable(confidence: Column) -> Column:
    return confidence >= PUBLISH_AT
