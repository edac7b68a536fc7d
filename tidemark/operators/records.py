"""Nested price records: normalising, fingerprints and what a record says at a glance.

A record is ``struct<currency, pricing_is_public, extraction_notes, plans array<plan>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import plan_key, strip_space

LIMIT = "struct<metric:string,value:double,unit:string>"
PLAN = (
    "struct<name:string,key:string,monthly_price:double,annual_price_per_month:double,is_free:boolean,"
    "is_custom_pricing:boolean,is_per_seat:boolean,is_addon:boolean,min_seats:int,trial_days:int,"
    f"limits:array<{LIMIT}>,features:array<string>>"
)
RECORD = f"struct<currency:string,pricing_is_public:boolean,extraction_notes:string,plans:array<{PLAN}>>"

#: The shape in which extractors may deliver a record: amounts and counts as text.
RAW_LIMIT = "struct<metric:string,value:string,unit:string>"
RAW_PLAN = (
    "struct<name:string,monthly_price:string,annual_price_per_month:string,is_free:boolean,is_custom_pricing:boolean,"
    f"is_per_seat:boolean,is_addon:boolean,min_seats:string,trial_days:string,limits:array<{RAW_LIMIT}>,features:array<string>>"
)
RAW_RECORD = f"struct<currency:string,pricing_is_public:boolean,extraction_notes:string,plans:array<{RAW_PLAN}>>"


def amount(text: Column) -> Column:
    """A price or limit, to two places, or null."""
    return F.round(text.try_cast("double"), 2)


def _truth(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _limits(limits: Column) -> Column:
    kept = F.filter(limits, lambda x: F.coalesce(x["metric"], F.lit("")) != "")
    clean = F.transform(
        kept,
        lambda x: F.struct(
            F.lower(strip_space(x["metric"])).alias("metric"),
            amount(x["value"]).alias("value"),
            F.nullif(x["unit"], F.lit("")).alias("unit"),
        ),
    )
    return F.coalesce(F.array_sort(clean, lambda a, b: F.when(a["metric"] < b["metric"], -1).when(a["metric"] > b["metric"], 1).otherwise(0)), F.array().cast(f"array<{LIMIT}>"))


def _features(features: Column) -> Column:
    clean = F.filter(F.transform(features, lambda x: F.lower(strip_space(x))), lambda x: x != "")
    return F.coalesce(F.sort_array(F.array_distinct(clean)), F.array().cast("array<string>"))


def _plan(p: Column) -> Column:
    name, free = strip_space(p["name"]), _truth(p["is_free"])
    monthly = amount(p["monthly_price"])
    return F.struct(
        name.alias("name"),
        plan_key(name).alias("key"),
        F.when(free & monthly.isNull(), 0.0).otherwise(monthly).alias("monthly_price"),
        amount(p["annual_price_per_month"]).alias("annual_price_per_month"),
        free.alias("is_free"),
        *(_truth(p[c]).alias(c) for c in ("is_custom_pricing", "is_per_seat", "is_addon")),
        *(p[c].try_cast("int").alias(c) for c in ("min_seats", "trial_days")),
        _limits(p["limits"]).alias("limits"),
        _features(p["features"]).alias("features"),
    )


def normalize_record(raw: Column, public_given: Column | None = None) -> Column:
    """A canonical record from a raw one.

    ``public_given`` tells whether the raw record names ``pricing_is_public`` at all: a
    missing flag means public, a null one does not. Plans without a name go; plans are
    sorted by price, unpriced last, then key.
    """
    named = F.filter(raw["plans"], lambda p: F.coalesce(strip_space(p["name"]), F.lit("")) != "")
    plans = F.transform(
        F.transform(named, _plan),
        lambda p, i: F.struct(
            p["monthly_price"].isNull().alias("u"), F.coalesce(p["monthly_price"], F.lit(0.0)).alias("m"), p["key"].alias("k"), i.alias("i"), p.alias("p")
        ),
    )
    order = F.transform(
        F.array_sort(plans, lambda a, b: _compare(a, b, ("u", "m", "k", "i"))), lambda x: x["p"]
    )
    public = _truth(raw["pricing_is_public"])
    if public_given is not None:
        public = F.when(~public_given, True).otherwise(public)
    return F.struct(
        F.substring(F.upper(strip_space(F.coalesce(raw["currency"], F.lit("")))), 1, 3).alias("currency"),
        public.alias("pricing_is_public"),
        strip_space(F.coalesce(raw["extraction_notes"], F.lit(""))).alias("extraction_notes"),
        F.coalesce(order, F.array().cast(f"array<{PLAN}>")).alias("plans"),
    )


def _compare(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    result = F.lit(0)
    for field in reversed(fields):
        result = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(result)
    return result


def _cents(value: Column) -> Column:
    """An amount as text that does not depend on how an engine prints doubles."""
    return F.coalesce(F.round(value * 100).cast("bigint").cast("string"), F.lit("None"))


def plan_text(p: Column) -> Column:
    limits = F.array_join(
        F.transform(F.array_sort(F.transform(p["limits"], lambda x: F.struct(x["metric"], x["value"]))), lambda x: F.concat(x["metric"], F.lit("="), _cents(x["value"]))), ","
    )
    flags = (p[c].cast("string") for c in ("is_free", "is_custom_pricing", "is_addon"))
    return F.concat_ws("|", p["key"], _cents(p["monthly_price"]), _cents(p["annual_price_per_month"]), *flags, limits, F.array_join(F.sort_array(p["features"]), ","))


def record_fingerprint(record: Column) -> Column:
    """A digest of what a page offers, blind to plan order, display names, notes and times.

    A record that does not say whether its prices are public counts as public.
    """
    texts = F.array_sort(F.transform(record["plans"], lambda p: F.struct(p["key"].alias("k"), plan_text(p).alias("t"))))
    plans = F.array_join(F.transform(texts, lambda x: x["t"]), "||")
    head = F.concat_ws("|", F.coalesce(record["currency"], F.lit("")), F.coalesce(record["pricing_is_public"], F.lit(True)).cast("string"))
    return F.when(record.isNull(), "").otherwise(F.sha2(F.concat_ws("||", head, plans), 256))


def plan_price(monthly: Column, annual: Column) -> tuple[Column, Column]:
    """(price, basis): the monthly price unless it is null or 0, else the annual one."""
    by_month, by_year = F.nullif(monthly, F.lit(0.0)), F.nullif(annual, F.lit(0.0))
    basis = F.when(by_month.isNotNull(), "monthly").when(by_year.isNotNull(), "annual").otherwise("none")
    return F.coalesce(by_month, by_year), basis


def headline_prices(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Entry and top price per key over real, priced, non-custom plans; basis annual if all are."""
    price, basis = plan_price(F.col("monthly_price"), F.col("annual_price_per_month"))
    real = plans.where(~_truth(F.col("is_addon")) & ~_truth(F.col("is_custom_pricing")))
    priced = real.select(*keys, price.alias("price"), basis.alias("basis")).where("price IS NOT NULL")
    every = F.bool_and(F.col("basis") == "annual")
    return priced.groupBy(*keys).agg(
        F.min("price").alias("entry_price"), F.max("price").alias("top_price"), F.when(every, "annual").otherwise("monthly").alias("basis")
    )


def vendor_flags(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any plan is free, per seat or custom: over real plans, and over all."""
    real = ~_truth(F.col("is_addon"))
    any_of = lambda c, where: F.coalesce(F.bool_or(F.when(where, _truth(F.col(c)))), F.lit(False))
    flags = [("free", "is_free"), ("seat", "is_per_seat"), ("custom", "is_custom_pricing")]
    return plans.groupBy(*keys).agg(
        *(any_of(c, real).alias(f"{n}_real") for n, c in flags),
        *(any_of(c, F.lit(True)).alias(f"{n}_any") for n, c in flags),
        F.count_if(real).alias("real_plans"),
    )


def all_features(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct features of the real plans: (keys, feature), one row each."""
    real = plans.where(~_truth(F.col("is_addon")))
    return real.select(*keys, F.explode("features").alias("feature")).distinct()


def aggregate_offer(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest, highest and number of offers: real plans with a monthly price, free ones included."""
    real = plans.where(~_truth(F.col("is_addon"))).where("monthly_price IS NOT NULL")
    return real.groupBy(*keys).agg(
        F.min("monthly_price").alias("low_price"), F.max("monthly_price").alias("high_price"), F.count("*").alias("offer_count")
    )
