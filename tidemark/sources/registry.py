"""The vendor registry, fetched pages and made-up data."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import host_of, hrefs, slugify
from tidemark.operators.diff import MIN_PERCENT
from tidemark.operators.records import RECORD
from tidemark.session import remove_folder, shared_folder, stored
from tidemark.sources.fetch import CRAWL_DELAY, Fetcher, fetch_pages

VENDOR_SCHEMA = "name string, slug string, category string, crawl_tier string, pricing_url string"

#: Paths at which a price page is looked for, after the address itself.
PAGE_GUESSES = ("/pricing", "/pricing/", "/plans", "/plans/", "/en/pricing", "/pricing/plans")

#: Characters that a page must have more of to count as reached.
LEAST_CHARS = 500


def vendors_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Vendors of a YAML registry: slug, category and tier have defaults."""
    import yaml

    listed = (yaml.safe_load(text) or {}).get("vendors") or []
    names = [f.split()[0] for f in VENDOR_SCHEMA.split(", ")]
    rows = spark.createDataFrame([tuple(v.get(n) for n in names) for v in listed], VENDOR_SCHEMA)
    return rows.withColumns(
        {
            "slug": F.coalesce("slug", slugify(F.col("name"))),
            "category": F.coalesce("category", F.lit("uncategorised")),
            "crawl_tier": F.coalesce("crawl_tier", F.lit("daily")),
        }
    )


def _root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def guessed_addresses(pages: DataFrame) -> DataFrame:
    """Addresses to try without reading anything, in order: ``(url)`` to ``(url, candidate, place)``.

    The slash at the end turned, then the usual paths of the host that are not the address itself.
    """
    bare = F.regexp_replace("url", "/+$", "")
    turned = F.when(F.col("url").endswith("/"), bare).otherwise(F.concat("url", F.lit("/")))
    guesses = F.filter(F.array(*(F.concat(_root(F.col("url")), F.lit(g)) for g in PAGE_GUESSES)), lambda g: F.regexp_replace(g, "/+$", "") != bare)
    return pages.select("url", F.posexplode(F.array_distinct(F.concat(F.array(turned), guesses))).alias("place", "candidate"))


def linked_addresses(pages: DataFrame) -> DataFrame:
    """Links of a home page that look like prices and stay on its host, in order: ``(url, html)`` to
    ``(url, candidate, place)``."""
    root = _root(F.col("url"))
    links = F.filter(hrefs(F.coalesce("html", F.lit(""))), lambda h: F.lower(h).rlike("pricing|/plans"))
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    absolute = F.transform(
        links, lambda h: F.when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(root, h)).when(h.startswith("http"), h)
    )
    own = F.filter(absolute, lambda h: (h == root) | h.rlike("^[^/]*//[^/?#]*[/?#]") & h.startswith(root) & F.substring(h, F.length(root) + 1, F.lit(1)).isin("/", "?", "#"))
    return pages.select("url", F.posexplode(F.array_distinct(own)).alias("place", "candidate"))


def address_candidates(pages: DataFrame) -> DataFrame:
    """Where else a page may be, in order: ``(url, html)`` to ``(url, candidate, place)``.

    Guesses first, then links of the page's ``html``.
    """
    guessed = guessed_addresses(pages)
    both = guessed.withColumn("late", F.lit(False)).unionByName(linked_addresses(pages).withColumn("late", F.lit(True)))
    first = both.groupBy("url", "candidate").agg(F.min(F.struct("late", "place")).alias("at"))
    line = Window.partitionBy("url").orderBy("at")
    return first.select("url", "candidate", (F.row_number().over(line) - 1).alias("place"))


def find_moved_pages(
    lost: DataFrame, fetcher: Fetcher, allow: Callable[[DataFrame], DataFrame] | None = None, delay: float = CRAWL_DELAY, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """(url, found) of pages ``lost(url)`` that are at another address now; ``found`` is null for the rest.

    A round asks for the next candidate of every page that is still lost, in the order of
    :func:`guessed_addresses`; a page leaves with its first answer of status 200 and more than ``least_chars``
    characters, and nothing is asked for after it. Then the home pages of what is left are read, and rounds go on
    over their links. A candidate that several pages share is asked for once in all, and candidates that
    ``allow`` (of (url, host), giving ``allowed``) forbids never. Rounds are as many as a page has candidates; each works on the pages
    that are still lost and leaves a written table.
    """
    spark = lost.sparkSession
    folder = f"{shared_folder(spark)}/moved-{uuid.uuid4().hex}"
    left = stored(lost.select("url").where("url IS NOT NULL").distinct(), f"{folder}/lost")
    found = spark.createDataFrame([], "url string, found string")
    known = spark.createDataFrame([], "candidate string, good boolean, html string")
    number = 0

    def answers(asked: DataFrame) -> DataFrame:
        """(candidate, good, html) of ``asked(candidate)``, each asked for once over all rounds."""
        nonlocal known, number
        fresh = asked.join(known.select("candidate"), "candidate", "left_anti").select(F.col("candidate").alias("url"))
        judged = fresh.withColumn("allowed", F.lit(True)) if allow is None else allow(fresh.withColumn("host", host_of(F.col("url"))))
        pages = fetch_pages(judged, fetcher, delay, f"{folder}/pages-{number}", retries=0)
        good = (F.coalesce("status", F.lit(0)) == 200) & (F.length("html") > least_chars)
        said = pages.select(F.col("url").alias("candidate"), F.coalesce(good, F.lit(False)).alias("good"), "html")
        known = known.unionByName(stored(said, f"{folder}/known-{number}"))
        remove_folder(spark, f"{folder}/pages-{number}")
        number += 1
        return known

    def rounds(candidates: DataFrame) -> None:
        nonlocal left, found
        places = candidates.agg(F.max("place")).first()[0]
        for place in range(-1 if places is None else places + 1):
            now = candidates.where(F.col("place") == place).join(left, "url", "left_semi")
            tried = now.join(answers(now.select("candidate").distinct()), "candidate").where("good")
            hits = stored(tried.select("url", F.col("candidate").alias("found")), f"{folder}/found-{number}")
            found = found.unionByName(hits)
            left = stored(left.join(hits, "url", "left_anti"), f"{folder}/left-{number}")
            if left.isEmpty():
                return

    rounds(stored(guessed_addresses(left), f"{folder}/guessed"))
    if not left.isEmpty():
        homes = left.select("url", _root(F.col("url")).alias("candidate")).where("candidate <> ''")
        read = homes.join(answers(homes.select("candidate").distinct()), "candidate").where("html IS NOT NULL")
        rounds(stored(linked_addresses(read.select("url", "html")), f"{folder}/linked"))
    result = stored(lost.select("url").where("url IS NOT NULL").distinct().join(found, "url", "left"), f"{folder}-found")
    remove_folder(spark, folder)
    return result


def first_reachable(candidates: DataFrame, reachable: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The first candidate of each url among ``reachable(candidate, html)`` pages that are long enough."""
    good = candidates.join(reachable.where(F.length("html") > least_chars).select("candidate"), "candidate")
    return good.groupBy("url").agg(F.min_by("candidate", "place").alias("found"))


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``urls(url, host)`` with ``allowed`` from ``robots(host, text)``; hosts without a file allow all.

    A host's rules are read once per batch of its urls.
    """
    def judge(urls: pd.Series, texts: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsers: dict[str, RobotFileParser] = {}

        def one(url, text):
            if text is None:
                return True
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            return parsers[text].can_fetch(agent, url)

        return pd.Series([one(u, t) for u, t in zip(urls, texts, strict=True)])

    joined = urls.join(robots.select("host", "text"), "host", "left")
    return joined.withColumn("allowed", F.pandas_udf(judge, "boolean")("url", "text")).drop("text")


def patched_registry(text: str, found: list[tuple[str, str]]) -> str:
    """A YAML registry with price pages moved: each (old, new) address; comments and layout stay.

    An address is only taken whole, as the value of a ``pricing_url``.
    """
    moved = dict(found)
    return re.sub(r"(?m)^(\s*(?:-\s+)?pricing_url:\s*[\"']?)([^\s\"'#]+)", lambda m: m[1] + moved.get(m[2], m[2]), text)


#: The odds of a day's events, in thousandths, and what makes the numbers of a walk.
_UP, _DOWN, _SEATS, _EXPORT, _OF = 60, 90, 110, 125, 1000
_WALK = (7919, 104729, 31, 611)


def walk_day(n: Column) -> Column:
    """The date of a walk's day ``n``."""
    return F.date_add(F.lit("2024-01-01").cast("date"), n)


def made_up_walk(vendors: DataFrame, days: int, seed: int = 7) -> DataFrame:
    """(slug, number, n, day, units, seats, export) of made-up vendors ``(slug, number)``, on ``days`` days each.

    A walk from which snapshots, records and changes all follow: on a few days the price of a unit goes up or
    down, the seats of a plan grow, or an export comes or goes. Each day's event follows from the vendor's
    number, the day and the seed alone; what holds on a day is the sum of the events up to it.
    """
    a, b, c, d = _WALK
    daily = vendors.select("slug", F.col("number").cast("long").alias("number"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("n"))
    drawn = F.pmod(F.col("number") * a + F.col("n") * b + F.col("number") * F.col("n") * c + seed * d, F.lit(_OF))
    on = F.col("n") > 0
    moved = F.when(on & (drawn < _UP), 1 + drawn % 4).when(on & (drawn < _DOWN), -1).otherwise(0)
    line = Window.partitionBy("slug", "number").orderBy("n")
    total = lambda x: F.sum(x.cast("long")).over(line)
    return daily.select(
        "slug", "number", "n", walk_day(F.col("n")).alias("day"),
        (20 + F.pmod("number", F.lit(60)) + total(moved)).alias("units"),
        (5 + total(F.when(on & (drawn >= _DOWN) & (drawn < _SEATS), 5).otherwise(0))).alias("seats"),
        (total(F.when(on & (drawn >= _SEATS) & (drawn < _EXPORT), 1).otherwise(0)) % 2 == 1).alias("export"),
    )


def walk_records(walk: DataFrame, steps: int = 3) -> DataFrame:
    """(slug, day, n, record, demo) on each day of a walk: a ladder of ``steps`` plans."""
    plan = lambda x: F.struct(
        F.concat(F.lit("Step "), x.cast("string")).alias("name"), F.concat(F.lit("step"), x.cast("string")).alias("key"), (F.col("units") * x).cast("double").alias("monthly_price"),
        F.round(F.col("units") * x * 0.8, 2).alias("annual_price_per_month"), F.lit(False).alias("is_free"), F.lit(False).alias("is_custom_pricing"),
        (F.col("number") % 2 == 0).alias("is_per_seat"), F.lit(False).alias("is_addon"), F.lit(None).cast("int").alias("min_seats"), F.lit(14).alias("trial_days"),
        F.array(F.struct(F.lit("seats").alias("metric"), (x * F.col("seats")).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))).alias("limits"),
        F.when(F.col("export"), F.array(F.lit("export"), F.lit("support"))).otherwise(F.array(F.lit("support"))).alias("features"),
    )
    record = F.struct(F.lit("USD").alias("currency"), F.lit(True).alias("pricing_is_public"), F.lit("").alias("extraction_notes"), F.transform(F.sequence(F.lit(1), F.lit(steps)), plan).alias("plans"))
    return walk.select("slug", "day", "n", record.cast(RECORD).alias("record"), F.lit(True).alias("demo"))


def walk_snapshots(walk: DataFrame, steps: int = 3) -> DataFrame:
    """(slug, day, text) on each day of a walk: what the extractor reads the day's plans from."""
    plan = lambda x: F.concat_ws(
        "\n", F.concat(F.lit("Step "), x.cast("string")), F.concat(F.lit("$"), (F.col("units") * x).cast("string"), F.lit(" per month")),
        F.concat((F.col("seats") * x).cast("string"), F.lit(" seats")), F.lit("Support"), F.when(F.col("export"), "Export"),
    )
    text = F.concat(F.lit("Pricing plans\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(steps)), plan), "\n"), F.lit("\nbilled monthly"))
    return walk.select("slug", "day", text.alias("text"))


def walk_changes(walk: DataFrame, steps: int = 3) -> DataFrame:
    """(slug, day, key, change_type, field, old_num, new_num, old_text, new_text) of each day of a walk
    against the day before, from its numbers alone; moves below one per cent are no changes."""
    line = Window.partitionBy("slug", "number").orderBy("n")
    before = walk.withColumns({f"_{c}": F.lag(c).over(line) for c in ("units", "seats", "export")}).where("n > 0")
    rung = before.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    nothing, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    x, old, new = F.col("x"), F.col("_units"), F.col("units")
    event = lambda when, kind, field, a=nothing, b=nothing, was=text, now=text: F.when(
        when, F.struct(kind.alias("change_type"), F.lit(field).alias("field"), a.cast("double").alias("old_num"), b.cast("double").alias("new_num"), was.alias("old_text"), now.alias("new_text"))
    )
    kind = F.when(new > old, "price_increase").otherwise("price_decrease")
    prices = {"monthly_price": lambda u: (u * x).cast("double"), "annual_price_per_month": lambda u: F.round(u * x * 0.8, 2)}
    far = lambda a, b: (a != b) & (F.abs((b - a) / a * 100) >= MIN_PERCENT)
    events = [event(far(p(old), p(new)), kind, field, p(old), p(new)) for field, p in prices.items()]
    events.append(event(F.col("_seats") != F.col("seats"), F.lit("limit_changed"), "seats", F.col("_seats") * x, F.col("seats") * x))
    events.append(event(~F.col("_export") & F.col("export"), F.lit("feature_added"), "features", now=F.lit("export")))
    events.append(event(F.col("_export") & ~F.col("export"), F.lit("feature_moved_out"), "features", was=F.lit("export")))
    listed = rung.select("slug", "day", F.concat(F.lit("step"), x.cast("string")).alias("key"), F.explode(F.array_compact(F.array(*events))).alias("e"))
    return listed.select("slug", "day", "key", "e.*")


def made_up_snapshots(spark: SparkSession, vendors: int, days: int, seed: int = 7) -> DataFrame:
    """(slug, day, text) of made-up price pages; a vendor's price moves about every tenth day."""
    at = spark.range(vendors * days).select((F.col("id") / days).cast("long").alias("vendor"), (F.col("id") % days).cast("int").alias("n"))
    price = 10 + F.col("vendor") % 90 + F.floor((F.col("n") + F.pmod(F.xxhash64("vendor", F.lit(seed)), F.lit(10))) / 10)
    text = F.concat(F.lit("Pricing plans\nStandard\n$"), price.cast("string"), F.lit(" per month\nbilled monthly"))
    return at.select(F.concat(F.lit("vendor-"), F.col("vendor").cast("string")).alias("slug"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day"), text.alias("text"))


def made_up_records(spark: SparkSession, vendors: int, steps: int = 3, seed: int = 7) -> DataFrame:
    """(slug, record, demo) of made-up records, each a ladder of ``steps`` plans of rising price."""
    vendor, rung = F.col("id"), lambda x: (F.lit(10) + F.col("id") % 90) * x
    plan = lambda x: F.struct(
        F.concat(F.lit("Step "), x.cast("string")).alias("name"), F.concat(F.lit("step"), x.cast("string")).alias("key"), rung(x).cast("double").alias("monthly_price"),
        F.round(rung(x) * 0.8, 2).alias("annual_price_per_month"), F.lit(False).alias("is_free"), F.lit(False).alias("is_custom_pricing"),
        (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0).alias("is_per_seat"), F.lit(False).alias("is_addon"), F.lit(None).cast("int").alias("min_seats"), F.lit(14).alias("trial_days"),
        F.array(F.struct(F.lit("seats").alias("metric"), (x * 5).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))).alias("limits"),
        F.array(F.lit("support")).alias("features"),
    )
    record = F.struct(F.lit("USD").alias("currency"), F.lit(True).alias("pricing_is_public"), F.lit("").alias("extraction_notes"), F.transform(F.sequence(F.lit(1), F.lit(steps)), plan).alias("plans"))
    return spark.range(vendors).select(F.concat(F.lit("vendor-"), vendor.cast("string")).alias("slug"), record.cast(RECORD).alias("record"), F.lit(True).alias("demo"))


def made_up_changes(spark: SparkSession, vendors: int, per_vendor: int, seed: int = 7) -> DataFrame:
    """A change log without any source: every value follows from its place and the seed."""
    base = spark.range(vendors * per_vendor).withColumn("vendor", (F.col("id") / per_vendor).cast("long"))
    step = F.col("id") % per_vendor
    noise = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1000)) / 1000.0
    price = F.round(10 + F.col("vendor") % 90 + step * (1 + noise(1)), 2)
    return base.select(
        F.col("id").alias("event_id"),
        "vendor",
        F.lit("standard").alias("plan"),
        F.lit("monthly_price").alias("field"),
        F.when(step > 0, F.round(price - noise(2) - 0.5, 2)).alias("old_value"),
        price.alias("new_value"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(step.cast("int"))).alias("detected_at"),
        F.lit(True).alias("demo"),
    )
