"""Pages, feeds and digests as text columns; a driver writes only bounded reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import html_escape, money, pretty_date


def event_phrase(kind: Column, plan: Column, old: Column, new: Column) -> Column:
    """A change in words."""
    known = F.coalesce(plan, F.lit("the page"))
    moved = F.concat(F.lit(" from "), F.coalesce(old, F.lit("nothing")), F.lit(" to "), F.coalesce(new, F.lit("nothing")))
    verb = (
        F.when(kind == "price_increase", F.concat(known, F.lit(" went up"), moved))
        .when(kind == "price_decrease", F.concat(known, F.lit(" went down"), moved))
        .when(kind == "plan_added", F.concat(known, F.lit(" is new")))
        .when(kind == "plan_removed", F.concat(known, F.lit(" is gone")))
        .when(kind == "plan_renamed", F.concat(old, F.lit(" is now called "), new))
        .when(kind == "pricing_hidden", F.lit("prices are no longer public"))
        .when(kind == "pricing_published", F.lit("prices are public"))
        .when(kind == "feature_added", F.concat(known, F.lit(" gained "), new))
        .when(kind == "feature_moved_out", F.concat(known, F.lit(" lost "), old))
    )
    return F.coalesce(verb, F.concat(known, F.lit(": "), F.replace(kind, F.lit("_"), F.lit(" ")), moved))


def feed_xml(items: DataFrame, base: str, title: str) -> str:
    """An RSS document of ``items(rank, title, link, guid)``, a bounded report."""
    item = F.concat(
        F.lit("<item><title>"), "title", F.lit("</title><link>"), html_escape(F.concat(F.lit(base), F.col("link"))),
        F.lit('</link><guid isPermaLink="false">'), html_escape(F.col("guid")), F.lit("</guid></item>"),
    )
    rows = items.orderBy("rank").select(item.alias("x")).collect()
    return f'<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>{title}</title><link>{base}</link>' + "".join(r["x"] for r in rows) + "</channel></rss>"


def sitemap_rows(pages: DataFrame, base: str) -> DataFrame:
    """A ``<url>`` element per page of ``(page, lastmod)``, to be written as text parts."""
    loc = html_escape(F.concat(F.lit(base), F.col("page")))
    return pages.select(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), F.col("lastmod").cast("string"), F.lit("</lastmod></url>")).alias("value"))


def json_ld(fields: Column) -> Column:
    """A struct as a JSON-LD document that is safe inside a script element."""
    body = F.to_json(fields)
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        body = F.replace(body, F.lit(sign), F.lit(code))
    return body


def _schema(kind: str, **fields) -> Column:
    """JSON-LD of a type of schema.org from columns and plain values."""
    known = [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type")]
    return json_ld(F.struct(*known, *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


def site_schema(name: str, base: str, description: str) -> Column:
    """The site as a WebSite."""
    return _schema("WebSite", name=name, url=base, description=description)


def dataset_schema(totals: DataFrame, name: str, base: str) -> DataFrame:
    """``totals(vendors, changes, since)`` with ``json_ld``, the archive as a Dataset."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    vendors, changes, since = (F.col(c) for c in ("vendors", "changes", "since"))
    described = text("Published prices of ", vendors, " vendors, read daily since ", since, "; ", changes, " changes.")
    creator = F.struct(F.lit("Organization").alias("@type"), F.lit(name).alias("name"))
    own = _schema("Dataset", name=f"{name} price archive", description=described, url=base, creator=creator, temporalCoverage=text(since, "/.."), isAccessibleForFree=True)
    return totals.withColumn("json_ld", own)


def product_schema(offers: DataFrame, name: str, currency: str) -> DataFrame:
    """JSON-LD of aggregate offers that is safe inside a script element."""
    body = json_ld(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("Product").alias("@type"),
            F.col(name).cast("string").alias("name"),
            F.struct(
                F.lit("AggregateOffer").alias("@type"),
                F.col("low_price").alias("lowPrice"),
                F.col("high_price").alias("highPrice"),
                F.col("offer_count").alias("offerCount"),
                F.col(currency).alias("priceCurrency"),
            ).alias("offers"),
        )
    )
    return offers.withColumn("json_ld", body)


def digest_markdown(digest: DataFrame, days: int) -> str:
    """A digest of a row per category in words; categories are few."""
    rows = digest.orderBy("category").collect()
    if not rows:
        return f"No changes in the last {days} days.\n"
    head = f"# {sum(r['changes'] for r in rows)} changes in {days} days\n\n"
    return head + "".join(f"- {r['category']}: {r['changes']} changes at {r['vendors']} vendors\n" for r in rows)


def index_rows(heads: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Cells of the index: entry and top price, free tier and billing of each vendor, and ``more`` columns."""
    entry = F.when(F.col("entry_price").isNull(), "on request").otherwise(money(F.col("currency"), F.col("entry_price")))
    return heads.select(
        "category", "name", entry.alias("entry"), money(F.col("currency"), F.col("top_price")).alias("top"),
        F.when(F.col("has_free"), "yes").otherwise("no").alias("free_tier"), F.when(F.col("per_seat"), "per seat").otherwise("flat").alias("billing"), *(more or []),
    )


def change_rows(changes: DataFrame, currencies: DataFrame | None = None, keys: tuple[str, ...] = ("vendor",), more: tuple[str, ...] = ()) -> DataFrame:
    """Cells of the change list: day, the keys, ``more`` columns, kind of change and phrase; amounts in the currency
    that ``currencies`` has for the keys, or else in USD."""
    if currencies is None:
        changes = changes.withColumn("_currency", F.lit("USD"))
    else:
        changes = changes.join(currencies.select(*keys, F.col("currency").alias("_currency")), list(keys), "left")
    code = F.coalesce(F.nullif("_currency", F.lit("")), F.lit("USD"))
    show = lambda n, t: F.coalesce(money(code, F.col(n)), F.col(t))
    value = lambda side: F.when(F.col(f"{side}_num").isNotNull(), show(f"{side}_num", f"{side}_text")).otherwise(F.col(f"{side}_text"))
    phrase = event_phrase(F.col("change_type"), F.col("plan"), value("old"), value("new"))
    return changes.select(pretty_date(F.col("detected_at").cast("string")).alias("day"), *keys, *more, "change_type", html_escape(phrase).alias("phrase"))
