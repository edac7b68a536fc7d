"""Command line over a folder of stored runs.

    python -m tidemark fetch FOLDER --registry YAML --day 2024-01-31 --pages PARQUET [--all] [--only SLUG ...] [--fix-urls]
    python -m tidemark run FOLDER --pages PARQUET --day 2024-01-31 [--registry YAML] [--all] [--budget 0.5] [--force] [--dry-run] [--only SLUG ...]
    python -m tidemark publish FOLDER --registry YAML --site FOLDER --day 2024-01-31 [--base URL] [--title TEXT]
    python -m tidemark digest FOLDER --day 2024-01-31 [--days 7] [--registry YAML]
    python -m tidemark review FOLDER [--top 50]
    python -m tidemark advise FOLDER --day 2024-01-31 [--site-down]
    python -m tidemark diagnose FOLDER --pages PARQUET [--out FOLDER] SLUG
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import gate, reports, site
from tidemark.operators.html import clean_pages
from tidemark.operators.ranks import places
from tidemark.operators.records import RECORD
from tidemark.plans.ingest import STATE, ingest, state_after
from tidemark.plans.publish import SiteTables, publish_site
from tidemark.plans.render import digest_markdown
from tidemark.session import put_text, session
from tidemark.sources import fetch as fetching
from tidemark.sources.registry import allowed_by_robots, find_moved_pages, patched_registry, vendors_from_yaml
from tidemark.sources.runs import RunStore
from tidemark.sources.sinks import add_spend

#: The tables that a run changes together.
TABLES = {
    "state": STATE,
    "baseline": f"slug string, record {RECORD}",
    "pending": f"slug string, record {RECORD}",
    "changes": "vendor string, key string, change_type string, plan string, field string, old_num double, new_num double, old_text string, new_text string, "
    "confidence double, publishable boolean, detected_at timestamp",
    "snapshots": "slug string, day date, text string, hash string",
    "spend": "month string, usd double",
}


def registry(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as text:
        return vendors_from_yaml(spark, text.read())


def chosen(vendors: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Vendors that are asked for by name, or else those that are due."""
    if args.only:
        return gate.only_vendors(vendors, args.only)
    return gate.due_vendors(vendors.withColumn("tier", F.col("crawl_tier")), F.lit(args.day).cast("date"), args.all).drop("tier")


def fetch(spark: SparkSession, args: argparse.Namespace) -> int:
    """Pages of the due vendors, and of where they moved to, as the table that ``run`` reads."""
    web = fetching.web_fetcher()
    vendors = chosen(registry(spark, args.registry), args).where("pricing_url IS NOT NULL").select("slug", F.col("pricing_url").alias("url"))
    # Dense places, since the budget of a run is summed by blocks of them.
    vendors = places(vendors, ["slug"], name="pos")
    host = T.host_of(F.col("url"))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    asked = vendors.select(F.concat(root, F.lit("/robots.txt")).alias("url")).distinct()
    robots = fetching.fetch_pages(asked.withColumn("allowed", F.lit(True)), web, args.delay, retries=0).select(host.alias("host"), F.col("html").alias("text"))
    allow = lambda urls: allowed_by_robots(urls, robots.where("text IS NOT NULL"))
    judged = allow(vendors.withColumn("host", host))
    pages = fetching.fetch_pages(judged, web, args.delay)
    by_robots = F.col("status").isNull()
    lost = pages.where(gate.worth_recovering(F.coalesce("status", F.lit(-1)), by_robots))
    moved = find_moved_pages(lost.select("url"), web, allow, args.delay).where("found IS NOT NULL")
    again = fetching.fetch_pages(moved.select(F.col("found").alias("url"), F.lit(True).alias("allowed")), web, args.delay).select(F.col("url").alias("found"), "status", "html")
    new = moved.join(again, "found").select("url", "found", F.col("status").alias("_status"), F.col("html").alias("_html"))
    known = vendors.join(pages, "url").join(new, "url", "left")
    table = known.select(
        "slug", "pos", F.coalesce("found", "url").alias("url"), F.coalesce("_status", "status", F.lit(0)).alias("status"),
        by_robots.alias("blocked"), F.coalesce("_html", "html").alias("html"), F.col("found").alias("moved_to"),
    )
    table.write.mode("overwrite").parquet(args.pages)
    # The registry is a file that people edit; what moved is a part of it.
    found = [(r["url"], r["found"]) for r in moved.select("url", "found").collect()]
    if found and args.fix_urls:
        with open(args.registry, encoding="utf-8") as text:
            patched = patched_registry(text.read(), found)
        with open(args.registry, "w", encoding="utf-8") as text:
            text.write(patched)
    print(f"{spark.read.parquet(args.pages).count()} pages, {len(found)} moved" + (", registry updated" if found and args.fix_urls else ""))
    return 0


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    pages = spark.read.parquet(args.pages)
    if args.registry:
        pages = pages.join(chosen(registry(spark, args.registry), args).select("slug"), "slug", "left_semi")
    elif args.only:
        pages = pages.where(F.col("slug").isin(args.only))
    now = RunStore(spark, args.folder).begin(args.day)
    state, baseline, pending = (now.read(n, TABLES[n]) for n in ("state", "baseline", "pending"))
    result = ingest(pages, state, baseline, pending, args.day, args.budget, force=args.force)
    if not args.dry_run:
        now.append("changes", result.changes.withColumn("detected_at", F.lit(args.day).cast("timestamp")))
        now.append("snapshots", result.snapshots)
        now.put("state", state_after(state, result, args.day))
        now.put("baseline", result.confirmed)
        now.put("pending", result.pending)
        now.put("spend", add_spend(now.read("spend", TABLES["spend"]), result.spend))
        now.commit()
    stats = result.counters().first()
    print(", ".join(f"{k.replace('_', ' ')} {v}" for k, v in stats.asDict().items()))
    failed = stats["failed"] + stats["skipped_robots"]
    return int(stats["checked"] > 0 and failed / stats["checked"] > gate.FAILURE_ALARM)


def published(spark: SparkSession, folder: str) -> DataFrame:
    return RunStore(spark, folder).read("changes", TABLES["changes"]).where("publishable")


def publish(spark: SparkSession, args: argparse.Namespace) -> int:
    store = RunStore(spark, args.folder)
    tables = {n: store.read(n, TABLES[n]) for n in TABLES}
    vendors = registry(spark, args.registry)
    manifest = publish_site(SiteTables(vendors, tables["baseline"], published(spark, args.folder), tables["snapshots"], tables["state"]), args.site, args.day, args.base, args.title)
    print(f"{manifest['files']} files, {manifest['bytes']} bytes")
    return 0


def digest(spark: SparkSession, args: argparse.Namespace) -> int:
    recent = reports.recent(published(spark, args.folder), F.lit(args.day).cast("timestamp"), args.days)
    if args.registry:
        categories = registry(spark, args.registry).select(F.col("slug").alias("vendor"), "category")
    else:
        categories = spark.createDataFrame([], "vendor string, category string")
    print(digest_markdown(reports.digest_by_category(recent, categories), args.days))
    return 0


def review(spark: SparkSession, args: argparse.Namespace) -> int:
    changes = RunStore(spark, args.folder).read("changes", TABLES["changes"])
    reports.review_queue(changes, ["vendor", "key", "change_type"], args.top).orderBy("rank").show(args.top, truncate=False)
    return 0


def advise(spark: SparkSession, args: argparse.Namespace) -> int:
    store = RunStore(spark, args.folder)
    state, snapshots, changes = (store.read(n, TABLES[n]) for n in ("state", "snapshots", "changes"))
    day = F.lit(args.day).cast("date")
    late = site.health({"state": state}, [site.failing(reports.FAILING)]).agg(F.count("*").alias("problems"))
    told = reports.summarise(
        state.agg(F.max("last_checked").alias("last")).join(late, how="cross"), snapshots, changes.where("publishable"), day,
        F.lit(not args.site_down), F.coalesce(F.date_diff(day, F.col("last")) > 1, F.lit(True)), F.col("problems"),
    ).first()
    print(f"{told['advice']} ({told['days']} days recorded, {told['milestone']})")
    return 0


def diagnose(spark: SparkSession, args: argparse.Namespace) -> int:
    page = clean_pages(spark.read.parquet(args.pages).where(F.col("slug") == args.slug))
    raw = T.markup_prices(F.col("html"))
    verdict = reports.diagnose(
        T.looks_like_pricing_page(F.col("text")), F.col("status"), F.size(raw), F.size(T.markup_prices(F.col("text"))), F.length("html"),
        F.exists(F.slice(raw, 1, 4), lambda s: s.rlike('[{}":]')),
    )
    rows = page.select(verdict.alias("v"), "html", "text").limit(1).collect()
    if rows and args.out:
        for name, content in (("raw.html", rows[0]["html"]), ("cleaned.txt", rows[0]["text"])):
            put_text(spark, f"{args.out}/{args.slug}-{name}", content or "", replace=True)
    print(rows[0]["v"] if rows else f"no page of {args.slug}")
    return int(not rows)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    made = {}
    for function in (fetch, run, publish, digest, review, advise, diagnose):
        made[function.__name__] = p = commands.add_parser(function.__name__)
        p.set_defaults(function=function)
        p.add_argument("folder")
    for name, needed in (("fetch", True), ("run", False), ("publish", True), ("digest", False)):
        made[name].add_argument("--registry", required=needed)
    for name in ("fetch", "run", "publish", "digest", "advise"):
        made[name].add_argument("--day", required=True)
    for name in ("fetch", "run", "diagnose"):
        made[name].add_argument("--pages", required=True)
    for name in ("fetch", "run"):
        made[name].add_argument("--all", action="store_true")
        made[name].add_argument("--only", nargs="*", default=[])
    made["fetch"].add_argument("--fix-urls", action="store_true")
    made["fetch"].add_argument("--delay", type=float, default=fetching.CRAWL_DELAY)
    made["run"].add_argument("--budget", type=float, default=gate.RUN_BUDGET_USD)
    made["run"].add_argument("--force", action="store_true")
    made["run"].add_argument("--dry-run", action="store_true")
    made["publish"].add_argument("--site", required=True)
    made["publish"].add_argument("--base", default="https://example.com")
    made["publish"].add_argument("--title", default="Price archive")
    made["digest"].add_argument("--days", type=int, default=7)
    made["review"].add_argument("--top", type=int, default=50)
    made["advise"].add_argument("--site-down", action="store_true")
    made["diagnose"].add_argument("--out")
    made["diagnose"].add_argument("slug")
    args = parser.parse_args(argv)
    return args.function(session(), args)


if __name__ == "__main__":
    sys.exit(main())
