"""The site as rows of (path, lastmod, content), and their way into files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import html_escape, money, pretty_date, relative_prefix, slugify, title_case
from tidemark.operators import benchmarks, history, reports, site
from tidemark.operators.ranks import places
from tidemark.operators.records import aggregate_offer
from tidemark.plans import render
from tidemark.session import reliable_checkpoint
from tidemark.sources.site_files import write_site

#: Rows of a page of a long list, changes that a page shows, and addresses of a part of the sitemap.
PAGE_ROWS, SHOWN_CHANGES, SITEMAP_PART = 500, 100, 40_000


@dataclass(frozen=True)
class SiteTables:
    """What is published: the registry, confirmed records (with ``demo``, if any are made up), published
    changes, stored snapshots and the state of each page."""

    vendors: DataFrame
    records: DataFrame
    changes: DataFrame
    snapshots: DataFrame
    state: DataFrame


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _row(*cells: Column) -> Column:
    return _text("<tr>", *(x for c in cells for x in ("<td>", c, "</td>")), "</tr>")


def _table(heads: list[str], rows: Column) -> Column:
    return _text("<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr></thead><tbody>", rows, "</tbody></table>")


def _joined(rows: Column) -> Column:
    """The html of (place, html) structs, in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["html"]), "")


def _link(path: Column, text: Column) -> Column:
    return _text('<a href="', html_escape(path), '">', html_escape(text), "</a>")


def page(path: Column, title: Column, description: Column, body: Column, made_up: Column, head: Column | None = None) -> Column:
    """A whole page. One with made-up prices says so and asks not to be indexed."""
    warned = F.when(made_up, "<p class=\"sample\">Sample data: every price here is made up.</p>").otherwise("")
    return _text(
        '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>', html_escape(title), '</title><meta name="description" content="', html_escape(description), '">',
        F.when(made_up, '<meta name="robots" content="noindex">').otherwise(""), head if head is not None else "", "</head><body>", warned,
        '<nav><a href="', relative_prefix(path), 'index.html">All prices</a></nav>', body, "</body></html>",
    )


def paged(rows: DataFrame, within: list[str], order: list, size: int) -> DataFrame:
    """(within..., number, pages, rows): the ``html`` of ``rows`` in order, cut into pages of ``size``.

    Rows are placed by ranges, so a list of any length is cut without one task seeing all of it.
    """
    placed = places(rows, order, within or None)
    cut = placed.withColumn("number", F.floor((F.col("place") - 1) / size).cast("int") + 1)
    out = cut.groupBy(*within, "number").agg(_joined(F.collect_list(F.struct("place", "html"))).alias("rows"))
    counts = out.groupBy(*within).agg(F.max("number").alias("pages")) if within else out.agg(F.max("number").alias("pages"))
    return out.join(counts, within) if within else out.join(counts, how="cross")


def _paths(name: Column) -> tuple[Column, Column]:
    """The address of a page of a list, and links to the pages beside it."""
    at = lambda n: _text(name, F.when(n > 1, _text("-", n)).otherwise(""), ".html")
    base = lambda n: F.element_at(F.split(at(n), "/"), -1)
    number, pages = F.col("number"), F.col("pages")
    links = _text(
        F.when(number > 1, _text("<p>", _link(base(number - 1), F.lit("Previous")), "</p>")).otherwise(""),
        F.when(number < pages, _text("<p>", _link(base(number + 1), F.lit("Next")), "</p>")).otherwise(""),
    )
    return at(number), links


class _Site:
    """The frames that pages are made of, each made once."""

    def __init__(self, tables: SiteTables, day: str, base: str, title: str):
        self.tables, self.day, self.base, self.title = tables, F.lit(day).cast("date"), base, title
        self.spark = tables.records.sparkSession
        records = tables.records.where(F.size("record.plans") > 0)
        demo = F.coalesce("demo", F.lit(False)) if "demo" in records.columns else F.lit(False)
        self.made_up = F.lit(bool(records.agg(F.bool_or(demo)).first()[0]))
        exploded = records.select("slug", F.col("record.currency").alias("currency"), F.posexplode("record.plans").alias("pos", "p"))
        self.plans = reliable_checkpoint(exploded.select("slug", "currency", "pos", "p.*"))
        known = records.select("slug").join(tables.vendors.select("slug", "name", "category", "crawl_tier"), "slug", "left")
        known = known.select(
            "slug", F.coalesce("name", title_case(F.col("slug"))).alias("name"), F.coalesce("category", F.lit("uncategorised")).alias("category"),
            F.coalesce("crawl_tier", F.lit("weekly")).alias("tier"), F.col("slug").alias("vendor"),
        )
        heads = self.plans.groupBy(F.col("slug").alias("vendor")).agg(F.first("currency").alias("currency"), F.struct(*site.head_columns()).alias("head"))
        latest = tables.changes.groupBy("vendor").agg(F.to_date(F.max("detected_at")).alias("latest"))
        heads = site.vendor_heads(known, heads, tables.changes).join(latest, "vendor", "left")
        self.heads = reliable_checkpoint(heads)
        self.since = tables.snapshots.agg(F.coalesce(F.min("day"), self.day).alias("since")).first()["since"]
        self.currencies = self.heads.select("vendor", "currency")

    def lastmod(self, latest: Column) -> Column:
        return F.coalesce(latest, F.lit(self.since).cast("date")).cast("date").alias("lastmod")

    def change_items(self, changes: DataFrame) -> DataFrame:
        """``changes`` with ``html``, an item of a list."""
        said = render.change_rows(changes, self.currencies, more=("event_id",))
        return said.withColumn("html", _text("<li>", F.col("day"), " ", _link(_text("vendor/", F.col("vendor"), ".html"), F.col("vendor")), ": ", F.col("phrase"), "</li>"))

    def pairs(self) -> DataFrame:
        changed = self.heads.where("changes > 0").select("vendor")
        return benchmarks.comparison_pairs(site.compare_cells(self.heads), changed)

    def vendor_pages(self) -> DataFrame:
        # Of equal metrics the last one counts.
        last = F.filter("limits", lambda x, i: ~F.exists(F.slice("limits", i + 2, F.size("limits")), lambda y: y["metric"] == x["metric"]))
        limits = F.map_from_entries(F.transform(last, lambda x: F.struct(x["metric"].alias("key"), x["value"].alias("value"))))
        shown = site.vendor_page(self.plans.withColumns({"vendor": F.col("slug"), "limits": limits}), ["currency", "pos"])
        price = F.when(F.col("shown") == "contact", "Contact sales").when(F.col("shown") == "free", "Free").otherwise(money(F.col("currency"), F.col("price")))
        cells = shown.select("vendor", "addon", "pos", _row(html_escape(F.col("name")), price, F.col("billing"), html_escape(F.col("limits"))).alias("html"))
        one = lambda addon: _joined(F.collect_list(F.when(F.col("addon") == addon, F.struct("pos", "html"))))
        tables = cells.groupBy("vendor").agg(one(False).alias("rows"), one(True).alias("extras"))
        line = Window.partitionBy("vendor").orderBy(F.desc("detected_at"), F.desc("event_id"))
        newest = self.changes_numbered().withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= SHOWN_CHANGES)
        said = render.change_rows(newest.withColumn("event_id", F.col("_r")), self.currencies, more=("event_id",))
        said = said.withColumn("html", _text("<li>", F.col("day"), ": ", F.col("phrase"), "</li>"))
        log = said.groupBy("vendor").agg(_joined(F.collect_list(F.struct(F.col("event_id").alias("place"), "html"))).alias("log"))
        offers = aggregate_offer(self.plans, ["slug"]).withColumnRenamed("slug", "vendor").join(self.heads.select("vendor", "name", "currency"), "vendor")
        offers = render.product_schema(offers, "name", "currency").select("vendor", F.col("json_ld"))
        counted = site.versions(self.heads, self.tables.snapshots.select(F.col("slug").alias("vendor")), "vendor")
        # The first eight comparisons of each side.
        pairs = self.pairs().select("pair", "name_a", "name_b", F.explode(F.array("vendor_a", "vendor_b")).alias("vendor"))
        beside = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("vendor").orderBy("pair"))).where("_r <= 8")
        link = _link(_text("../compare/", F.col("pair"), ".html"), _text(F.col("name_a"), " vs ", F.col("name_b")))
        beside = beside.groupBy("vendor").agg(_joined(F.collect_list(F.struct(F.col("_r").alias("place"), _text("<li>", link, "</li>").alias("html")))).alias("beside"))
        joined = self.heads.join(tables, "vendor")
        for extra in (log, offers, counted, beside):
            joined = joined.join(extra, "vendor", "left")
        path, names = _text("vendor/", F.col("slug"), ".html"), ["Plan", "Price", "Billing", "Limits"]
        part = lambda c, title, html: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, _text(f"<h2>{title}</h2>", html)).otherwise("")
        body = _text(
            "<h1>", html_escape(F.col("name")), " pricing</h1><p>", html_escape(title_case(F.col("category"))), "</p>", _table(names, F.col("rows")),
            part(F.col("extras"), "Add-ons", _table(names, F.col("extras"))), "<p>", F.col("versions"), " recorded versions, ", F.col("changes"), " changes.</p>",
            part(F.col("log"), "Changes", _text("<ul>", F.col("log"), "</ul>")), part(F.col("beside"), "Compare", _text("<ul>", F.col("beside"), "</ul>")),
        )
        entry = F.when(F.col("entry_price").isNull(), "").otherwise(_text(" from ", money(F.col("currency"), F.col("entry_price"))))
        head = F.when(F.col("json_ld").isNotNull(), _text('<script type="application/ld+json">', F.col("json_ld"), "</script>")).otherwise("")
        title = _text(F.col("name"), " pricing")
        return joined.select(path.alias("path"), self.lastmod(F.col("latest")), page(path, title, _text(title, entry), body, self.made_up, head).alias("content"))

    def changes_numbered(self) -> DataFrame:
        """Changes with a number that follows from what they say, so that reruns agree on their order."""
        return self.tables.changes.withColumn("event_id", F.xxhash64("vendor", "change_type", "key", "field", F.col("detected_at").cast("string"), "old_text", "new_text"))

    def category_pages(self) -> DataFrame:
        facts = benchmarks.category_benchmark(self.heads).select("category", F.col("currency").alias("c"), "median_entry", "vendors", "pct_free", "excluded")
        latest = self.heads.groupBy("category").agg(F.max("latest").alias("latest"))
        cells = _row(
            _link(_text("../vendor/", F.col("slug"), ".html"), F.col("name")), money(F.col("currency"), F.col("entry_price")), money(F.col("currency"), F.col("top_price")),
            F.when(F.col("has_free"), "yes").otherwise("no"), F.when(F.col("per_seat"), "per seat").otherwise("flat"), F.col("changes"),
        )
        rows = paged(self.heads.select("category", "name", "slug", cells.alias("html")), ["category"], ["name", "slug"], PAGE_ROWS)
        path, links = _paths(_text("category/", slugify(F.col("category"))))
        joined = rows.join(facts, "category").join(latest, "category")
        left_out = F.when(F.col("excluded") > 0, _text(" (", F.col("excluded"), " in other currencies left out)")).otherwise("")
        body = _text(
            "<h1>", html_escape(title_case(F.col("category"))), " pricing</h1><p>", F.col("vendors"), " vendors, median entry ", money(F.col("c"), F.col("median_entry")), left_out,
            ", ", F.round("pct_free").cast("int"), "% with a free plan</p>", _table(["Vendor", "Entry", "Top", "Free plan", "Billing", "Changes"], F.col("rows")), links,
        )
        title = _text(title_case(F.col("category")), " pricing")
        return joined.select(path.alias("path"), self.lastmod(F.col("latest")), page(path, title, title, body, self.made_up).alias("content"))

    def compare_pages(self) -> DataFrame:
        pairs = reliable_checkpoint(benchmarks.compare_facts(self.pairs()))
        cells = site.compare_table(pairs).withColumn("html", _row(F.col("label"), html_escape(F.col("first")), html_escape(F.col("second"))))
        cells = cells.groupBy("pair").agg(_joined(F.collect_list(F.struct("place", "html"))).alias("rows"))
        side = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
        said = benchmarks.verdict(*side("name"), *side("entry_price"), *side("currency"))
        facts = F.array_join(F.transform("facts", lambda f: _text("<li>", html_escape(f), "</li>")), "")
        path = _text("compare/", F.col("pair"), ".html")
        link = lambda s: _link(_text("../vendor/", F.col(f"slug_{s}"), ".html"), F.col(f"name_{s}"))
        title = _text(F.col("name_a"), " vs ", F.col("name_b"))
        body = _text("<h1>", html_escape(title), "</h1><p>", html_escape(said), "</p>", _table(["", "First", "Second"], F.col("rows")), "<ul>", facts, "</ul><p>", link("a"), ", ", link("b"), "</p>")
        return pairs.join(cells, "pair").select(path.alias("path"), self.lastmod(F.greatest("latest_a", "latest_b")), page(path, title, title, body, self.made_up).alias("content"))

    def index_pages(self) -> DataFrame:
        shown = render.index_rows(self.heads, ["slug"])
        cells = _row(_link(_text("vendor/", F.col("slug"), ".html"), F.col("name")), html_escape(title_case(F.col("category"))), *(F.col(c) for c in ("entry", "top", "free_tier", "billing")))
        rows = paged(shown.select("category", "name", "slug", cells.alias("html")), [], ["category", "name", "slug"], PAGE_ROWS)
        totals = reports.grand_totals(self.heads, self.plans, self.tables.changes, F.lit(self.since).cast("date"))
        totals = totals.crossJoin(self.heads.agg(F.max("latest").alias("latest")))  # one row each
        path, links = _paths(F.lit("index"))
        about = F.col("json_ld")
        joined = render.dataset_schema(totals, self.title, self.base).join(rows, how="cross")  # totals are one row
        head = _text('<script type="application/ld+json">', render.site_schema(self.title, self.base, self.title), '</script><script type="application/ld+json">', about, "</script>")
        body = _text(
            "<h1>", html_escape(F.lit(self.title)), "</h1><p>", F.col("vendors"), " vendors, ", F.col("plans"), " plans, ", F.col("changes"), " changes since ",
            pretty_date(F.col("since").cast("string")), "</p>", _table(["Vendor", "Category", "Entry", "Top", "Free plan", "Billing"], F.col("rows")), links,
        )
        title = F.lit(self.title)
        return joined.select(path.alias("path"), self.lastmod(F.col("latest")), page(path, title, title, body, self.made_up, head).alias("content"))

    def list_page(self, name: str, title: str, items: DataFrame, note: Column | str, latest: Column | None = None) -> DataFrame:
        """One page of a bounded list of (place, html)."""
        listed = items.agg(_joined(F.collect_list(F.struct("place", "html"))).alias("rows"))
        path = F.lit(f"{name}.html")
        body = _text(f"<h1>{title}</h1><p>", note if isinstance(note, Column) else F.lit(note), "</p><ul>", F.col("rows"), "</ul>")
        return listed.select(path.alias("path"), self.lastmod(latest if latest is not None else self.day), page(path, F.lit(title), F.lit(title), body, self.made_up).alias("content"))

    def bounded_pages(self) -> DataFrame:
        numbered = self.changes_numbered()
        newest = history.newest_first(numbered, SHOWN_CHANGES)
        items = lambda rows: self.change_items(rows.withColumn("event_id", F.col("rank"))).select(F.col("event_id").alias("place"), "html")
        week = reports.recent(numbered, self.day.cast("timestamp"), 7)
        by_category = reports.digest_by_category(week, self.heads.select("vendor", "category"))
        digest = by_category.select(F.col("category").alias("place"), _text("<li>", html_escape(title_case(F.col("category"))), ": ", F.col("changes"), " changes at ", F.col("vendors"), " vendors</li>").alias("html"))
        failing = reports.failing_vendors(self.tables.state).orderBy("slug").limit(PAGE_ROWS)
        failing = failing.select(F.col("slug").alias("place"), _text("<li>", html_escape(F.col("slug")), ": ", F.col("reason"), "</li>").alias("html"))
        counts = reports.status_rollup(self.tables.state, self.tables.changes, self.tables.snapshots, self.day).first()
        said = f"{counts['ok']} of {counts['vendors']} pages read, {counts['failing']} failing, {counts['stale']} stale: {counts['health']}."
        return reduce(DataFrame.unionByName, (
            self.list_page("changes", "Every recorded change", items(newest), f"The newest {SHOWN_CHANGES} changes.", F.lit(self.newest_day())),
            self.list_page("week", "This week", digest, "Changes of the last seven days."),
            self.list_page("status", "Status", failing, said),
        ))

    def newest_day(self):
        return self.heads.agg(F.max("latest")).first()[0]

    def feeds(self) -> DataFrame:
        """The feed, the robots file and the mark that the files are served as they are."""
        feed = render.feed_xml(history.feed_items(self.changes_numbered()), f"{self.base}/", self.title)
        files = [("feed.xml", feed), ("robots.txt", f"User-agent: *\nAllow: /\nSitemap: {self.base}/sitemap.xml\n"), (".nojekyll", "")]
        return self.spark.createDataFrame(files, "path string, content string")

    def sitemap(self, pages: DataFrame) -> DataFrame:
        """The sitemap: an index and parts of bounded size."""
        rows = render.sitemap_rows(pages.select(F.col("path").alias("page"), "lastmod"), f"{self.base}/").withColumnRenamed("value", "html")
        parts = paged(rows, [], ["html"], SITEMAP_PART)
        space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
        kind = '<?xml version="1.0" encoding="utf-8"?>'
        out = parts.select(_text("sitemap-", F.col("number"), ".xml").alias("path"), _text(f"{kind}<urlset {space}>", F.col("rows"), "</urlset>").alias("content"))
        number = F.col("number")
        listed = parts.groupBy().agg(F.max("number").alias("n")).select(F.explode(F.sequence(F.lit(1), "n")).alias("number")).select(
            F.struct(number.alias("place"), _text("<sitemap><loc>", html_escape(F.lit(self.base)), "/sitemap-", number, ".xml</loc></sitemap>").alias("html")).alias("r")
        )
        index = listed.agg(_text(f"{kind}<sitemapindex {space}>", _joined(F.collect_list("r")), "</sitemapindex>").alias("content"))
        return out.unionByName(index.select(F.lit("sitemap.xml").alias("path"), "content"))


def site_pages(tables: SiteTables, day: str, base: str, title: str) -> DataFrame:
    """(path, lastmod, content) of every page: a vendor's (``vendor/``), a category's (``category/``), a comparison's
    (``compare/``), the index, changes, week and status.

    A vendor without plans has no page, and one that the registry lacks is named after its slug. Long lists are cut
    into pages. A page was last changed with the newest change that it shows: a comparison with that of either vendor; where
    there is none, when recording began.
    """
    made = _Site(tables, day, base.rstrip("/"), title)
    return reduce(DataFrame.unionByName, (made.vendor_pages(), made.category_pages(), made.compare_pages(), made.index_pages(), made.bounded_pages()))


def publish_site(tables: SiteTables, folder: str, day: str, base: str, title: str) -> dict:
    """Write the whole site, with feed, sitemap and robots file; returns the manifest."""
    base = base.rstrip("/")
    made = _Site(tables, day, base, title)
    pages = reliable_checkpoint(site_pages(tables, day, base, title))
    files = pages.select("path", "content").unionByName(made.feeds()).unionByName(made.sitemap(pages))
    return write_site(files, folder)
