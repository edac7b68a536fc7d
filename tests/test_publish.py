"""Pages of long lists, odd names and made-up data."""

import os
import re
from xml.dom.minidom import parseString

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark.plans import publish
from tidemark.plans.publish import SiteTables, site_pages
from tidemark.sources import registry
from tidemark.sources.registry import VENDOR_SCHEMA


@pytest.fixture
def tables(spark):
    walk = registry.made_up_walk(spark.createDataFrame([(f"v{i}", i * 7) for i in range(8)], "slug string, number long"), 30)
    records = registry.walk_records(walk).where("n = 29").select("slug", "record", "demo")
    empty = records.where("slug = 'v0'").select(F.lit("nothing").alias("slug"), F.col("record").withField("plans", F.filter("record.plans", lambda p: F.lit(False))).alias("record"), "demo")
    vendors = [(f'<b>"N{i}" & co', f"v{i}", ("crm", "e mail", None)[i % 3], "daily", None) for i in range(7)]  # v7 is in no registry
    said = registry.walk_changes(walk).withColumns({"vendor": F.col("slug"), "plan": F.col("key"), "detected_at": F.col("day").cast("timestamp"), "confidence": F.lit(0.9), "publishable": F.lit(True)})
    return SiteTables(
        spark.createDataFrame(vendors, VENDOR_SCHEMA),
        records.unionByName(empty),
        said.select("vendor", "key", "change_type", "plan", "field", "old_num", "new_num", "old_text", "new_text", "confidence", "publishable", "detected_at"),
        registry.walk_snapshots(walk).select("slug", "day", "text", F.lit("").alias("hash")),
        spark.createDataFrame([("v0", "ok", "h", None, 0, 0), ("v1", "error", "h", None, 3, 1)], cli.STATE),
    )


def test_long_lists_are_cut_and_names_are_escaped(spark, tables, monkeypatch):
    monkeypatch.setattr(publish, "PAGE_ROWS", 3)
    monkeypatch.setattr(publish, "SITEMAP_PART", 4)
    rows = {r.path: r for r in site_pages(tables, "2024-01-30", "https://x.test/", "Prices").collect()}
    assert {p for p in rows if "/" not in p} == {"index.html", "index-2.html", "index-3.html", "changes.html", "week.html", "status.html"}
    assert {p for p in rows if p.startswith("vendor/")} == {f"vendor/v{i}.html" for i in range(8)}
    assert {p for p in rows if p.startswith("category/")} == {"category/crm.html", "category/e-mail.html", "category/uncategorised.html"}
    # v0, v3 and v6 are of one category, v1 and v4 of another, v2, v5 and v7 of none.
    assert {p for p in rows if p.startswith("compare/")} == {f"compare/v{a}-vs-v{b}.html" for a, b in ((0, 3), (0, 6), (3, 6), (1, 4), (2, 5), (2, 7), (5, 7))}
    for path, row in rows.items():
        assert "noindex" in row.content and "made up" in row.content and "<b>" not in row.content and "N1\" &" not in row.content
        for href in re.findall(r'<a href="([^"]*)"', row.content):
            assert os.path.normpath(os.path.join(os.path.dirname(path), href)) in rows, (path, href)
    listed = [re.findall(r'href="vendor/(v\d).html"', rows[p].content) for p in ("index.html", "index-2.html", "index-3.html")]
    assert [len(x) for x in listed] == [3, 3, 2] and len({v for x in listed for v in x}) == 8
    assert "V7 pricing" in rows["vendor/v7.html"].content and "8 vendors" in rows["index.html"].content
    newest = tables.changes.groupBy("vendor").agg(F.to_date(F.max("detected_at")).alias("d")).collect()
    assert all(rows[f"vendor/{r.vendor}.html"].lastmod == r.d for r in newest)
    made = publish._Site(tables, "2024-01-30", "https://x.test", "Prices")
    parts = {r.path: r.content for r in made.sitemap(spark.createDataFrame([(p, r.lastmod) for p, r in rows.items()], "path string, lastmod date")).collect()}
    found = [len(parseString(c).getElementsByTagName("url")) for p, c in parts.items() if p != "sitemap.xml"]
    assert sum(found) == len(rows) and max(found) == 4
    assert len(parseString(parts["sitemap.xml"]).getElementsByTagName("sitemap")) == len(found) == len(parts) - 1
