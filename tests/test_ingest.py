"""Runs day by day: gates, confirmation, routing and what is rendered from them."""

from xml.dom.minidom import parseString

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators.extract import extract_records, pattern_extractor
from tidemark.operators.records import RECORD
from tidemark.plans import render
from tidemark.plans.ingest import ingest

PAGES = "slug string, pos int, url string, status int, blocked boolean, html string"


def html(price, stamp="2024-01-01 10:00", extra=""):
    filler = "".join(f"<p>Reason {i}: a subscription is billed by the month and can be left at any time.</p>" for i in range(3))
    return f"<main><h1>Pricing</h1><h2>Starter</h2><p>$12 per month</p><h2>Pro</h2><p>${price} per month</p><p>25 seats</p><p>at {stamp}</p>{extra}{filler}</main>"


def pages(spark, *rows):
    full = [(slug, i, f"https://{slug}.test/pricing", status, status == 0, text) for i, (slug, status, text) in enumerate(rows)]
    return spark.createDataFrame(full, PAGES)


def empty(spark):
    return spark.createDataFrame([], "slug string, hash string"), *(spark.createDataFrame([], f"slug string, record {RECORD}") for _ in range(2))


def test_extractor_reads_plans_and_limits(spark):
    (row,) = extract_records(spark.createDataFrame([("Starter\n$12 per month\nPro\n$1,049.5 per seat\nunlimited users\nSupport\nfree",)], "text string")).collect()
    plans = {p["key"]: p for p in row["record"]["plans"]}
    assert plans["starter"]["monthly_price"] == 12 and plans["pro"]["monthly_price"] == 1049.5 and plans["pro"]["is_per_seat"]
    assert plans["free"]["monthly_price"] == 0 and [tuple(x) for x in plans["pro"]["limits"]] == [("users", -1.0, None)]
    assert plans["pro"]["features"] == ["support"] and pattern_extractor(["no price"]) == [None]


def test_a_change_is_confirmed_by_the_second_reading(spark):
    state, base, held = empty(spark)
    outcomes, changes = [], []
    days = [html(49), html(49, "2024-01-02 11:11"), html(59), html(59), html(59)]
    for n, text in enumerate(days):
        out = ingest(pages(spark, ("a", 200, text)), state, base, held, f"2024-01-0{n + 1}")
        (row,) = out.outcomes.collect()
        outcomes.append((row["status"], out.pending.count()))
        changes.append([(r["change_type"], r["old_num"], r["new_num"], r["publishable"]) for r in out.changes.collect()])
        base, held = (spark.createDataFrame(f.collect(), f.schema) for f in (out.confirmed, out.pending))
        if row["status"] in ("ok", "same"):
            state = spark.createDataFrame([("a", row["hash"])], "slug string, hash string")
    assert outcomes == [("ok", 0), ("same", 0), ("ok", 1), ("ok", 0), ("same", 0)]
    assert changes == [[], [], [], [("price_increase", 49.0, 59.0, True)], []]


def test_gates_and_budget(spark, tmp_path):
    state, base, held = empty(spark)
    rows = [("robots", 0, None), ("gone", 404, "x"), ("thin", 200, "<p>hi</p>"), ("a", 200, html(1)), ("b", 200, html(2)), ("c", 200, html(3))]
    log = tmp_path / "calls"

    def counting(texts):
        with log.open("a") as f:
            f.write("x" * len(texts))
        return pattern_extractor(texts)

    out = ingest(pages(spark, *rows), state, base, held, "2024-01-01", budget=0.0099, extractor=counting)
    assert {r["slug"]: r["status"] for r in out.outcomes.collect()} == {
        "robots": "robots_disallowed", "gone": "error", "thin": "not_a_pricing_page", "a": "ok", "b": "ok", "c": "over_budget"
    }
    assert log.read_text() == "xx" and out.confirmed.count() == 2 and out.snapshots.count() == 3


def test_command_line(spark, tmp_path, capsys):
    folder, source = str(tmp_path / "store"), str(tmp_path / "pages")
    for n, price in enumerate((49, 59, 59)):
        pages(spark, ("a", 200, html(price)), ("b", 200, html(5))).write.mode("overwrite").parquet(source)
        assert main(["run", folder, "--pages", source, "--day", f"2024-02-0{n + 1}"]) == 0
    capsys.readouterr()
    assert main(["digest", folder, "--day", "2024-02-04"]) == 0
    assert "uncategorised: 1 changes at 1 vendors" in capsys.readouterr().out
    assert main(["review", folder]) == 0 and main(["diagnose", folder, "--pages", source, "a"]) == 0
    assert capsys.readouterr().out.strip().endswith("ok")
    pages(spark, ("a", 0, None), ("b", 404, None)).write.mode("overwrite").parquet(source)
    assert main(["run", folder, "--pages", source, "--day", "2024-02-05", "--dry-run"]) == 1


def test_rendering_is_safe(spark):
    items = spark.createDataFrame([(1, "a &amp; b", "vendor/1.html?x=1&y", "g<1>")], "rank int, title string, link string, guid string")
    parseString(render.feed_xml(items, "https://x.test/", "t"))
    offers = spark.createDataFrame([("</script><b>&", 1.0, 2.0, 3, "USD")], "name string, low_price double, high_price double, offer_count long, currency string")
    text = render.product_schema(offers, "name", "currency").first()["json_ld"]
    assert "<" not in text and "&" not in text and "\\u003c/script" in text
    row = render.sitemap_rows(spark.createDataFrame([("a&b", "2024-01-01")], "page string, lastmod string"), "https://x.test/").first()
    parseString(row["value"])
    kinds = ["price_increase", "plan_added", "pricing_hidden", "limit_changed"]
    events = spark.createDataFrame([(k, "<Pro>", 1.0, 2.0, None, None, "v") for k in kinds], "change_type string, plan string, old_num double, new_num double, old_text string, new_text string, vendor string")
    said = [r["phrase"] for r in render.change_rows(events.withColumn("detected_at", F.lit("2024-01-02").cast("timestamp"))).collect()]
    assert said == ["&lt;Pro&gt; went up from $1 to $2", "&lt;Pro&gt; is new", "prices are no longer public", "&lt;Pro&gt;: limit changed from $1 to $2"]


@pytest.mark.parametrize("rows, want", [([], "No changes in the last 7 days.\n"), ([("crm", 2, 1)], "# 2 changes in 7 days\n\n- crm: 2 changes at 1 vendors\n")])
def test_digest_text(spark, rows, want):
    assert render.digest_markdown(spark.createDataFrame(rows, "category string, changes int, vendors int"), 7) == want
