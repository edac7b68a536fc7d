"""Page cleaning, text functions, tolerant readers, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import gate, reports
from tidemark.operators.html import clean_pages, page_text
from tidemark.sources import logs, registry, sinks
from tidemark.streaming.confirm import confirm_stream, route_stream
from tidemark.streaming.windows import daily_counts


def page(build="a1b2c3d4" * 4, nonce="x1", teams="12,431", quote="Great!", banner="Sale", at="2024-01-01 10:00", price="49", seats="5"):
    return f"""<html><head><title>t</title><script src="/app.js?v={build}"></script><style>x</style></head><body>
<div class="Cookie-Notice">we use cookies {banner}</div><div id="announcement">{banner}</div><header><nav>Home</nav></header>
<main><h1>Pricing plans</h1><p>Built {at} for {teams} teams nonce-{nonce}<p>build {build}
<ul><li>Free<li>Pro ${price} per month<li>{seats} seats</ul><div aria-hidden="true">chat {quote}</div>
<section class="testimonial-carousel">{quote}</section><div class="crisp-box">Crisp box</div></main>
<footer>{at}</footer><script>track("{nonce}")</script></body></html>"""


def test_noise_does_not_change_the_hash(spark):
    pages = [page(), page("f" * 32, "y+/2=", "99,000", "Meh", "None", "2025-12-31T23:59:59"), page(price="59"), page(seats="6"), page("b" * 40), None]
    df = spark.createDataFrame([(i, "https://acme.test/pricing", p) for i, p in enumerate(pages)], "i int, url string, html string")
    text = {r["i"]: r["text"] for r in clean_pages(df).collect()}
    assert text[0] == text[1] == text[4] and len({text[0], text[2], text[3]}) == 3 and text[5] is None
    assert "Pro $49 per month" in text[0] and "cookies" not in text[0] and "Crisp" not in text[0] and "Great" not in text[0]
    assert "<COUNT> teams" in text[0] and "<TS>" in text[0] and "<HASH>" in text[0] and "<NONCE>" in text[0]


def test_own_brand_stays():
    html = '<div class="crisp-hero">Plans</div>'
    assert page_text(html, "crisp.chat") == "Plans" and page_text(html, "acme.test") == ""


def test_broken_markup():
    assert page_text("<p>a<p>b<br>c</article><li>d<li>e<div>f", None).split("\n") == ["a", "b", "c", "d", "e", "f"]
    assert page_text("<script>x</script><svg/>y<header>n</header>z&amp;", None).split("\n") == ["y", "z&"]
    assert page_text("", None) == ""
    # The end tag of the head is optional, as are those of its neighbours.
    assert page_text("<html><head><title>t</title><body><p>Pro plan $20</p></body></html>", None) == "Pro plan $20"
    assert page_text("<head><title>t</title><meta charset=x><p>Pro<dl><dt>a<dd>b<dt>c</dl>", None).split("\n") == ["Pro", "a", "b", "c"]
    assert page_text("<head><style>x</style> \n Pro plan<b>$20</b>", None).split("\n")[-1] == "$20"
    assert page_text("<head><noscript><p>x<body>y", None) == "y" and page_text("<head><script>x</script></head>z", None) == "z"
    assert page_text("<table><tr><td>a<td>b<tr><th>c</table><select><option>d<option>e</select>", None).split("\n") == list("abcde")


@pytest.mark.parametrize(
    "function, given, want",
    [
        (T.plan_key, "Pro Tier Plan", "pro"),
        (T.plan_key, "Pro Plan Tier", "proplan"),
        (T.plan_key, " Größe+ Edition", "größe"),
        (T.slugify, "  Ünit & Co. ", "nit-co"),
        (T.title_case, "crm-tools", "CRM"),
        (T.title_case, "saas-api-kits", "SaaS API Kits"),
        (T.html_escape, "<a href='x'>\"&amp;", "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;amp;"),
        (T.html_escape, None, ""),
        (T.pretty_date, "2026-08-05T01:02:03", "05 Aug 2026"),
        (T.pretty_date, None, "—"),
        (T.pretty_date, "some other day", "some other"),
        (T.host_of, "https://u@a.test:8/x", "u@a.test:8"),
        (T.mask_volatile, "12,431 teams", "<COUNT> teams"),
        (T.mask_volatile, "id 123e4567-e89b-12d3-a456-426614174000.", "id <UUID>."),
        (T.normalize_lines, " a​ b \n\n a b\n \nc ", "a b\nc"),
    ],
)
def test_text_functions(spark, function, given, want):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(function(F.col("x"))).first()[0] == want


def test_money(spark):
    rows = [("USD", 1234.5), ("GBP", 10.0), ("SEK", 1200.0), (None, 0.1), ("EUR", None), ("JPYEN", 100.0)]
    df = spark.createDataFrame(rows, "c string, v double")
    assert [r[0] for r in df.select(T.money(F.col("c"), F.col("v"))).collect()] == ["$1,234.5", "£10", "1,200 SEK", "0.1", "—", "100 JPY"]


LOG = '{"vendor":"a","old_value":1,"new_value":2.5,"confidence":0.9,"detected_at":"2024-01-02T03:04:05","note":"x y"}\n{"vendor":\nnot json\n[1]\n\n{"vendor":"b","old_value":"EUR","new_value":true}\n'


def test_damaged_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(LOG)
    rows = {r["vendor"]: r for r in logs.read_changes(spark, str(tmp_path / "log.jsonl")).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["old_num"], rows["a"]["new_num"], rows["a"]["note"]) == (1.0, 2.5, "x y")
    assert rows["b"]["old_num"] is None and rows["b"]["detected_at"] is None


def test_records_snapshots_and_state(spark, tmp_path):
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans/ok.json").write_text('{"currency":\n"USD"}')
    (tmp_path / "plans/bad.json").write_text('{"currency"')
    got = {r["slug"]: (r["readable"], r["record"]) for r in logs.read_records(spark, str(tmp_path / "plans"), "struct<currency:string>").collect()}
    assert got["ok"][0] and got["ok"][1]["currency"] == "USD" and got["bad"] == (False, None)
    for slug, day in (("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "notes")):
        (tmp_path / "snaps" / slug).mkdir(parents=True, exist_ok=True)
        (tmp_path / "snaps" / slug / f"{day}.txt").write_text(day)
    assert sorted((r["slug"], str(r["day"])) for r in logs.read_snapshots(spark, str(tmp_path / "snaps")).collect()) == [("a", "2024-01-01"), ("a", "2024-01-02")]
    (tmp_path / "spend.json").write_text('{"2024-01": 0.5, "2024-02": 1}')
    (tmp_path / "broken.json").write_text('{"2024-01"')
    assert sorted(map(tuple, logs.read_map(spark, str(tmp_path / "spend.json"), "double").collect())) == [("2024-01", 0.5), ("2024-02", 1.0)]
    assert logs.read_map(spark, str(tmp_path / "broken.json"), "double").count() == 0


def test_registry(spark):
    text = "vendors:\n- {name: Acme Co, pricing_url: 'https://a.test/p'}\n- {name: B, slug: bee, category: crm, crawl_tier: weekly}\n"
    rows = [(r["slug"], r["category"], r["crawl_tier"]) for r in registry.vendors_from_yaml(spark, text).orderBy("name").collect()]
    assert rows == [("acme-co", "uncategorised", "daily"), ("bee", "crm", "weekly")]
    assert registry.vendors_from_yaml(spark, "").count() == 0


def test_addresses_and_robots(spark):
    html = '<a href="/our-pricing">p</a><a href="https://b.test/pricing">q</a>'
    found = registry.address_candidates(spark.createDataFrame([("https://a.test/p", html)], "url string, html string"))
    listed = [r["candidate"] for r in found.orderBy("place").collect()]
    assert listed[:2] == ["https://a.test/p/", "https://a.test/pricing"] and listed[-1] == "https://a.test/our-pricing"
    pages = spark.createDataFrame([("https://a.test/plans", "x" * 501), ("https://a.test/pricing", "short")], "candidate string, html string")
    assert registry.first_reachable(found, pages).first()["found"] == "https://a.test/plans"
    urls = spark.createDataFrame([("https://a.test/x", "a.test"), ("https://a.test/no/x", "a.test"), ("https://b.test/no", "b.test")], "url string, host string")
    robots = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /no")], "host string, text string")
    assert {r["url"]: r["allowed"] for r in registry.allowed_by_robots(urls, robots).collect()} == {
        "https://a.test/x": True, "https://a.test/no/x": False, "https://b.test/no": True
    }


def test_made_up_changes_repeat(spark):
    a, b = (registry.made_up_changes(spark, 5, 8) for _ in range(2))
    assert a.exceptAll(b).isEmpty() and a.count() == 40 and a.where("old_value IS NULL").count() == 5


def test_due_on_mondays(spark):
    v = spark.createDataFrame([("a", "daily"), ("b", "weekly"), ("c", None)], "name string, tier string")
    due = lambda d, **k: sorted(r["name"] for r in gate.due_vendors(v, F.lit(d).cast("date"), **k).collect())
    assert due("2024-01-22") == ["a", "b", "c"] and due("2024-01-23") == ["a", "c"] and due("2024-01-23", force=True) == ["a", "b", "c"]


def test_retention_keeps_firsts_of_months(spark):
    days = spark.sql("SELECT 'a' AS slug, explode(sequence(date'2024-01-01', date'2024-04-30')) AS day")
    gone = reports.prunable_snapshots(days)
    left = sinks.without(days, gone, ["slug", "day"])
    assert left.count() == 63 and left.where("day IN (date'2024-01-01', date'2024-02-01')").count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "slug string, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["slug"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_stream_confirms_across_batches_and_restarts(spark, tmp_path):
    schema = "slug string, seq long, hash string, print string"
    prints = {"a": "xxyyx", "b": "xyxyy", "c": "xyzzz", "d": "x"}
    for day in range(5):
        rows = [(s, day, p[day], p[day]) for s, p in prints.items() if day < len(p)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{day}"))

    def run(upto):
        for day in range(upto[0], upto[1]):
            for f in sorted((tmp_path / f"in/{day}").glob("*.parquet")):
                (tmp_path / "all").mkdir(exist_ok=True)
                (tmp_path / "all" / f"{day}-{f.name}").write_bytes(f.read_bytes())
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "all"))
            q = confirm_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            q = q.option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()

    run((0, 3))
    run((3, 5))
    got = spark.read.parquet(str(tmp_path / "out")).where("outcome = 'change'")
    assert sorted((r["slug"], r["seq"], r["old_print"], r["new_print"]) for r in got.collect()) == [("a", 3, "x", "y"), ("b", 4, "x", "y"), ("c", 3, "x", "z")]


def test_routed_stream_writes_each_batch_once(spark, tmp_path):
    rows = [(i, i / 10) for i in range(10)]
    spark.createDataFrame(rows, "event_id int, confidence double").withColumn("publishable", F.col("confidence") >= 0.8).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, confidence double, publishable boolean").parquet(str(tmp_path / "in"))
    for _ in range(2):
        route_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    for _ in range(2):
        sinks.append_changes(out.drop("batch"), str(tmp_path / "out2"), 0)
    again = spark.read.parquet(str(tmp_path / "out2"))
    assert out.count() == again.count() == 10 and again.where("publishable = 'true'").count() == 2


def test_windows_on_a_stream_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for n, days in enumerate((["2024-01-01", "2024-01-02"], ["2024-01-09"], ["2024-01-01"])):
        rows = spark.createDataFrame([(d, "e", 1.25) for d in days], "d string, event_type string, value double")
        rows.select(F.to_timestamp("d").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = daily_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {str(r["day"])[:10]: (r["n"], r["cents"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": (1, 125), "2024-01-02": (1, 125)}
