"""Ranks by ranges, budgets by blocks, replays of a batch, whole texts to extractors."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import benchmarks, gate, reports
from tidemark.operators.extract import extract_records
from tidemark.operators.ranks import places
from tidemark.plans import render
from tidemark.session import remove_folder, shared_folder, stored
from tidemark.sources.logs import text_or_default
from tidemark.sources.registry import made_up_records, made_up_snapshots, patched_registry
from tidemark.sources.sinks import add_spend, append_changes
from tidemark.streaming.confirm import reading_stream


@pytest.mark.parametrize("within", [[], ["g"]])
def test_places_number_rows_of_hot_groups(spark, within):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(9)
    got = {r["id"]: r["place"] for r in places(df, ["v", "id"], within).collect()}
    order = sorted(rows, key=lambda r: (r[1] if within else "", r[2], r[0]))
    want, seen = {}, {}
    for i, g, _ in order:
        seen[g if within else ""] = want[i] = seen.get(g if within else "", 0) + 1
    assert got == want
    assert places(df.limit(0), ["v"], within).count() == 0


def test_upper_median_of_ties_and_nulls(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0), ("b", 7.0), ("c", None)]
    got = benchmarks.upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    assert {r["k"]: r["upper_median"] for r in got.collect()} == {"a": 2.0, "b": 7.0}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_budget_by_blocks(spark, block):
    rows = [(run, pos, (pos * 7 + run) % 5) for run in (1, 2, 3) for pos in range(-4, 40, 2)]
    got = gate.budget_cutoff(spark.createDataFrame(rows, "run int, pos int, cost int"), "run", "pos", "cost", 21, block)
    assert got.columns == ["run", "pos", "cost", "spent"]
    want, spent = [], {}
    for run, pos, cost in rows:
        spent[run] = spent.get(run, 0) + cost
        if spent[run] <= 21:
            want.append((run, pos, cost, spent[run]))
    assert sorted(map(tuple, got.collect())) == want


def test_a_replay_replaces_its_whole_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    both = spark.createDataFrame([(1, True), (2, False)], "event_id int, publishable boolean")
    append_changes(both, path, 7)
    append_changes(both, path, 8)
    append_changes(both.where("publishable"), path, 7)
    kept = spark.read.parquet(path).orderBy("batch", "event_id").select("batch", "event_id").collect()
    assert [tuple(r) for r in kept] == [(7, 1), (8, 1), (8, 2)]


def test_extractors_get_whole_texts(spark):
    lengths = lambda texts: [json.dumps({"extraction_notes": str(len(t)), "plans": []}) for t in texts]
    pages = spark.createDataFrame([("x" * 30_000,)], "text string")
    said = [extract_records(pages, extractor=lengths, max_chars=m).first()["record"]["extraction_notes"] for m in (None, 24_000)]
    assert said == ["30000", "24000"]


def test_words_for_changes_and_milestones(spark):
    rows = [(100.0, 112.34), (100.0, 99.96), (0.0, 5.0), (None, 1.0), (100.0, 100.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(T.percent_text(F.col("a"), F.col("b"))).collect()] == ["+12.3%", "-0.0%", "n/a", "n/a", "+0.0%"]
    days = spark.createDataFrame([(0,), (29,), (400,)], "d int").select(reports.milestone_text(F.col("d")))
    assert [r[0] for r in days.collect()] == ["7 days to 7", "1 days to 30", "past every milestone"]


def test_stored_tables_come_and_go(spark):
    folder = f"{shared_folder(spark)}/stored-test"
    assert stored(spark.range(3), folder).count() == 3
    remove_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_registry_addresses_move_in_place():
    text = '# ours\nvendors:\n  - name: A  # first\n    pricing_url: https://a.test/pricing # old\n  - name: B\n    pricing_url: "https://b.test/p"\n    note: https://b.test/p\n  - pricing_url: https://a.test/pricing/more\n'
    moved = patched_registry(text, [("https://a.test/pricing", "https://a.test/plans"), ("https://b.test/p", "https://b.test/q")])
    assert moved == text.replace("pricing # old", "plans # old").replace('"https://b.test/p"', '"https://b.test/q"')
    assert patched_registry(text, []) == text


def test_made_up_tables_repeat(spark):
    snaps = made_up_snapshots(spark, 3, 25)
    assert snaps.count() == 75 and sorted(snaps.collect()) == sorted(made_up_snapshots(spark, 3, 25).repartition(5).collect())
    moved = snaps.groupBy("slug").agg(F.count_distinct("text").alias("n")).collect()
    assert all(3 <= r["n"] <= 4 for r in moved)
    for r in made_up_records(spark, 4).collect():
        prices = [p["monthly_price"] for p in r["record"]["plans"]]
        assert r["demo"] and len(prices) == 3 and prices == sorted(prices)


def test_json_ld_of_site_and_archive(spark):
    totals = spark.createDataFrame([(3, 5, "</script>2024")], "vendors long, changes long, since string")
    row = render.dataset_schema(totals, "N & co", "https://x.test").withColumn("site", render.site_schema("N", "https://x.test", "<d>")).first()
    assert "<" not in row["json_ld"] + row["site"] and "&" not in row["json_ld"]
    archive, site = json.loads(row["json_ld"]), json.loads(row["site"])
    assert archive["@type"] == "Dataset" and archive["creator"]["name"] == "N & co" and archive["temporalCoverage"] == "</script>2024/.."
    assert site == {"@context": "https://schema.org", "@type": "WebSite", "name": "N", "url": "https://x.test", "description": "<d>"}


def test_spend_adds_up_and_fetched_texts_have_defaults(spark):
    month = lambda rows: spark.createDataFrame(rows, "month string, usd double")
    got = add_spend(month([("2024-01", 0.1), ("2024-02", 1.0)]), month([("2024-02", 0.25), ("2024-03", 2.0)])).collect()
    assert {tuple(r) for r in got} == {("2024-01", 0.1), ("2024-02", 1.25), ("2024-03", 2.0)}
    fetched = spark.createDataFrame([(200, "ok"), (500, "gone"), (200, None)], "status int, body string")
    assert [r[0] for r in fetched.select(text_or_default(F.col("status"), F.col("body"), "-")).collect()] == ["ok", "-", "-"]


def test_a_backlog_comes_in_steps(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(i,)], "event_id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = reading_stream(spark, str(tmp_path / "in"), "event_id int", most_files=2)
    sizes = []
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ckpt")).foreachBatch(lambda b, _: sizes.append(b.count())).start().awaitTermination()
    assert sum(sizes) == 5 and max(sizes) <= 2


def test_amounts_of_changes_have_the_vendors_currency(spark):
    events = spark.createDataFrame([("a", "price_increase", "Pro", 1.0, 2.0), ("b", "price_increase", "Pro", 1.0, 2.0)], "vendor string, change_type string, plan string, old_num double, new_num double")
    events = events.withColumns({c: F.lit(None).cast("string") for c in ("old_text", "new_text", "detected_at")})
    rows = render.change_rows(events, spark.createDataFrame([("a", "GBP")], "vendor string, currency string")).collect()
    assert {r["vendor"]: r["phrase"] for r in rows} == {"a": "Pro went up from £1 to £2", "b": "Pro went up from $1 to $2"}
