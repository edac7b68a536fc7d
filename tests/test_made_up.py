"""Made-up snapshots, records and changes tell one story."""

from pyspark.sql import functions as F

from tidemark.operators.extract import extract_records
from tidemark.plans.ingest import daily_changes
from tidemark.sources import registry


def test_records_snapshots_and_changes_agree(spark):
    vendors = spark.createDataFrame([(f"s{i}", i * 37) for i in range(12)], "slug string, number long")
    walk = registry.made_up_walk(vendors, 60).cache()
    records, columns = registry.walk_records(walk), ["slug", "day", "key", "change_type", "field", "old_num", "new_num", "old_text", "new_text"]
    days = walk.select("slug", "n", "day")
    told = daily_changes(records).join(days, ["slug", "n"])
    said = registry.walk_changes(walk).select(columns)
    assert sorted(map(str, told.select(columns).collect())) == sorted(map(str, said.collect()))
    kinds = {r.change_type for r in said.select("change_type").distinct().collect()}
    assert kinds == {"price_increase", "price_decrease", "limit_changed", "feature_added", "feature_moved_out"}
    assert told.where("NOT publishable AND change_type LIKE 'price%'").isEmpty()
    # What the extractor reads from the snapshots is what the records hold; it takes the next plan's name for a feature.
    read = extract_records(registry.walk_snapshots(walk)).select("slug", "day", F.explode("record.plans").alias("p"))
    held = records.select("slug", "day", F.explode("record.plans").alias("p"))
    facts = [*("slug", "day", "p.key", "p.monthly_price"), F.get("p.limits", F.lit(0))["value"].alias("seats"), F.array_sort(F.array_intersect("p.features", F.array(F.lit("export"), F.lit("support")))).alias("features")]
    assert sorted(map(str, read.where("p.monthly_price IS NOT NULL").select(*facts).collect())) == sorted(map(str, held.select(*facts).collect()))
    # Other seeds and vendors, other walks; the same ones, the same.
    assert registry.made_up_walk(vendors, 60, seed=8).exceptAll(walk).count() > 0 and registry.made_up_walk(vendors.repartition(5), 60).exceptAll(walk).isEmpty()
