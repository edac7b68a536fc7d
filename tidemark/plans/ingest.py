"""One ingest run: from fetched pages to confirmed records and routed changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import content_hash, extraction_cost, looks_like_pricing_page
from tidemark.operators import gate
from tidemark.operators.diff import diff_readings, diff_sides, is_publishable
from tidemark.operators.extract import Extractor, extract_records, pattern_extractor
from tidemark.operators.html import clean_pages
from tidemark.operators.records import record_fingerprint
from tidemark.session import reliable_checkpoint

__all__ = ["IngestRun", "ingest", "is_publishable"]


@dataclass(frozen=True)
class IngestRun:
    """What a run returns, each a frame that the caller stores."""

    #: (slug, status, hash) of every page.
    outcomes: DataFrame
    #: (slug, day, text, hash) of pages whose hash moved.
    snapshots: DataFrame
    #: (slug, record) that become or stay the baseline.
    confirmed: DataFrame
    #: (slug, record) held for a second reading.
    pending: DataFrame
    #: Typed changes with confidence and ``publishable``.
    changes: DataFrame
    #: (month, usd) that the extractions of the run cost.
    spend: DataFrame
    #: (slug, fate) of every page that was extracted: new, noise, hold, change, or confirmed without an event.
    fates: DataFrame

    def counters(self) -> DataFrame:
        """One row: what the run did, in the counts that it reports."""
        status, fate = F.col("status"), F.col("fate")
        skipped = status.isin("robots_disallowed")
        checks = self.outcomes.agg(
            F.count("*").alias("checked"),
            F.count_if(status == "same").alias("unchanged"),
            F.count_if(skipped).alias("skipped_robots"),
            F.count_if(status.isin("error", "not_a_pricing_page", "extraction_error")).alias("failed"),
            F.count_if(status == "over_budget").alias("over_budget"),
        )
        read = self.fates.agg(
            F.count("*").alias("extracted"), F.count_if(fate.isin("noise", "confirmed")).alias("noisy"), F.count_if(fate == "hold").alias("awaiting")
        )
        routed = self.changes.agg(F.count_if("publishable").alias("changes"), F.count_if(~F.col("publishable")).alias("queued"))
        # Single rows: the products hold one row each.
        return checks.join(read, how="cross").join(routed, how="cross")


#: What is known of a page from run to run.
STATE = "slug string, status string, hash string, last_checked date, consecutive_failures int, hash_changes int"


def state_after(state: DataFrame, run: IngestRun, day: str) -> DataFrame:
    """The state with what a run found: a hash is kept until its page was read, failures count up to the
    next page that came, and a moved hash counts once. Pages that the run did not see stay as they are."""
    moved = run.snapshots.select("slug", F.lit(1).alias("_moved"))
    old = state.select("slug", *(F.col(c).alias(f"_{c}") for c in ("hash", "last_checked", "consecutive_failures", "hash_changes")))
    known = run.outcomes.join(old, "slug", "left").join(moved, "slug", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    status = F.col("status")
    seen = known.select(
        "slug",
        "status",
        F.when(status.isin("ok", "same"), F.col("hash")).otherwise(F.col("_hash")).alias("hash"),
        F.when(status.isin("ok", "same", "over_budget", "extraction_error"), F.lit(day).cast("date")).otherwise(F.col("_last_checked")).alias("last_checked"),
        F.when(status == "error", number("_consecutive_failures") + 1).when(status == "robots_disallowed", number("_consecutive_failures")).otherwise(0).alias("consecutive_failures"),
        (number("_hash_changes") + number("_moved")).cast("int").alias("hash_changes"),
    )
    rest = state.join(run.outcomes.select("slug"), "slug", "left_anti")
    return seen.unionByName(rest.select(*seen.columns))


def flat_plans(records: DataFrame) -> DataFrame:
    """``(slug, record)`` to a row per plan in the shape that the diff takes."""
    exploded = records.select(F.col("slug").alias("vendor"), F.posexplode("record.plans").alias("pos", "p"))
    # Equal metrics of a plan stand side by side, since limits are sorted: the last one counts.
    last = F.filter("p.limits", lambda x, i: ~F.coalesce(F.get("p.limits", i + 1)["metric"] == x["metric"], F.lit(False)))
    metric = F.transform(last, lambda x: F.struct(x["metric"].alias("key"), x["value"].alias("value")))
    return exploded.select(
        "vendor", "p.key", "pos", "p.name", "p.monthly_price", "p.annual_price_per_month", "p.is_custom_pricing", "p.is_per_seat",
        F.map_from_entries(metric).alias("limits"), "p.features",
    )


def reading_of(records: DataFrame) -> DataFrame:
    return records.select(F.col("slug").alias("vendor"), "record.currency", "record.pricing_is_public", "record.extraction_notes")


def daily_changes(records: DataFrame) -> DataFrame:
    """Changes between the records ``(slug, n, record)`` of each number and the one before: (slug, n, and what
    :func:`diff_readings` says)."""
    at = lambda new, add: F.struct(F.struct("vendor.slug", (F.col("vendor.n") + add).alias("n")).alias("vendor"), F.lit(new).alias("new"))
    # One pass makes both sides: a record is new on its number and old on the next.
    sides = lambda rows: rows.select(F.explode(F.array(at(True, 0), at(False, 1))).alias("_at"), *(c for c in rows.columns if c != "vendor")).select("_at.*", *(c for c in rows.columns if c != "vendor"))
    named = records.select(F.struct("slug", "n").alias("slug"), "record")
    changes = diff_sides(sides(flat_plans(named)), sides(reading_of(named)))
    return changes.select("vendor.slug", "vendor.n", *(c for c in changes.columns if c != "vendor"))


def ingest(
    pages: DataFrame,
    state: DataFrame,
    baseline: DataFrame,
    pending: DataFrame,
    day: str,
    budget: float = gate.RUN_BUDGET_USD,
    extractor: Extractor = pattern_extractor,
    force: bool = False,
) -> IngestRun:
    """Run the gates in order of their cost, extract what is left, confirm and compare.

    ``pages(slug, pos, url, status, blocked, html)`` are fetched pages in the order in
    which the budget is spent; ``state(slug, hash)``, ``baseline(slug, record)`` and
    ``pending(slug, record)`` are what earlier runs stored. A page with a held reading is
    not gated by its hash, so the next reading can confirm it.
    """
    fetched = clean_pages(pages).withColumn("hash", content_hash(F.col("text")))
    known = fetched.join(state.select("slug", F.col("hash").alias("_last")), "slug", "left")
    known = known.join(pending.select("slug", F.col("record").alias("_held")), "slug", "left")
    same = F.col("hash").eqNullSafe(F.col("_last")) & F.col("_held").isNull() & F.lit(not force)
    status = (
        F.when(F.col("blocked"), "robots_disallowed")
        .when(F.col("status") != 200, "error")
        .when(~F.coalesce(looks_like_pricing_page(F.col("text")), F.lit(False)), "not_a_pricing_page")
        .when(same, "same")
        .otherwise("read")
    )
    # Stored, so that no output parses the pages again.
    judged = reliable_checkpoint(known.withColumn("outcome", status).drop("html", "url"))
    moved = judged.where("outcome = 'read'")
    snapshots = moved.where(~F.col("hash").eqNullSafe(F.col("_last"))).select("slug", F.lit(day).cast("date").alias("day"), "text", "hash")
    # Costs are summed without the texts; the pages that are paid for are joined back.
    costed = moved.select("slug", "pos", extraction_cost(F.col("text")).alias("cost"), F.lit(day).alias("run"))
    paid = moved.join(gate.budget_cutoff(costed, "run", "pos", "cost", budget).select("slug", "pos"), ["slug", "pos"], "left_semi")
    read = reliable_checkpoint(extract_records(paid.select("slug", "text", "_held"), extractor=extractor).drop("text"))

    compared = read.where("record IS NOT NULL").join(baseline.select("slug", F.col("record").alias("_base")), "slug", "left")
    fp = {n: record_fingerprint(F.col(n)) for n in ("record", "_base", "_held")}
    fate = (
        F.when(F.col("_base").isNull(), "new")
        .when(fp["record"] == fp["_base"], "noise")
        .when(F.col("_held").isNull() | (fp["_held"] != fp["record"]), "hold")
        .otherwise("change")
    )
    compared = compared.withColumn("fate", fate)
    fresh = compared.where("fate IN ('new', 'change')").select("slug", "record")
    changed = compared.where("fate = 'change'")
    old, new = changed.select("slug", F.col("_base").alias("record")), changed.select("slug", "record")
    changes = diff_readings(flat_plans(old), flat_plans(new), reading_of(old), reading_of(new))
    settled = compared.where("fate <> 'hold'").select("slug")
    held = compared.where("fate = 'hold'").select("slug", "record")
    done = read.select("slug", F.when(F.col("record").isNull(), "extraction_error").otherwise("ok").alias("_read"))
    outcome = F.when(F.col("outcome") != "read", F.col("outcome")).otherwise(F.coalesce("_read", F.lit("over_budget")))
    outcomes = judged.join(done, "slug", "left").select("slug", outcome.alias("status"), "hash")
    charged = costed.join(paid.select("slug", "pos"), ["slug", "pos"], "left_semi")
    spend = charged.groupBy(F.date_format(F.lit(day).cast("date"), "yyyy-MM").alias("month")).agg(F.round(F.sum("cost"), 6).alias("usd"))
    told = changes.select(F.col("vendor").alias("slug"), F.lit(True).alias("_told")).distinct()
    fates = compared.select("slug", "fate").join(told, "slug", "left")
    fates = fates.select("slug", F.when((F.col("fate") == "change") & F.col("_told").isNull(), "confirmed").otherwise(F.col("fate")).alias("fate"))
    return IngestRun(
        outcomes,
        snapshots,
        baseline.select("slug", "record").join(fresh.select("slug"), "slug", "left_anti").unionByName(fresh),
        pending.select("slug", "record").join(settled.unionByName(held.select("slug")), "slug", "left_anti").unionByName(held),
        changes,
        spend,
        fates,
    )
