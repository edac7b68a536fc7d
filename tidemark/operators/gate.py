"""Which vendors are due, which readings differ, what a run may spend, and how it went."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Budget of a run in USD, and the share of failures that raises an alarm.
RUN_BUDGET_USD, FAILURE_ALARM = 0.50, 0.5


def due_vendors(vendors: DataFrame, day: Column, force: bool = False) -> DataFrame:
    """Daily vendors always, weekly ones on Mondays; all when forced."""
    tier = F.coalesce("tier", F.lit("daily"))
    return vendors.where(F.lit(force) | (tier != "weekly") | (F.weekday(day) == 0))


def only_vendors(vendors: DataFrame, wanted: list[str] | DataFrame) -> DataFrame:
    """Vendors whose slug or lower-cased name is asked for, in a list or in a table of one column."""
    if isinstance(wanted, DataFrame):
        asked = wanted.select(F.lower(wanted.columns[0]).alias("_w")).distinct()
        known = vendors.withColumn("_w", F.explode(F.array_distinct(F.array("slug", F.lower("name")))))
        return known.join(asked, "_w", "left_semi").drop("_w").distinct()
    names = [w.lower() for w in wanted]
    return vendors.where(F.col("slug").isin(names) | F.lower("name").isin(names))


def hash_gate(readings: DataFrame, key: str, order: list[str], hashed: str = "hash") -> DataFrame:
    """Readings whose hash differs from that of the one before; a first reading passes.

    Only the last hash counts, so a page that goes back to an earlier text passes.
    """
    line = Window.partitionBy(key).orderBy(*order)
    before = readings.withColumn("_before", F.lag(hashed).over(line))
    return before.where(~F.col("_before").eqNullSafe(F.col(hashed))).drop("_before")


def unseen(readings: DataFrame, state: DataFrame) -> DataFrame:
    """Readings whose (slug, hash) is not the stored one: the gate against stored state."""
    return readings.join(state.select("slug", "hash"), ["slug", "hash"], "left_anti")


def hash_change_count(readings: DataFrame, key: str, order: list[str], hashed: str = "hash") -> DataFrame:
    """Per key the number of times the hash moved."""
    line = Window.partitionBy(key).orderBy(*order)
    before = F.lag(hashed).over(line)
    moved = readings.withColumn("_moved", (before.isNotNull() & (before != F.col(hashed))).cast("long"))
    return moved.groupBy(key).agg(F.sum("_moved").alias("hash_changes"))


def confirm_changes(readings: DataFrame, key: str, seq: str, print_col: str) -> DataFrame:
    """Changes that two successive readings agree on: (key, seq, old_print, new_print).

    A reading equal to the confirmed print clears what is pending; one equal to the pending
    print confirms it; any other becomes pending. So a print is confirmed by the second of
    two equal ones in a row and by nothing else, and the confirmed print at any time is that
    of the last such pair, or the first print of all where there was none. Two windows over
    rows say this: nothing is gathered, and a long history is sorted and streamed. A null
    print confirms nothing and comes between equal ones.
    """
    line = Window.partitionBy(key).orderBy(seq, print_col)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = readings.select(
        F.col(key), F.col(seq).alias("seq"), F.col(print_col).alias("_print"),
        (F.lag(print_col).over(line) == F.col(print_col)).alias("_agreed"), F.count(print_col).over(upto).alias("_n"),
    )
    # The first print of all starts the line of confirmed prints; each pair goes on with it.
    settled = marked.where("_print IS NOT NULL AND (_n = 1 OR _agreed)")
    before = settled.withColumn("_old", F.lag("_print").over(Window.partitionBy(key).orderBy("seq", "_print", "_n")))
    return before.where("_old <> _print").select(key, "seq", F.col("_old").alias("old_print"), F.col("_print").alias("new_print"))


def budget_cutoff(costs: DataFrame, run: str, order: str, cost: str, budget: float | Decimal = RUN_BUDGET_USD, block: int = 10_000) -> DataFrame:
    """Rows of each run before the first that would exceed its budget, with the sum so far.

    ``order`` is a whole number. Sums of blocks of ``block`` places come first and only they
    are ordered within a run; inside a block the rows are, so no task sorts a whole run.
    """
    blocked = costs.withColumn("_block", F.floor(F.col(order) / block))
    upto = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(run, "_block").agg(F.sum(cost).alias("_sum"))
    before = sums.select(run, "_block", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    line = Window.partitionBy(run, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Costs are not negative, so the running sum never comes back below the budget, and a
    # block that begins above it has no row to give.
    open_ = blocked.join(before.where(F.col("_before") <= budget), [run, "_block"])
    summed = open_.withColumn("spent", F.col("_before") + F.sum(cost).over(line))
    return summed.where(F.col("spent") <= budget).drop("_block", "_before")


def consecutive_failures(checks: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Per key the length of the last run of failures; 0 after a success.

    Failures after the last success are the run, so two aggregates do without a sort.
    """
    at = F.struct(*order)
    last_ok = checks.groupBy(key).agg(F.max(F.when(~failed, at)).alias("_ok"))
    after = checks.where(failed).join(last_ok, key).where(F.col("_ok").isNull() | (at > F.col("_ok")))
    counts = after.groupBy(key).agg(F.count("*").alias("consecutive_failures"))
    return last_ok.select(key).join(counts, key, "left").select(key, F.coalesce("consecutive_failures", F.lit(0)).cast("long").alias("consecutive_failures"))


def failure_hint(http_status: Column, failures: Column) -> Column:
    """What to do about a failing vendor."""
    return F.when(http_status.isin(403, 429), "blocked").when(failures >= 3, "fix the address")


def worth_recovering(http_status: Column, by_robots: Column) -> Column:
    return http_status.isin(404, 410, 0) & ~by_robots


def run_stats(checks: DataFrame, by: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """Per run how many checks ended in each outcome."""
    return checks.groupBy(by).agg(F.count("*").alias("checked"), *(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes))


def failure_alarm(stats: DataFrame, failed: Column, checked: Column) -> DataFrame:
    """Runs in which more than half of the checks failed."""
    return stats.withColumn("failure_ratio", F.try_divide(failed, checked)).where(F.col("failure_ratio") > FAILURE_ALARM)
