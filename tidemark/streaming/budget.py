"""A spending limit per day over a stream: what is over it waits for the next day."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gate import RUN_BUDGET_USD, budget_cutoff
from tidemark.operators.ranks import places
from tidemark.session import reliable_checkpoint
from tidemark.sources.runs import RunStore

#: A request as it arrives, and the tables that batches leave behind. Sums of decimals are exact.
REQUEST = "slug string, day date, pos long, cost decimal(18, 6)"
WAITING = "slug string, place long, cost decimal(18, 6)"
SPENT = "day date, usd decimal(18, 6), last long"
ACCEPTED = "slug string, place long, cost decimal(18, 6), day date"


def budget_batch(store: RunStore, batch: DataFrame, number: int, budget: float = RUN_BUDGET_USD) -> None:
    """Accept requests of a batch, and of those that wait, up to the budget of each day.

    Requests are taken in order of arrival: those that wait first, then the day's by ``pos``, ties by slug. A day's requests
    are accepted up to the first that would pass its budget, whatever comes after it, and the rest waits
    for the next day. A request of a day before the newest one, or of none, counts as the newest day's; where no day
    is known yet it waits. As long as requests arrive in their order, what is accepted does not depend on how the
    stream is cut into batches.

    The tables ``waiting``, ``spent`` and ``accepted`` of ``store`` change together; a batch that is
    written again replaces itself. The days of a batch are taken one after another, the requests of a day in
    blocks over all tasks.
    """
    run = store.begin(f"{number:012d}")
    days = run.read("spent", SPENT).collect()  # a row per day
    spent, last = {r["day"]: r["usd"] for r in days}, max((r["last"] for r in days), default=0)
    waiting, newest = run.read("waiting", WAITING), max(spent, default=None)
    # Places go on from the last one given, whether that request waits or was accepted.
    last = max(last, waiting.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0])
    kind = "decimal(18, 6)"
    day = F.greatest(F.col("day"), F.lit(newest).cast("date"))
    latest = batch.agg(F.max("day")).first()[0]
    rows = reliable_checkpoint(batch.select("slug", F.coalesce(day, F.lit(latest).cast("date")).alias("day"), "pos", F.col("cost").cast(kind).alias("cost")))
    done = None
    for today in [r["day"] for r in rows.select("day").distinct().orderBy("day").collect()]:
        fresh = places(rows.where(F.col("day").eqNullSafe(F.lit(today).cast("date"))).drop("day"), ["pos", "slug", "cost"])
        queue = waiting.unionByName(fresh.select("slug", (F.col("place") + last).alias("place"), "cost"))
        queue = reliable_checkpoint(queue.withColumn("run", F.lit(1)))
        last = max(last, queue.agg(F.max("place")).first()[0])
        if today is None:
            waiting = queue.drop("run")
            continue
        left = Decimal(str(budget)) - spent.get(today, 0)
        paid = reliable_checkpoint(budget_cutoff(queue, "run", "place", "cost", left).select("slug", "place", "cost", F.lit(today).alias("day")))
        spent[today] = spent.get(today, Decimal(0)) + (paid.agg(F.sum("cost")).first()[0] or 0)
        waiting = reliable_checkpoint(queue.drop("run").join(paid.select("place"), "place", "left_anti").select("slug", "place", "cost"))
        done = paid if done is None else done.unionByName(paid)
    run.put("waiting", waiting)
    run.put("spent", store.spark.createDataFrame([(d, usd, last) for d, usd in sorted(spent.items())], SPENT))
    if done is not None:
        run.append("accepted", done)
    run.commit()


def budget_stream(requests: DataFrame, folder: str, checkpoint: str, budget: float = RUN_BUDGET_USD):
    """Accept a stream of requests (:data:`REQUEST`) within the budget of each day, into the run store at ``folder``."""
    store = RunStore(requests.sparkSession, folder)
    writer = requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: budget_batch(store, batch, number, budget)).start()
