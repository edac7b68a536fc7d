"""Operator 1: mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, broadcast_if_small, reliable_checkpoint

#: Hash bits used, and bits resolved by each histogram.
HASH_BITS, LEVEL_BITS = 48, 12


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """A 48-bit number from the document id, the same in every run; null ids hash as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def water_fill(sizes: DataFrame, share: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets of ``sizes(source, source_size)`` for a budget of ``share`` of all sizes.

    Weights repeat over the sources in code-point order, null last. A target stops at
    ``limit`` times its size; what is over goes to the others by weight until none is
    above. In order of size per weight the capped sources come first, so prefix sums
    give the final level at once. The table has a row per source, and only it is sorted.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    return (
        sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", F.lit(limit) * F.col("source_size"))
        .withColumn("_level", level)
        # The first source below its cap sets the level; levels after it are lower.
        .withColumn("_open", F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level")))
        .withColumn("_final", F.max("_open").over(everything))
        .select(
            "source",
            "source_size",
            F.least("_cap", F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).cast("double").alias("target"),
        )
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source key, repeats, threshold): take every document ``repeats`` times, and once
    more where its hash is below the threshold.

    Level by level the words are summed by source and hash bucket, the boundary bucket
    is the last that the remaining budget reaches, and only its documents go to the next
    histogram. The last level separates single hashes; the boundary hash itself is taken
    when at least half of it fits the budget.
    """
    found = targets.where("source_size > 0").select(
        "_key",
        F.floor(F.col("target") / F.col("source_size")).cast("long").alias("repeats"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("prefix"),
    )
    rest = HASH_BITS
    while rest > 0:
        rest -= LEVEL_BITS
        inside = sized.join(
            broadcast_if_small(found.select("_key", "prefix")),
            (sized["_key"] == found["_key"]) & (F.shiftright(sized["_hash"], rest + LEVEL_BITS) == found["prefix"]),
            "left_semi",
        )
        histogram = inside.groupBy("_key", F.shiftright("_hash", rest).alias("bucket")).agg(F.sum("size").alias("words"))
        joined = histogram.join(broadcast_if_small(found), "_key")
        line = Window.partitionBy("_key").orderBy("bucket")
        upto = F.coalesce(F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # A bucket that starts within the budget may hold the boundary; the last one does.
        reached = joined.withColumn("before", upto).where("before <= left AND words > 0")
        last = reached.groupBy("_key").agg(F.max(F.struct("bucket", "before", "words", "left", "repeats")).alias("m"))
        found = reliable_checkpoint(
            last.select(
                "_key",
                F.col("m.repeats").alias("repeats"),
                (F.col("m.left") - F.col("m.before")).alias("left"),
                F.col("m.bucket").alias("prefix"),
                F.col("m.words").alias("_words"),
            )
        )
        if rest:
            found = found.drop("_words")
    return found.select(
        "_key", "repeats", (F.col("prefix") + F.when(F.col("left") * 2 >= F.col("_words"), 1).otherwise(0)).alias("threshold")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    limit: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2),
) -> DataFrame:
    """Words that a mix of ``share`` times all words takes from each document.

    Returns one row per input row: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's) and ``taken`` (size times 0, 1 or 2 at ``limit`` 2).
    Sources weigh ``weights`` in turn by code point, null last (see :func:`water_fill`).

    Documents pass by comparing a hash of their id with their source's threshold, so
    nothing is sorted and a rerun agrees. A source misses its target by at most half
    of the boundary document. Rows that repeat an id are taken or left together. Null
    and empty texts have size 0 and take 0; null sources form one source; a source
    without words has target 0. An empty table gives an empty result. Other columns
    are not read, and only ids, sizes and source names are kept between passes.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = reliable_checkpoint(
        known.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("_hash"))
        # Joins on a key that is never null.
        .withColumn("_key", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(sizes, share, limit, weights).withColumn(
        "_key", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    )
    targets = reliable_checkpoint(targets)
    chosen = targets.drop("source").join(broadcast_if_small(thresholds(sized, targets)), "_key", "left")
    taken = F.col("size") * (
        F.coalesce("repeats", F.lit(0)) + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0)
    )
    return sized.join(broadcast_if_small(chosen), "_key").select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )
