"""Operator 11: how filters interact, from Walsh-Hadamard sums of their failure masks."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(failures: list[Column]) -> Column:
    """Bit i is set where condition i holds; a null condition counts as passed."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    return mask.cast("int")


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Counts of documents by failure mask: (part, good, toxic, mask int, n long).

    Bits 0 to 3 are A to D of :func:`text_failures`, bit 4 is E: the text equals that of a smaller
    ``doc_id`` anywhere in the table. Texts are compared by SHA-256. A null text is empty, a
    null part is the empty string; rows without an id are never later copies and have no labels;
    rows that share an id are no copies of one another. ``good`` and ``toxic`` say whether any label row of the id has
    quality or toxic 1. Only the named columns are read, so others may have any name.

    Texts go no further than the scan: a row is an id, a hash, a mask and a part. Rows are summed
    before each shuffle, so copies of one text are a row per task, and labels meet documents by id,
    where rows without one are dealt out by text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("name"),
        mask_of(list(text_failures(F.col("text")).values())).alias("mask"),
    )
    rows = rows.groupBy("id", "part", "name", "mask").agg(F.count("*").alias("n"))
    alone = F.when(F.col("id").isNull(), F.xxhash64("name") % 9973).otherwise(F.lit(0).cast("long"))
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
        .where("id IS NOT NULL AND (q = 1 OR t = 1)")
        .groupBy("id")
        .agg(F.max(F.coalesce(F.col("q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("t") == 1, F.lit(False))).alias("toxic"))
        .withColumn("alone", F.lit(0).cast("long"))
    )
    labelled = rows.withColumn("alone", alone).join(known, ["id", "alone"], "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    # The smallest id of each text and its rows; the window then sees a row per part, label and text.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = labelled.select("id", "part", "name", "mask", "n", *flags).groupBy("name", "part", "good", "toxic", "mask", "id").agg(F.sum("n").alias("n"))
    texts = texts.groupBy("name", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"), least.alias("least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    first = F.min("least.id").over(Window.partitionBy("name"))
    passed = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    split = texts.withColumn("first", first).withColumn("passed", passed)
    both = F.array(
        F.struct(F.col("mask"), F.col("passed").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passed")).alias("n")),
    )
    return split.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def parity_sums(masks: DataFrame, by: list[str], filters: int) -> DataFrame:
    """(by..., sums): sums[S] is the sum of ``n`` over the masks, negated where mask and S share an
    odd number of bits. Sums are partial in each task, 2**filters numbers a group."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = masks.groupBy(*by).agg(*(F.sum(F.col("n") * sign(s)).alias(f"s{s}") for s in range(1 << filters)))
    return sums.select(*by, F.array(*(f"s{s}" for s in range(1 << filters))).alias("sums"))


def mask_cells(sums: Column, filters: int) -> Column:
    """How often each mask occurs, exactly, from its parity sums: the transform is its own inverse
    but for a factor of 2**filters."""
    masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def cell(mask: Column) -> Column:
        signed = F.transform(sums, lambda x, s: x * (1 - 2 * (F.bit_count(mask.bitwiseAND(s)) % 2)))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x), filters)

    return F.transform(masks, cell)


def _orders(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the filter, mask of the filters before it) of every order of the filters."""
    found = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            found.append(("".join(names[i] for i in order), step, 1 << f, before))
            before |= 1 << f
    return found


def interaction_audit(masks: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What each filter does at each step of every order, per part.

    ``masks`` are :func:`failure_masks`. Parity sums per part and label are turned into counts of
    masks; these give every order without reading a document again: a filter removes the cells that
    fail it and no filter before it. ``shapley`` is its removals over all orders, in closed form: a
    document that fails k filters is removed by each of them in one k-th of the orders. One row per part, order and step, zeros included; no parts, no rows.

    The table after the sums has a row per part and label, so all that follows grows with the parts
    alone. ``names`` has a letter per bit, six at most, as rows grow with the factorial.
    """
    filters = len(names)
    if not 1 <= filters <= 6:
        raise ValueError("one to six filters")
    spark, everything = masks.sparkSession, factorial(filters)
    cells = parity_sums(masks, ["part", "good", "toxic"], filters).select("part", "good", "toxic", F.posexplode(mask_cells(F.col("sums"), filters)).alias("mask", "n"))
    one = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    cells = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), one("good").alias("good"), one("toxic").alias("bad"))
    cells = cells.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "good", "bad"))).alias("cells"))

    def total(what: str, wanted) -> Column:
        of = F.filter("cells", lambda c: wanted(c["mask"]))
        return F.aggregate(of, F.lit(0).cast("long"), lambda t, c: t + c[what])

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    share = F.aggregate(
        F.filter("cells", lambda c: fails(c["mask"])),
        F.lit(0).cast("long"),
        lambda t, c: t + c["n"] * F.element_at(F.array(*(F.lit(everything // k) for k in range(1, filters + 1))), F.bit_count(c["mask"])),
    )
    # A part's figures depend on the filter and the set before it, which many orders share.
    steps = cells.withColumn("bit", F.explode(F.array(*(F.lit(1 << f) for f in range(filters)))))
    steps = steps.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1)))).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    steps = steps.select(
        "part", "bit", "before",
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        total("bad", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )
    orders = spark.createDataFrame(_orders(names), "filter_order string, step int, bit int, before int")
    joined = steps.join(F.broadcast(orders), ["bit", "before"])
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
