"""Where tables go: routed changes, upserts and retention, for plain Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_changes(changes: DataFrame, path: str, batch: int | str) -> None:
    """Write a batch of changes once, split by ``publishable``; writing it again replaces it whole,
    also where the rerun has no rows on one side."""
    writer = changes.drop("batch").write.partitionBy("publishable").mode("overwrite")
    writer.option("partitionOverwriteMode", "static").parquet(f"{path}/batch={batch}")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` in the place of those with equal keys."""
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def without(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the rows whose keys are listed."""
    return stored.join(gone.select(*keys), keys, "left_anti")


def add_spend(stored: DataFrame, charges: DataFrame) -> DataFrame:
    """``(month, usd)`` with the charges of the same shape added to their months."""
    return stored.unionByName(charges).groupBy("month").agg(F.round(F.sum("usd"), 6).alias("usd"))


def to_jsonl(changes: DataFrame, path: str) -> None:
    """A change log of a JSON object per line."""
    changes.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
