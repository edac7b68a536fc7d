"""Line logs that may be damaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a change event on disk; values of any JSON type stay variants.
CHANGE_FIELDS = {
    "vendor": "string", "change_type": "string", "plan": "string", "field": "string",
    "old_value": "variant", "new_value": "variant", "confidence": "double", "detected_at": "string", "note": "string",
}


def parse_log(lines: DataFrame, line_col: str) -> DataFrame:
    """Rows whose line is a JSON object, with it as the variant ``entry``; all other lines go."""
    entry = F.try_parse_json(line_col)
    parsed = lines.withColumn("entry", entry).where(F.col("entry").isNotNull())
    return parsed.where(F.schema_of_variant("entry").startswith("OBJECT"))


def field(name: str, kind: str) -> Column:
    """A field of the variant ``entry``, null where it is missing or of another type."""
    return F.try_variant_get("entry", f"$.{name}", kind)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The change log at ``path``, newest first reports sort it themselves.

    Lines end at line feeds only, so separators inside a JSON string don't break one.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    rows = parse_log(lines, "value").select(*(field(n, k).alias(n) for n, k in CHANGE_FIELDS.items()))
    at = F.try_to_timestamp(F.col("detected_at"))
    number = lambda c: F.try_variant_get(c, "$", "double")
    return rows.withColumns({"detected_at": at, "old_num": number("old_value"), "new_num": number("new_value")})


def json_or_default(status: Column, body: Column, default: str) -> Column:
    """A fetched JSON document as a variant; ``default`` where the fetch failed or it does not parse."""
    return F.coalesce(F.when(status == 200, F.try_parse_json(body)), F.parse_json(F.lit(default)))


def text_or_default(status: Column, body: Column, default: str = "") -> Column:
    """A fetched text, or ``default`` where the fetch failed."""
    return F.coalesce(F.when(status == 200, body), F.lit(default))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Nested records, one JSON document per file; unreadable files give a row with a null record.

    Returns (slug, record, readable): the slug is the file's name.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    record = F.when(ok, F.from_json("value", schema))
    return files.select(F.regexp_replace("file", r"\.json$", "").alias("slug"), record.alias("record"), ok.alias("readable"))


def read_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """One JSON object of entries by key as rows (key, value); a damaged file gives none."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string,{value_schema}>")
    return text.where(F.try_parse_json("value").isNotNull()).select(F.explode(entries).alias("key", "value"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(slug, day, text) of snapshot files ``<path>/<slug>/<day>.txt``; names that are no day go."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    named = files.select(
        F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("slug"),
        F.regexp_extract(where, r"([^/]+)\.txt$", 1).try_cast("date").alias("day"),
        F.col("value").alias("text"),
    )
    return named.where("day IS NOT NULL")
