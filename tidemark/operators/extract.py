"""Extractors: page text to raw records. They run after every gate, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.records import RAW_RECORD, normalize_record

#: An extractor takes page texts and returns raw records as JSON, or None where it fails.
Extractor = Callable[[list[str]], list[str | None]]

_PRICE = re.compile(r"([$£€])\s?(\d[\d,]*(?:\.\d+)?)")
_LIMIT = re.compile(r"(\d[\d,]*|unlimited)\s+(seats|users|contacts|projects|gb)\b", re.IGNORECASE)
_SYMBOL = {"$": "USD", "£": "GBP", "€": "EUR"}


def pattern_extractor(texts: list[str]) -> list[str | None]:
    """The offline default: a price opens a plan named by the line before it or its own words."""
    return [_extract(t) for t in texts]


def _extract(text: str) -> str | None:
    plans: list[dict] = []
    currency, before = "", ""
    for line in (text or "").split("\n"):
        price = _PRICE.search(line)
        if price:
            currency = currency or _SYMBOL[price[1]]
            name = line[: price.start()].strip(" :-–") or before
            plans.append({"name": name, "monthly_price": price[2].replace(",", ""), "limits": [], "features": [], "is_per_seat": "per user" in line.lower() or "per seat" in line.lower()})
        elif line.strip().lower() == "free":
            plans.append({"name": line.strip(), "is_free": True, "limits": [], "features": []})
        elif plans:
            limit = _LIMIT.search(line)
            if limit:
                value = "-1" if limit[1].lower() == "unlimited" else limit[1].replace(",", "")
                plans[-1]["limits"].append({"metric": limit[2], "value": value, "unit": None})
            elif len(line) < 80:
                plans[-1]["features"].append(line)
        before = line.strip()
    return json.dumps({"currency": currency, "extraction_notes": "", "plans": plans}) if plans else None


def extract_records(
    pages: DataFrame, text_col: str = "text", extractor: Extractor = pattern_extractor, max_chars: int | None = None
) -> DataFrame:
    """``pages`` with ``record``: a normalised record, null where extraction failed.

    An extractor reads whole texts; ``max_chars`` is for one that is paid by its input and
    reads no more. The call is marked as not deterministic, so it runs once per row and
    above all filters before it.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(extractor(texts.fillna("").tolist()), dtype=object)

    called = F.pandas_udf(run, "string").asNondeterministic()
    read = F.col(text_col) if max_chars is None else F.substring(F.col(text_col), 1, max_chars)
    answered = pages.withColumn("_answer", called(read))
    raw = F.from_json("_answer", RAW_RECORD)
    stated = F.get_json_object("_answer", "$.pricing_is_public").isNotNull()
    record = F.when(F.col("_answer").isNotNull(), normalize_record(raw, stated))
    return answered.withColumn("record", record).drop("_answer")
