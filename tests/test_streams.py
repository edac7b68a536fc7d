"""Streams against plain loops: confirmation of long keys, and a budget per day over any batches."""

import datetime as dt
import itertools
from decimal import Decimal

import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.sources.runs import RunStore
from tidemark.streaming.budget import ACCEPTED, REQUEST, SPENT, WAITING, budget_batch, budget_stream
from tidemark.streaming.confirm import Confirmation, confirm_stream, step

READINGS = "slug string, seq long, hash string, print string"


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value


class Parts(dict):
    """A state store's map; remembers how many readings it was asked for at once."""

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        return self[key]


class Handle:
    def __init__(self):
        self.value, self.parts = Value(), Parts()

    def getValueState(self, name, schema):
        return self.value

    def getMapState(self, name, key, value):
        return self.parts


def plain(readings, strict):
    now, out = (None, None, None), []
    for seq, hashed, found in readings:
        now, outcome, old = step(now, hashed, found, strict)
        out.append((seq, outcome, old, found if outcome == "change" else None))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["x", "y", "z", None])), max_size=40), st.randoms(), st.integers(1, 9), st.integers(1, 4), st.booleans())
def test_the_rule_sees_readings_in_order_whatever_is_kept(pairs, random, held_rows, chunk_rows, strict):
    readings = [(i, h, p) for i, (h, p) in enumerate(pairs)]
    rule, handle = Confirmation(strict, held_rows, chunk_rows), Handle()
    rule.init(handle)
    out, at = [], 0
    while at < len(readings):  # batches in order, rows of each in none, in frames of any size
        batch = readings[at : at + random.randint(1, 20)]
        at += len(batch)
        random.shuffle(batch)
        cut = random.randint(0, len(batch))
        frames = [pd.DataFrame(part, columns=["seq", "hash", "print"]) for part in (batch[:cut], batch[cut:]) if part]
        for frame in rule.handleInputRows(("s",), iter(frames), None):
            out += [tuple(None if pd.isna(x) else x for x in r)[1:] for r in frame.itertuples(index=False)]
        assert not handle.parts
    assert out == plain(readings, strict)


def test_a_long_key_on_a_stream(spark, tmp_path):
    """One key of 60,000 readings in a batch, 2,000 held at once, beside short ones, over two batches."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("k"), (F.col("id") % 60).cast("string"))).otherwise("hot").alias("slug"), F.col("id").alias("seq"),
        (F.col("id") % 7).cast("string").alias("hash"), (F.floor(F.col("id") / 3) % 3).cast("string").alias("print"),
    )
    got = {}
    for batch in (rows.where(F.col("seq") < n // 2), rows.where(F.col("seq") >= n // 2)):
        batch.repartition(4).write.mode("append").parquet(str(tmp_path / "in"))
        stream = confirm_stream(spark.readStream.schema(READINGS).parquet(str(tmp_path / "in")), held_rows=2_000)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
        q.trigger(availableNow=True).start().awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.slug, []).append((r.seq, r.outcome, r.old_print, r.new_print))
    want = {}
    for r in rows.orderBy("seq").collect():
        want.setdefault(r.slug, []).append((r.seq, r.hash, r.print))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(v, False) for k, v in want.items()}


DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3)]


def plain_budget(requests, budget):
    """{day: accepted slugs} and what waits: one request after another, no state but a line."""
    accepted, spent, line, newest = {}, {}, [], None
    days = sorted({d for _, d, _, _ in requests if d is not None})
    for day in days:
        line += [(slug, cost) for slug, d, _, cost in requests if d == day]
        spent[day] = Decimal(0)
        accepted[day] = []
        while line and spent[day] + line[0][1] <= budget:
            slug, cost = line.pop(0)
            spent[day] += cost
            accepted[day].append(slug)
        newest = day
    return accepted, [slug for slug, _ in line], newest


@settings(max_examples=5, deadline=None, phases=[Phase.generate], derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_no_day_is_overspent_over_any_batches(spark, tmp_path_factory, data):
    costs = data.draw(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=12))
    requests = [(f"s{i}", DAYS[d], i, Decimal(c) / 100) for i, (d, c) in enumerate(sorted(costs, key=lambda x: x[0]))]
    cuts = sorted(data.draw(st.sets(st.integers(0, len(requests)), max_size=2)))
    store = RunStore(spark, str(tmp_path_factory.mktemp("budget")))
    parts = [requests[a:b] for a, b in itertools.pairwise([0, *cuts, len(requests)])]
    for number, part in enumerate(parts):
        for _ in range(1 + (number == 0)):  # a batch that is written again replaces itself
            budget_batch(store, spark.createDataFrame(part, REQUEST), number, 0.7)
    accepted, line, _ = plain_budget(requests, Decimal("0.7"))
    got = {}
    for r in sorted(store.read("accepted", ACCEPTED).collect(), key=lambda r: r.place):
        got.setdefault(r.day, []).append(r.slug)
    assert got == {d: s for d, s in accepted.items() if s}
    assert [r.slug for r in sorted(store.read("waiting", WAITING).collect(), key=lambda r: r.place)] == line
    assert all(r.usd <= Decimal("0.7") for r in store.read("spent", SPENT).collect())


def test_budget_over_a_stream(spark, tmp_path):
    """Late requests and such without a day count as the newest day's; a restart goes on."""
    folder, source = str(tmp_path / "store"), str(tmp_path / "in")
    batches = [
        [("a", DAYS[1], 1, "0.3"), ("b", DAYS[1], 2, "0.3"), ("c", DAYS[1], 3, "0.01")],
        [("d", DAYS[0], 4, "0.1"), ("e", None, 5, "0.1"), ("f", DAYS[2], 6, "0.45")],
    ]
    for part in batches:
        spark.createDataFrame([(s, d, p, Decimal(c)) for s, d, p, c in part], REQUEST).coalesce(1).write.mode("append").parquet(source)
        budget_stream(spark.readStream.schema(REQUEST).parquet(source), folder, str(tmp_path / "ckpt"), 0.5).awaitTermination()
    store = RunStore(spark, folder)
    got = {r.slug: r.day for r in store.read("accepted", ACCEPTED).collect()}
    assert got == {"a": DAYS[1], "b": DAYS[2], "c": DAYS[2], "d": DAYS[2]}
    assert [r.slug for r in sorted(store.read("waiting", WAITING).collect(), key=lambda r: r.place)] == ["e", "f"]


def test_requests_without_any_day_wait(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    budget_batch(store, spark.createDataFrame([("a", None, 1, Decimal("0.1"))], REQUEST), 0, 0.5)
    assert [r.slug for r in store.read("waiting", WAITING).collect()] == ["a"] and store.read("accepted", ACCEPTED).count() == 0
    budget_batch(store, spark.createDataFrame([], REQUEST), 1, 0.5)
    budget_batch(store, spark.createDataFrame([("b", DAYS[0], 1, Decimal("0.1"))], REQUEST), 2, 0.5)
    assert sorted(r.slug for r in store.read("accepted", ACCEPTED).collect()) == ["a", "b"]
