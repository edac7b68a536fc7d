"""Normalising, fingerprints and differences on invented records."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import diff, records
from tidemark.operators.gate import confirm_changes
from tidemark.streaming.confirm import step

PLAN = {
    "name": "Starter", "monthly_price": "12", "annual_price_per_month": None, "is_free": None, "is_custom_pricing": False, "is_per_seat": True,
    "is_addon": None, "min_seats": "two", "trial_days": "14", "limits": [], "features": [],
}


def raw(plans, **rest):
    base = {"currency": "usd", "pricing_is_public": True, "extraction_notes": ""}
    return json.dumps(base | rest | {"plans": [PLAN | p for p in plans]})


def normal(spark, *texts, **given_flags):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.withColumn("raw", F.from_json("t", records.RAW_RECORD))
    public = F.get_json_object("t", "$.pricing_is_public").isNotNull() | F.col("t").contains('"pricing_is_public": null')
    df = df.withColumn("record", records.normalize_record(F.col("raw"), public))
    return df.withColumn("fp", records.record_fingerprint(F.col("record"))).orderBy("i").collect()


def test_normalising(spark):
    (row,) = normal(
        spark,
        raw(
            [
                {"name": " Pro Tier Plan ", "monthly_price": "49.005"},
                {"name": " "},
                {"name": None},
                {"name": "Enterprise", "monthly_price": "call us"},
                {"name": "Free", "monthly_price": None, "is_free": True, "features": [" B ", "a", "A", ""],
                 "limits": [{"metric": " Seats ", "value": "-1", "unit": ""}, {"metric": "", "value": "3", "unit": "x"}, {"metric": "api", "value": "x", "unit": "calls"}]},
            ],
            currency=" dollars",
        ),
    )
    record = row["record"]
    assert record["currency"] == "DOL" and record["pricing_is_public"]
    assert [(p["key"], p["monthly_price"]) for p in record["plans"]] == [("free", 0.0), ("pro", 49.01), ("enterprise", None)]
    free = record["plans"][0]
    assert free["features"] == ["a", "b"] and free["min_seats"] is None and free["trial_days"] == 14 and free["is_addon"] is False
    assert [tuple(x) for x in free["limits"]] == [("api", None, "calls"), ("seats", -1.0, None)]


def test_public_flag(spark):
    texts = [raw([PLAN]), raw([PLAN], pricing_is_public=None), json.dumps({"currency": None, "plans": None})]
    rows = normal(spark, *texts)
    assert [r["record"]["pricing_is_public"] for r in rows] == [True, False, True]
    assert rows[2]["record"]["plans"] == []


def test_fingerprint_ignores_order_and_names_only(spark):
    a, b = {"name": "A", "monthly_price": "1"}, {"name": "B", "monthly_price": "2"}
    same = [raw([a, b]), raw([b, a]), raw([a | {"name": "a plan"}, b]), raw([a, b], extraction_notes="note"), raw([a | {"is_per_seat": False}, b])]
    other = [raw([a]), raw([a, b | {"monthly_price": "2.01"}]), raw([a, b], currency="EUR"), raw([a, b | {"features": ["x"]}]), raw([a, b], pricing_is_public=False)]
    prints = [r["fp"] for r in normal(spark, *same, *other)]
    assert len(set(prints[: len(same)])) == 1 and len(set(prints)) == 1 + len(other)


PLANS = "vendor long, key string, pos int, name string, monthly_price double, annual_price_per_month double, is_custom_pricing boolean, is_per_seat boolean, limits map<string,double>, features array<string>"
READ = "vendor long, currency string, pricing_is_public boolean, extraction_notes string"


def plan(key, price=10.0, annual=None, name=None, custom=False, seat=False, limits=None, features=()):
    return (key, 0, name or key, price, annual, custom, seat, limits or {}, list(features))


def events(spark, old, new, was=("USD", True, ""), now=("USD", True, "")):
    side = lambda rows: spark.createDataFrame([(1, *r) for r in rows], PLANS)
    read = lambda r: spark.createDataFrame([(1, *r)], READ)
    rows = diff.diff_readings(side(old), side(new), read(was), read(now)).collect()
    return sorted((r["change_type"], r["field"] or "", r["confidence"], r["publishable"]) for r in rows)


def test_one_change_at_a_time(spark):
    base = [plan("a"), plan("b", 20.0)]
    with_a = lambda **k: [plan("a", **k), base[1]]
    assert events(spark, base, base) == []
    assert events(spark, base, with_a(price=12.0)) == [("price_increase", "monthly_price", 0.95, True)]
    assert events(spark, base, with_a(price=120.0)) == [("price_increase", "monthly_price", 0.285, False)]
    assert events(spark, base, with_a(price=40.0)) == [("price_increase", "monthly_price", 0.95, True)]
    assert events(spark, base, with_a(price=9.992)) == [] and events(spark, base, with_a(price=10.019)) == []
    assert events(spark, with_a(price=100.0), with_a(price=101.0)) == [("price_increase", "monthly_price", 0.95, True)]
    assert events(spark, base, with_a(price=0.0)) == [("price_decrease", "monthly_price", 0.285, False)]
    assert events(spark, with_a(price=0.0), base) == [("price_increase", "monthly_price", 0.95, True)]
    assert events(spark, base, with_a(annual=8.0)) == [("price_availability_changed", "annual_price_per_month", 0.665, False)]
    assert events(spark, base, with_a(seat=True)) == [("billing_model_changed", "is_per_seat", 0.76, False)]
    assert events(spark, base, with_a(custom=True)) == [("custom_pricing_changed", "is_custom_pricing", 0.95, True)]
    assert events(spark, base, with_a(name="A+")) == [("plan_renamed", "name", 0.95, True)]
    assert events(spark, with_a(limits={"x": 1.0, "y": 1.0}), with_a(limits={"x": 2.0, "z": 1.0})) == [("limit_changed", "x", 0.855, True)]
    assert events(spark, with_a(features=["p"]), with_a(features=["q"])) == [("feature_added", "features", 0.57, False), ("feature_moved_out", "features", 0.57, False)]
    assert events(spark, base, [*base, plan("c")]) == [("plan_added", "", 0.95, True)]
    assert events(spark, base, base[:1]) == [("plan_removed", "", 0.85, True)]
    assert events(spark, base, base, now=("USD", False, "")) == [("pricing_hidden", "", 0.95, True)]
    assert events(spark, base, base, was=("USD", None, "")) == [("pricing_published", "", 0.95, True)]
    assert events(spark, base, with_a(price=99.0), now=("EUR", True, "")) == [("currency_changed", "currency", 0.38, False)]
    emptied = events(spark, base, with_a(price=12.0), now=("", True, ""))
    assert emptied == [("currency_changed", "currency", 0.34, False), ("price_increase", "monthly_price", 0.85, True)]
    assert events(spark, base, with_a(price=12.0), now=("USD", True, "unsure")) == [("price_increase", "monthly_price", 0.8, True)]


def test_last_duplicate_wins(spark):
    dup = [("a", 0, "A", 1.0, None, False, False, {}, []), ("a", 1, "A", 5.0, None, False, False, {}, []), ("b", 2, "b", 1.0, None, False, False, {}, [])]
    assert events(spark, dup, [plan("a", 5.0, name="A"), plan("b", 1.0)]) == []


def automaton(prints):
    base = held = None
    out = []
    for i, p in enumerate(prints):
        if base is None:
            base = p
        elif p == base:
            held = None
        elif p == held:
            out.append((i, base, p))
            base, held = p, None
        else:
            held = p
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=30, max_size=60))
def test_confirmation_equals_a_loop(spark, histories):
    rows = [(k, i, p) for k, prints in enumerate(histories) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "vendor int, seq int, print int")
    got = sorted(tuple(r) for r in confirm_changes(df, "vendor", "seq", "print").collect())
    assert got == sorted((k, *e) for k, prints in enumerate(histories) for e in automaton(prints))


@given(st.lists(st.integers(0, 2), max_size=20))
def test_stream_step_equals_the_batch_fold(prints):
    state, out = (None, None, None), []
    for i, p in enumerate(prints):
        state, outcome, old = step(state, f"h{p}", f"f{p}", strict=False)
        if outcome == "change":
            out.append((i, old, f"f{p}"))
    assert out == [(i, f"f{a}", f"f{b}") for i, a, b in automaton(prints)]


def test_strict_gate_never_confirms_an_unchanged_page():
    state = (None, None, None)
    outcomes = []
    for p in "abbb":
        state, outcome, _ = step(state, p, p, strict=True)
        outcomes.append(outcome)
    assert outcomes == ["new", "hold", "same", "same"]
