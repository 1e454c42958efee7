from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evtide.operators import units as U

DETAILS = "event_id string, deal_value_amount double, deal_value_currency string, deal_value_scale string, deal_value_text string, per_share_price_amount double, per_share_price_text string, currency string"
NAN = float("nan")


def run(spark, rows):
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 1.09), (" gbp ", 1.27), ("JPY", 0.007), ("INR", 0.012), ("CAD", 0.74), ("CHF", 1.13), ("AUD", 0.66), ("USD", 1.0)], "currency string, usd_per_unit double")
    done = U.in_usd(spark.createDataFrame([(*r, "x") for r in rows], DETAILS), rates).collect()
    return {r.event_id: (r.deal_usd, r.price_cents) for r in done}


CASES = [
    # amount, currency, scale, text, price, price text -> dollars, cents
    ((4.0, None, None, None, 2.5, None), (4, 250)),
    ((4.0, "Stg", "bln", None, None, "3,242p per share"), (5_080_000_000, 4117)),
    ((NAN, None, None, "7,94 Mrd. EUR", NAN, "375,68 € je Aktie"), (8_654_600_000, 40949)),
    ((880.0, "USD", "million", "USD 738,000,000", None, None), (738_000_000, None)),
    ((719000.0, None, None, "amounts in USD 000s", None, None), (719_000_000, None)),
    ((None, "EUR", None, "forty million dollars", 10.0, None), (40_000_000, 1000)),
    ((None, None, None, "one and a half billion pounds sterling", None, "30 cents a share"), (1_905_000_000, 38)),
    ((None, None, None, "a quarter of a billion Canadian dollars", None, None), (185_000_000, None)),
    ((None, None, None, "three hundred million Swiss francs", None, None), (339_000_000, None)),
    ((1.0, "USD", None, "Rs 951 crore", None, "GBX 12,397"), (114_120_000, 15744)),
    ((None, None, None, "Rs. 1,00,000 lakh", None, "¥34,111 a share in cash"), (120_000_000, 23878)),
    ((None, None, None, "a US$3.5 mm all-cash offer", None, "23305 US cents per unit"), (3_500_000, 23305)),
    ((5.0, "EUR", "milion", "363 milions USD", None, None), (363_000_000, None)),
    ((0.0, "USD", "million", "terms were not disclosed", -1.0, None), (None, None)),
    ((None, None, None, None, None, None), (None, None)),
    ((NAN, "USD", None, "", NAN, ""), (None, None)),
    ((1e19, "EUR", "trillion", "USD " + "9" * 29 + " trillion", 1e19, "9" * 40 + " yen per share"), (None, None)),
    ((float("inf"), "USD", None, None, 1e300, None), (None, None)),
    ((2.0, "zorkmid", "gross", "n/a", None, "x" * 20000), (2, None)),
    ((1e20, "JPY", None, None, None, None), (700_000_000_000_000_000, None)),
    ((None, None, None, "12 bns USD", None, "3 ppence a share"), (12_000_000_000, 4)),
    ((None, None, None, "a 5 milllion eur deal, cash in time", None, None), (5_450_000, None)),
]


def test_notations(spark):
    got = run(spark, [(f"e{i:02d}", *row) for i, (row, _) in enumerate(CASES)] + [("e00", *CASES[0][0]), (None, *CASES[0][0])])
    assert got == {f"e{i:02d}": want for i, (_, want) in enumerate(CASES)}


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("text, value", [("1,234,567.5 x", "1234567.5"), ("258,53 Euro", "258.53"), ("1.234.567,5", "1234567.5"), ("12,345", "12345"), ("12.345", "12.345"), ("12.345 Mio.", "12345"), ("in 000s", None), ("none", None), ("9.", "9")])
def test_figures(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(U.figure(F.col("t"))).first()[0]
    assert got == (None if value is None else Decimal(value))


@settings(max_examples=200, deadline=None)
@given(st.text("abcs", max_size=6), st.text("abcs", max_size=6))
def test_distance_is_bounded_by_edits(a, b):
    d = U.weighted_distance(a, b)
    assert (d == 0) == (a == b) and d <= max(len(a), len(b)) and abs(d - U.weighted_distance(b, a)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["milion", "bilions", "poundss", "rupee", "sterlnig", "mmm", "crroe", "tousands", "bn", "s", "canadain"]), st.sampled_from(sorted({a for w in U.SCALES.values() for a in w.split()} | {a for w in U.CURRENCIES.values() for a in w.split()})))
def test_the_index_misses_no_pair(word, alias):
    grams = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    if U.weighted_distance(word, alias) <= U.allowed(len(word)):
        assert grams(word) & grams(alias) and abs(len(word) - len(alias)) <= U.allowed(len(word)) / U.CHEAPEST
