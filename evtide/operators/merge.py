"""Policies that merge the records of a cluster into one, as single aggregations.

idx is a column (or struct) that orders the records as they were first met: "first" never depends on row order. Each
policy combines map-side; values that say nothing are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: dates' precisions from fine to coarse.
PRECISION = {"day": 4, "month": 3, "quarter": 2, "year": 1, "approximate": 1, "unknown": 0}


def telling(value: Column) -> Column:
    """value unless it is null, "unknown" or empty."""
    return F.when(value.isNotNull() & ~value.cast("string").isin("unknown", "", "[]"), value)


def majority(df: DataFrame, key: str, value: str, idx: Column) -> DataFrame:
    """(key, value): the most frequent telling value, of equally frequent ones the first met; null if there is none."""
    counted = df.select(key, telling(F.col(value)).alias(value), idx.alias("_i")).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i"))
    order = F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("n"), "_i"))
    return counted.groupBy(key).agg(F.min_by(value, order).alias(value))


def latest(value: Column, day: Column, idx: Column) -> Column:
    """The telling value of the latest day (null days first of all); of equals the first met."""
    told = telling(value)
    return F.min_by(value, F.when(told.isNotNull(), F.struct((-F.coalesce(F.unix_date(day), F.lit(-1_000_000))).alias("d"), idx.alias("i"))))


def longest(value: Column, day: Column, idx: Column) -> Column:
    """The longest telling value; of equals that of the latest day, then the first met."""
    told = telling(value)
    return F.min_by(value, F.when(told.isNotNull(), F.struct((-F.length(value)).alias("n"), (-F.coalesce(F.unix_date(day), F.lit(-1_000_000))).alias("d"), idx.alias("i"))))


def any_true(flag: Column) -> Column:
    """True if any is, else false if any is, else null."""
    return F.bool_or(flag)


def best_date(value: Column, precision: Column, day: Column, idx: Column) -> Column:
    """The date of the finest precision; of equals that of the earliest article day, or the last met if none has one."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRECISION.items() for x in kv])[precision], F.lit(0))
    order = F.struct(rank.alias("p"), day.isNotNull().alias("k"), (-F.coalesce(F.unix_date(day), F.lit(0))).alias("d"))
    first = F.min_by(value, F.when(value.isNotNull() & day.isNotNull(), F.struct((-rank).alias("p"), F.unix_date(day).alias("d"), idx.alias("i"))))
    best = F.max(F.when(value.isNotNull(), rank))
    best_dated = F.max(F.when(value.isNotNull() & day.isNotNull(), rank))
    last = F.max_by(value, F.when(value.isNotNull(), F.struct(order.alias("o"), idx.alias("i"))))
    return F.when(best_dated == best, first).otherwise(last)


def latest_money(amount: Column, currency: Column, scale: Column, day: Column, idx: Column) -> Column:
    """The struct (amount, currency, scale) of the latest day with an amount; of equals the first met."""
    order = F.when(amount.isNotNull(), F.struct((-F.coalesce(F.unix_date(day), F.lit(-1_000_000))).alias("d"), idx.alias("i")))
    return F.min_by(F.struct(amount.alias("amount"), currency.alias("currency"), scale.alias("scale")), order)


def company_list(members: DataFrame, key: str, name: str, fields: list[str], idx: Column) -> DataFrame:
    """One row per (key, name): each field from the first member that has it. members without a name are ignored."""
    filled = [F.min_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), idx)).alias(f) for f in fields]
    return members.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(key, name).agg(*filled)


def slots(df: DataFrame, key: str, slot: Column, names: dict[str, str], value: str, idx: Column) -> DataFrame:
    """One row per key with a column per slot: the first value met in it. names: slot to column."""
    return df.groupBy(key).agg(*[F.min_by(value, F.when(slot == s, idx)).alias(c) for s, c in names.items()])
