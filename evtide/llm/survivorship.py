"""One surviving record per duplicate group, field by field, in a single aggregation over composite structs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.runtime import broadcast_if_small, clean_key, read, stripped

#: Precision names, finest first; names not listed come last.
PRECISION_RANK = {"day": 0, "month": 1, "quarter": 2, "year": 3, "approximate": 3}
OTHER_PRECISION = 4


@dataclass(frozen=True)
class Field:
    """A field of the surviving record: who may supply it, the rank of a supplier (smaller is better), and the value."""

    name: str
    usable: Column
    rank: Column
    value: Column


def survivors(members: DataFrame, group: str, member: str, recency: str, fields: list[Field]) -> DataFrame:
    """One row per group: for each field a struct f(member, value) of its best supplier, or null where no member can.

    Best: the smallest rank, then the latest recency (null is earliest), then the smallest member. Repeated rows change
    nothing; rows with a null group or member are ignored; extra columns are not used; an empty table gives no rows.
    The minimum of one struct per field combines map-side, so a group of any size costs one row per task.
    """
    latest = -F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(1 << 62)))
    best = [F.min(F.when(f.usable, F.struct(f.rank.alias("rank"), latest.alias("age"), F.col(member).alias("member"), f.value.alias("value")))).alias(f.name) for f in fields]
    merged = members.where(F.col(group).isNotNull() & F.col(member).isNotNull()).groupBy(group).agg(*best)
    return merged.select(group, *[F.when(F.col(f.name).isNotNull(), F.struct(F.col(f.name)["member"].alias("member"), F.col(f.name)["value"].alias("value"))).alias(f.name) for f in fields])


def longest_headline(summaries: Column) -> Column:
    """The longest non-blank string (trimmed) of a valid JSON array, the first of equally long ones; null if there is none."""
    whole = F.when(F.endswith(stripped(summaries), F.lit("]")), summaries)
    items = F.transform(F.from_json(whole, "array<string>", {"allowSingleQuotes": "false"}), stripped)
    longest = F.array_max(F.transform(items, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.when(longest["n"] > 0, longest["x"])


def event_members(events: DataFrame, details: DataFrame, groups: DataFrame, values: bool = True) -> DataFrame:
    """The members of each group with the few derived columns the survivorship needs, derived before any shuffle; values: with the texts themselves, not only their ranks.

    Where the members are few enough to broadcast, all other events go before their headlines are parsed.
    """
    groups = groups.select("group_id", "event_id").where("group_id is not null and event_id is not null").distinct()
    ids = groups.select("event_id").distinct()
    few = broadcast_if_small(ids)
    of_members = lambda df: df if few is ids else df.join(few, "event_id", "left_semi")
    precision = F.coalesce(F.create_map(*[F.lit(x) for kv in PRECISION_RANK.items() for x in kv])[clean_key(F.col("event_date_precision"))], F.lit(OTHER_PRECISION))
    headline = longest_headline(F.col("headline_summaries"))
    texts = [clean_key(F.col("event_date_precision")).alias("precision_name"), headline.alias("headline")] if values else []
    slim = of_members(events).select("event_id", "loaded_at", F.col("event_date_value").alias("day"), precision.alias("precision"), F.length(headline).alias("headline_length"), F.col("raw_extraction_count").alias("extraction"), *texts)
    amount = F.col("deal_value_amount")
    deal = F.struct(F.col("deal_value_amount").alias("amount"), F.col("deal_value_currency").alias("currency"), F.col("deal_value_scale").alias("scale"), F.col("deal_value_text").alias("text"))
    deals = of_members(details).where((amount > 0) & ~F.isnan(amount)).groupBy("event_id").agg((F.max(deal) if values else F.bool_or(F.lit(True))).alias("deal"))
    return groups.join(slim, "event_id").join(deals, "event_id", "left")


def best_records(events: DataFrame, details: DataFrame, groups: DataFrame, values: bool = True) -> DataFrame:
    """The surviving record of each group: event_date (day and precision), deal_value (amount, currency, scale and text together), headline, extraction. Without values only who supplies them."""
    told = lambda c: c if values else F.lit(None).cast("string")
    fields = [
        Field("event_date", F.col("day").isNotNull(), F.col("precision"), told(F.struct("day", F.col("precision_name").alias("precision")) if values else None)),
        Field("deal_value", F.col("deal").isNotNull(), F.lit(0), told(F.col("deal"))),
        Field("headline", F.col("headline_length").isNotNull(), -F.col("headline_length"), told(F.col("headline") if values else None)),
        Field("extraction", F.col("extraction").isNotNull(), -F.col("extraction").cast("bigint"), F.col("extraction")),
    ]
    return survivors(event_members(events, details, groups, values), "group_id", "event_id", "loaded_at", fields)


def surviving(events: DataFrame, details: DataFrame, groups: DataFrame) -> DataFrame:
    """best_records flat: the date with its precision, the deal value whole, and beside each field the event that supplies it."""
    best = best_records(events, details, groups)
    supplied = lambda f: F.col(f"{f}.member").alias(f"{f}_from")
    date = [F.col("event_date.value.day").alias("event_date"), F.col("event_date.value.precision").alias("event_date_precision"), supplied("event_date")]
    deal = [F.col(f"deal_value.value.{k}").alias(f"deal_{k}") for k in ("amount", "currency", "scale", "text")]
    return best.select("group_id", *date, *deal, supplied("deal_value"), F.col("headline.value").alias("headline"), supplied("headline"), F.col("extraction.value").alias("extraction"), supplied("extraction"))


def p2_survivors(spark: SparkSession, base: str) -> DataFrame:
    return surviving(read(spark, base, "corp_events"), read(spark, base, "ma_details"), read(spark, base, "dup_group"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    best = best_records(read(spark, base, "corp_events"), read(spark, base, "ma_details"), read(spark, base, "dup_group"), values=False)
    names = ("event_date", "deal_value", "headline", "extraction")
    supplied = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n)["member"].alias("event_id")) for n in names])).alias("x")
    return best.select("group_id", supplied).select("group_id", "x.field_name", "x.event_id").where("event_id is not null")
