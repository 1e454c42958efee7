"""Typed views of the tables: events, the role junction, sources, dated role events and deals, each with its SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.runtime import clean_key, read, stand_in


@dataclass(frozen=True)
class Views:
    """events (event_id, event_type, firm, day); companies (event_id, role, ticker); sources (event_id, url); hints (event_id, hint), if there are any."""

    events: DataFrame
    companies: DataFrame
    sources: DataFrame
    hints: DataFrame | None = None


def corporate(spark: SparkSession, base: str) -> Views:
    """The corporate events; roles and sources as the articles on them state."""
    events = read(spark, base, "corp_events").select("event_id", "event_type", F.col("firm_ticker").alias("firm"), F.col("event_date_value").alias("day"))
    mna = read(spark, base, "mna")
    companies = mna.where("role is not null").select("event_id", F.when(F.col("role") == "buyer", "acquirer").otherwise(F.col("role")).alias("role"), "ticker").distinct()
    sources = mna.where("article_url is not null").select("event_id", F.col("article_url").alias("url")).distinct()
    hint = clean_key(F.col("cluster_key_hint"))
    hints = read(spark, base, "ma_details").select("event_id", F.when(~stand_in(hint), hint).alias("hint")).where("hint is not null").distinct()
    return Views(events, companies, sources, hints)


def trade(spark: SparkSession, base: str) -> Views:
    """Orders as events with a buyer, sellers and targets: a dense role junction. Tickers are prefixed, as key ranges overlap."""
    orders, lines = read(spark, base, "orders"), read(spark, base, "lineitem")
    ticker = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"), ticker("C", "o_custkey").alias("firm"), F.col("o_orderdate").cast("date").alias("day"))
    companies = orders.select(F.col("o_orderkey").alias("event_id"), F.lit("acquirer").alias("role"), ticker("C", "o_custkey").alias("ticker"))
    for role, prefix, column in (("seller", "S", "l_suppkey"), ("target", "P", "l_partkey")):
        companies = companies.unionByName(lines.select(F.col("l_orderkey").alias("event_id"), F.lit(role).alias("role"), ticker(prefix, column).alias("ticker")).distinct())
    sources = lines.select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("line/"), F.col("l_linenumber").cast("string")).alias("url")).distinct()
    return Views(events, companies, sources)


def deal_sides(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Announcements (order lines at the order date) and completions (at the ship date): (id, hint, buyer, target, day)."""
    orders = read(spark, base, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("buyer"), F.col("o_orderdate").cast("date").alias("ordered"))
    lines = read(spark, base, "lineitem").select("l_orderkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_shipdate").cast("date").alias("shipped"))
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    announced = both.select(F.col("o_orderkey").alias("hint"), "buyer", "target", F.col("ordered").alias("day")).distinct()
    completed = both.select(F.col("o_orderkey").alias("hint"), "buyer", "target", F.col("shipped").alias("day")).distinct()
    return announced, completed


#: The same views in SQL, to put before a query.
EV = "ev AS (SELECT event_id, event_type, firm_ticker AS firm, event_date_value AS day FROM corp_events)"
EC = "ec AS (SELECT DISTINCT event_id, CASE WHEN role = 'buyer' THEN 'acquirer' ELSE role END AS role, ticker FROM mna WHERE role IS NOT NULL)"
EH = """eh AS (SELECT DISTINCT event_id, lower(trim(cluster_key_hint, E' \\t\\n\\r')) AS hint FROM ma_details WHERE lower(trim(cluster_key_hint, E' \\t\\n\\r')) NOT IN ('', 'n/a', 'unknown', 'none', '-', 'null', 'tbd') AND NOT regexp_matches(trim(cluster_key_hint, E' \\t\\n\\r'), '^0+$'))"""
ES = "es AS (SELECT DISTINCT event_id, article_url AS url FROM mna WHERE article_url IS NOT NULL)"
TV = "ev AS (SELECT o_orderkey AS event_id, o_orderpriority AS event_type, 'C' || o_custkey AS firm, CAST(o_orderdate AS DATE) AS day FROM orders)"
TC = "ec AS (SELECT o_orderkey AS event_id, 'acquirer' AS role, 'C' || o_custkey AS ticker FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'seller', 'S' || l_suppkey FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'target', 'P' || l_partkey FROM lineitem)"
DEALS = """b AS (SELECT o_orderkey AS hint, 'C' || o_custkey AS buyer, 'S' || l_suppkey AS target, CAST(o_orderdate AS DATE) AS o, CAST(l_shipdate AS DATE) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
an AS (SELECT DISTINCT hint, buyer, target, o AS day FROM b), cm AS (SELECT DISTINCT hint, buyer, target, s AS day FROM b)"""
