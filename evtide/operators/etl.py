"""Corpus and answer pipelines: attestation funnel, candidate windows, packing, answer repair, resumption, batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_ARTICLES = 10
#: Days before and after an event of each type in which articles are candidates.
WINDOWS = {"M&A_announce": (7, 14), "M&A_complete": (7, 90), "M&A_cancel": (7, 30), "M&A_rumor": (14, 14), "CEO_change": (14, 60), "CFO_change": (14, 60), "IPO": (7, 60), "Stock_split": (7, 14)}
#: Legal forms at the end of a name.
LEGAL_END = r"(?:[ ,]+(?:incorporated|inc|corporation|corp|company|co|limited|ltd|plc|llc|lp|ag|sa|nv|gmbh|group|holdings|holding)\.?)+$"


def plain_name(name: Column) -> Column:
    """A firm's name in lower case without brackets, what follows a comma, double blanks and legal forms at the end; null if nothing is left."""
    n = F.regexp_replace(F.lower(name), r"\([^)]*\)", "")
    n = F.trim(F.regexp_replace(F.split_part(n, F.lit(","), F.lit(1)), r"\s+", " "))
    return F.nullif(F.regexp_replace(F.regexp_replace(n, LEGAL_END, ""), r"^[ .,]+|[ .,]+$", ""), F.lit(""))


#: First words that many firms share.
COMMON_FIRST = ("the", "new", "american", "united", "global", "national", "first", "general", "international", "an", "a")


def name_forms(name: Column) -> Column:
    """The forms under which a title may name a firm: the plain name, its first two words, and its first word if it is long and telling enough. Empty for null."""
    plain = plain_name(name)
    words = F.split(plain, " ")
    first = F.get(words, F.lit(0))
    forms = F.array(plain, F.when(F.size(words) >= 2, F.concat_ws(" ", first, F.get(words, F.lit(1)))), F.when((F.length(first) >= 4) & ~first.isin(*COMMON_FIRST), first))
    return F.array_distinct(F.filter(forms, lambda x: F.length(x) >= 3))


def linked_articles(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Funnel levels 0 and 1 per event: linked articles, and those whose title names the firm. events (event_id, name), articles (event_id, url, title)."""
    named = events.select("event_id", name_forms(F.col("name")).alias("forms")).distinct()
    joined = named.join(articles.select("event_id", "url", "title").distinct(), "event_id", "left")
    hit = F.coalesce(F.exists("forms", lambda f: F.contains(F.lower("title"), f)), F.lit(False))
    return joined.groupBy("event_id").agg(F.countDistinct("url").alias("l0"), F.count_distinct(F.when(hit, F.col("url"))).alias("l1"))


def nearest(articles: DataFrame, k: int = TOP_ARTICLES) -> DataFrame:
    """The k articles of each event that are nearest in days, by days_to_event or else the days between day and event_day if there are such columns; unknown distances come last, ties by article."""
    known = [F.abs("days_to_event"), *([F.abs(F.datediff("day", "event_day"))] if {"day", "event_day"} <= set(articles.columns) else [])]
    order = Window.partitionBy("event_id").orderBy(F.coalesce(*known, F.lit(99999)), "article_id")
    return articles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def verdicts(judged: DataFrame, events: DataFrame) -> DataFrame:
    """The judgement of each event of its judged articles (event_id, verdict): covered by one YES; absent if all of the top ones said NO or failed; else uncertain. Without articles: absent."""
    said = lambda v: F.count_if(F.col("verdict").startswith(v))
    counted = judged.groupBy("event_id").agg(said("YES").alias("yes"), said("NO").alias("no"), said("ERROR").alias("err"), F.count(F.lit(1)).alias("n"))
    final = F.when(F.col("n").isNull(), "absent").when(F.col("yes") >= 1, "covered").when(F.col("no") >= TOP_ARTICLES - F.col("err"), "absent").otherwise("uncertain")
    return events.select("event_id").distinct().join(counted, "event_id", "left").select("event_id", F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"), final.alias("verdict"))


def unanimous(votes: DataFrame, judges: int = 3) -> DataFrame:
    """The pairs that all judges said yes to. votes: (event_id, article_id, judge, yes)."""
    counted = votes.groupBy("event_id", "article_id").agg(F.count_distinct("judge").alias("n"), F.bool_and("yes").alias("yes"))
    return counted.where((F.col("n") == judges) & F.col("yes")).select("event_id", "article_id")


def candidates(events: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, url, days): articles with the event's ticker inside its type's window, the nearest mention of each url. events (event_id, event_type, ticker, day), articles (ticker, url, day)."""
    e = events.join(F.broadcast(events.sparkSession.createDataFrame([(t, a, b) for t, (a, b) in WINDOWS.items()], "event_type string, before int, after int")), "event_type")
    a = articles.select(F.col("ticker").alias("t"), "url", F.col("day").alias("published"))
    days = F.datediff("published", "day")
    pairs = e.join(a, (F.col("ticker") == F.col("t")) & days.between(-F.col("before"), F.col("after")))
    return pairs.groupBy("event_id", "url").agg(F.min(F.abs(days)).cast("bigint").alias("days"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def pack_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """The chunks of each question that fit a budget: first one per event, the smallest rank first, then round by round; a chunk too big is skipped.

    chunks: (qid, event_id, url, rank, tokens). Sequential within a question. A chunk that several events share counts once.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, rows in zip(pdf["qid"], pdf["rows"], strict=True):
                left, taken, covered = budget, {}, set()
                for first in (True, False):
                    for r in rows:
                        if first and r["event_id"] in covered or not first and r["url"] in taken:
                            continue
                        if r["url"] in taken:
                            covered.add(r["event_id"])
                        elif r["tokens"] <= left:
                            left -= r["tokens"]
                            taken[r["url"]] = len(taken)
                            covered.add(r["event_id"])
                out += [(qid, url, i) for url, i in taken.items()]
            yield pd.DataFrame(out, columns=["qid", "url", "position"], dtype=object)

    kind = dict(chunks.dtypes)
    lists = chunks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "url", "tokens"))).alias("rows"))
    return lists.mapInPandas(pack, f"qid {kind['qid']}, url {kind['url']}, position int")


def json_slice(text: Column) -> Column:
    """What a model's answer holds of JSON: without code fences, from the first [ to the last ], else from the first { to the last }."""
    bare = F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    array = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.nullif(array, F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def infer(df: DataFrame, prompt: str, client: Callable[[], Callable[[list[str]], list[str]]], key: str) -> DataFrame:
    """(key, answer): an external model called once per Arrow batch; client() makes the callable on each worker."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": ask(list(pdf[prompt]))})

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def replay(todo: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Recorded answers instead of calls; fails if one is missing."""
    joined = todo.join(recorded, key, "left")
    return joined.withColumn("answer", F.when(F.col("answer").isNull(), F.raise_error(F.concat(F.lit("no recorded answer for "), F.col(key).cast("string")))).otherwise(F.col("answer")))


def valid_answers(answers: DataFrame, required: list[str], nullable: list[str], seen: DataFrame | None = None) -> DataFrame:
    """answers (qid, columns, cited_urls) with valid: required columns filled, no others but the nullable ones, urls cited and, if seen (qid, url) is given, all of them seen."""
    extra = [c for c in answers.columns if c not in {"qid", "cited_urls", *required, *nullable}]
    ok = F.size("cited_urls") > 0
    for c in required:
        ok = ok & F.col(c).isNotNull()
    for c in extra:
        ok = ok & F.col(c).isNull()
    if seen is None:
        return answers.withColumn("valid", F.coalesce(ok, F.lit(False)))
    row = answers.withColumn("_row", F.sha2(F.to_json(F.struct(*answers.columns), {"ignoreNullFields": "false"}), 256)).distinct()
    cited = row.select("_row", "qid", F.explode(F.array_distinct("cited_urls")).alias("url"))
    unseen = cited.join(seen.select("qid", "url").distinct(), ["qid", "url"], "left_anti").select("_row").distinct().withColumn("_unseen", F.lit(True))
    return row.join(unseen, "_row", "left").withColumn("valid", F.coalesce(ok, F.lit(False)) & F.col("_unseen").isNull()).drop("_row", "_unseen")


def looked_up(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """rows joined to reference on key; the job fails if a key is missing there."""
    joined = rows.join(reference.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no reference row for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("_there", F.when(F.col("_there"), F.col("_there")).otherwise(missing)).where("_there").drop("_there")
