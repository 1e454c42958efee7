"""Answers scored against gold: strict and date-tolerant recall, provenance, order, composites and their averages.

gold and pred: (qid, firm, event_type, day, urls) and, for ordered answers, pos. Keys compare null-safe, any prediction
may match any number of gold rows unless the scorer says one to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_DAYS, TOLERANCE_SPAN = 7, 14


def lenient_date(text: Column) -> Column:
    """A date in one of four fixed notations at the start of a text, else null."""
    t = F.trim(text)
    dashed = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}([-/.])\d{1,2}\2\d{1,2})(?!\d)", 1), r"[/.]", "-")
    compact = F.regexp_replace(F.regexp_extract(t, r"^(\d{8})", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.nullif(compact, F.lit(""))).try_cast("date")


def near(a: Column, b: Column, days: int) -> Column:
    """Equal, both null, or at most so many days apart."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def list_recall(gold: DataFrame, pred: DataFrame, days: int = 0, by_position: bool = False) -> DataFrame:
    """(qid, no_prov, with_prov): the part of the gold rows that a prediction matches, and that a matching one supports with a gold url.

    Questions without gold rows are scored by empty_answer.
    """
    keys = ["firm", "event_type", *(["pos"] if by_position else [])]
    g = gold.withColumn("_g", F.struct(*keys, "day"))
    p = pred.select(F.col("qid").alias("q"), *[F.col(k).alias(f"p_{k}") for k in keys], F.col("day").alias("p_day"), F.col("urls").alias("p_urls")).distinct()
    same = F.col("qid") == F.col("q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    joined = g.join(p, same & near(F.col("day"), F.col("p_day"), days), "left")
    hit = F.col("q").isNotNull()
    cited = hit & F.coalesce(F.arrays_overlap(F.array_compact("urls"), F.array_compact("p_urls")), F.lit(False))
    rows = joined.groupBy("qid", "_g").agg(F.bool_or(hit).alias("hit"), F.bool_or(cited).alias("cited"))
    return rows.groupBy("qid").agg(F.avg(F.col("hit").cast("int")).alias("no_prov"), F.avg(F.col("cited").cast("int")).alias("with_prov"))


def composite(gold: DataFrame, pred: DataFrame, tolerant: bool) -> DataFrame:
    """(qid, score): 1 if both dates and the span agree. gold and pred: (qid, d1, d2, days); null dates never agree."""
    day, span = (TOLERANCE_DAYS, TOLERANCE_SPAN) if tolerant else (0, 0)
    p = pred.select(F.col("qid").alias("q"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("days").alias("p_days"))
    ok = (F.abs(F.datediff("d1", "p1")) <= day) & (F.abs(F.datediff("d2", "p2")) <= day) & (F.abs(F.col("days") - F.col("p_days")) <= span)
    return gold.join(p, F.col("qid") == F.col("q"), "left").groupBy("qid").agg(F.max(F.coalesce(ok, F.lit(False)).cast("double")).alias("score"))


def exact_number(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(qid, int_match, empty_check): whether the answers' counts agree, and whether an empty gold got an empty answer. Both: (qid, n)."""
    both = gold.join(pred.select(F.col("qid").alias("q"), F.col("n").alias("m")), F.col("qid") == F.col("q"), "left")
    m = F.coalesce("m", F.lit(0))
    return both.select("qid", (F.col("n") == m).cast("double").alias("int_match"), F.when(F.col("n") == 0, (m == 0).cast("double")).alias("empty_check"))


def with_missing(scores: DataFrame, questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Scores of all questions: one without an answer has 0 and no provenance score, so it leaves the latter's mean."""
    seen = answered.select("qid").distinct().withColumn("answered", F.lit(True))
    joined = questions.join(seen, "qid", "left").join(scores, "qid", "left")
    return joined.withColumns({"no_prov": F.when(F.col("answered"), F.coalesce("no_prov", F.lit(0.0))).otherwise(0.0), "with_prov": F.when(F.col("answered"), F.coalesce("with_prov", F.lit(0.0)))}).drop("answered")


def summary(scores: DataFrame) -> DataFrame:
    """Means by template, sub-axis, capability and overall in one pass; scores: (qid, id, sub_axis, cap, no_prov, with_prov)."""
    sets = scores.groupingSets([["id"], ["sub_axis"], ["cap"], []], "id", "sub_axis", "cap")
    level = F.when(F.grouping_id() == 3, "id").when(F.grouping_id() == 5, "sub_axis").when(F.grouping_id() == 6, "cap").otherwise("overall")
    out = sets.agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.avg("no_prov").alias("no_prov"), F.count("with_prov").alias("n_prov"), F.avg("with_prov").alias("with_prov"))
    return out.select("level", F.coalesce("id", "sub_axis", "cap", F.lit("all")).alias("name"), "n", "no_prov", "n_prov", "with_prov")


def one_to_one(gold: DataFrame, pred: DataFrame, days: int = 1) -> DataFrame:
    """(qid, matched, n_gold, n_extra): each prediction serves one gold row, nearest dates first within a firm and type.

    Sequential within a question, firm and type only: that is the group a task gets.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, wanted, free, n_gold, n_pred in zip(pdf["qid"], pdf["gold_days"], pdf["pred_days"], pdf["n_gold"], pdf["n_pred"], strict=True):
                free, matched = list(free) if free is not None else [], 0
                for d in wanted if wanted is not None else []:
                    best = min(((abs((x - d).days), i) for i, x in enumerate(free)), default=None)
                    if best and best[0] <= days:
                        free.pop(best[1])
                        matched += 1
                out.append((qid, matched, n_gold, n_pred - matched))
            yield pd.DataFrame(out, columns=["qid", "matched", "n_gold", "n_extra"])

    keys = ["qid", "firm", "event_type"]
    norm = lambda df, name: df.select(F.col("qid").alias("qid"), F.coalesce(F.upper("firm"), F.lit("")).alias("firm"), F.coalesce(F.lower("event_type"), F.lit("")).alias("event_type"), F.col("day").alias("day")).groupBy(*keys).agg(F.array_sort(F.collect_list("day")).alias(f"{name}_days"), F.count(F.lit(1)).alias(f"n_{name}"))
    both = norm(gold, "gold").join(norm(pred, "pred"), keys, "full").na.fill(0, ["n_gold", "n_pred"])
    each = both.select("qid", "gold_days", "pred_days", "n_gold", "n_pred").mapInPandas(match, "qid string, matched bigint, n_gold bigint, n_extra bigint")
    return each.groupBy("qid").agg(F.sum("matched").alias("matched"), F.sum("n_gold").alias("n_gold"), F.sum("n_extra").alias("n_extra"))


#: Fixed value: a judge whose chunks support no provenance.
POSTHOC_JUDGE = "posthoc_gemma_only"


def gold_urls(gold: DataFrame, chunk_columns: list[str], events: str | None = None) -> Column:
    """The sorted distinct urls of a gold row's chunks: of every chunk column, and of the chunks inside the array of events."""
    urls = [F.transform(F.coalesce(F.col(c), F.array().cast(gold.schema[c].dataType)), lambda x: x["article_url"]) for c in chunk_columns]
    if events:
        urls.append(F.flatten(F.transform(F.coalesce(F.col(events), F.array().cast(gold.schema[events].dataType)), lambda e: F.transform(F.coalesce(e["golden_chunks"], F.array().cast(gold.schema[events].dataType.elementType["golden_chunks"].dataType)), lambda x: x["article_url"]))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*urls))))


def supports_provenance(configured: Column, judge: Column) -> Column:
    return configured & ~F.coalesce(judge == POSTHOC_JUDGE, F.lit(False))
