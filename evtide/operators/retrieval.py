"""Lexical and dense retrieval, rank fusion, grouping and reranking over stated query sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evtide.runtime import broadcast_if_small, stash

K1, B, RRF_K = 1.2, 0.75, 60
#: Characters up to which a text stays whole; length and step of the windows of longer ones.
WHOLE, WINDOW, STEP = 6000, 5000, 4000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def windows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, chunk, start, chunk_text): fixed windows with overlap of each text; null texts give none."""
    n = F.length(text)
    last = F.when(n > WHOLE, F.ceil((n - WINDOW) / STEP)).otherwise(0).cast("int")
    each = df.where(F.col(text).isNotNull()).select(id_column, text, n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    size = F.when(F.col("n") > WHOLE, WINDOW).otherwise(WHOLE)
    return each.select(id_column, "chunk", (F.col("chunk") * STEP).alias("start"), F.substring(text, F.col("chunk") * STEP + 1, size).alias("chunk_text"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each query; docs (doc, text), queries (qid, text).

    Document frequencies and lengths cover all documents; postings are kept for the terms of the queries only, filtered
    before any shuffle where the terms are few. Scores are rounded to six digits, ties go to the smaller doc.
    """
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    bags = docs.where("text is not null").select("doc", tokens(F.col("text")).alias("bag"))
    lengths = bags.select("doc", F.size("bag").alias("dl"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    wanted = broadcast_if_small(terms.select("term").distinct())
    postings = stash(bags.select("doc", F.size("bag").alias("dl"), F.explode("bag").alias("term")).join(wanted, "term").groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf")), "postings")
    idf = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = postings.join(broadcast_if_small(idf), "term").select("term", "doc", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (stats.avgdl or 1.0)))).alias("w"))
    scored = weighted.join(broadcast_if_small(terms), "term").groupBy("qid", "doc").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best (qid, doc, score) of each query with their rank; partial tops are taken before the shuffle."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v with unit length; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank): exact cosine search of a stated query set; vectors (doc, v), queries (qid, v), a query doesn't find itself."""
    pairs = vectors.join(broadcast_if_small(queries.select("qid", F.col("v").alias("q")), 20_000), F.col("doc") != F.col("qid"))
    return top_k(pairs.select("qid", "doc", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score")), k)


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, doc, score): reciprocal rank fusion of rankings (qid, doc, rank)."""
    parts = None
    for r in rankings:
        part = r.select("qid", "doc", (F.lit(1.0) / (k + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", "doc").agg(F.round(F.sum("s"), 9).alias("score"))


def best_per_group(ranked: DataFrame, group: str, k: int) -> DataFrame:
    """The best row of each group of each query (qid, doc, score, group), then the k best groups."""
    one = Window.partitionBy("qid", group).orderBy(F.desc("score"), "doc")
    return top_k(ranked.withColumn("_i", F.row_number().over(one)).where("_i = 1").drop("_i"), k)


def rerank(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """The k best (qid, doc) by an external scorer of (query_text, doc_text), called per Arrow batch; its errors are not hidden."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf["qid"], "doc": pdf["doc"], "score": scorer(pdf["query_text"], pdf["doc_text"]).astype(float)})

    kinds = dict(pairs.dtypes)
    return top_k(pairs.select("qid", "doc", "query_text", "doc_text").mapInPandas(score, f"qid {kinds['qid']}, doc {kinds['doc']}, score double"), k)


def word_overlap(query: pd.Series, text: pd.Series) -> pd.Series:
    """A deterministic offline scorer: the part of the query's words that the text holds."""
    return pd.Series([len((q := set(a.lower().split())) & set(b.lower().split())) / max(len(q), 1) for a, b in zip(query, text, strict=True)])


def roles(df: DataFrame) -> dict[str, str]:
    """Which columns of a collection hold vectors, dates and term weights, by their types; ValueError without a vector."""
    kinds = dict(df.dtypes)
    found = {"vector": next((c for c, k in kinds.items() if k in ("array<float>", "array<double>")), ""), "sparse": next((c for c, k in kinds.items() if k.startswith("map<")), "")}
    dates = [(c, k) for c, k in kinds.items() if "date" in c.lower()]
    found["date"] = dates[0][0] if dates else ""
    found["date_format"] = {"int": "yyyymmdd", "bigint": "yyyymmdd"}.get(dates[0][1], "iso") if dates else ""
    if not found["vector"]:
        raise ValueError("no vector column")
    return found


def cached_ranking(cache: DataFrame, k: int) -> DataFrame:
    """A stored ranking (qid, doc, score, rank) cut to k; ValueError if it was made with fewer places."""
    stored = cache.agg(F.max("rank")).first()[0]
    if stored is not None and stored < k:
        raise ValueError(f"the cache holds {stored} places per query, {k} are wanted")
    return cache.where(F.col("rank") <= k)


def search_rounds(ranking: DataFrame, per_round: int, rounds: int) -> list[DataFrame]:
    """The rows of each round of a search that never shows a document twice to one query: the next unseen places of its ranking."""
    return [ranking.where((F.col("rank") > r * per_round) & (F.col("rank") <= (r + 1) * per_round)).withColumn("round", F.lit(r + 1)) for r in range(rounds)]
