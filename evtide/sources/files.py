"""JSON lines, JSON documents and CSV corpora in; JSON lines and one file per entity out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.sources.schema import ANSWER, EXTRACTION


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file or folder: .jsonl (also compressed) line by line, .json as documents or arrays of them; blank and broken lines are passed over."""
    lines = not path.rstrip("/").endswith(".json")
    mode = {"mode": "DROPMALFORMED"}
    return spark.read.schema(schema).options(**mode).json(path) if lines else spark.read.schema(schema).options(**mode).json(path, multiLine=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines with their place, for rules such as "the last one wins": by the file's name, the block of the file and the line inside it."""
    raw = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"), "value")
    return raw.where(F.trim("value") != "").select(F.col("file_path").alias("file"), F.struct("file_path", "file_block_start", "line").alias("at"), "value")


def last_per_key(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record of each key in a file of JSON lines; records without a key and broken lines are left out."""
    parsed = lines(spark, path).select("at", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answer, number): the last prediction of each question; a whole number as the answer comes as number."""
    raw = last_per_key(spark, path, "qid string, answer string", "qid")
    return raw.select("qid", F.from_json("answer", f"array<{ANSWER}>").alias("answer"), F.trim("answer").try_cast("bigint").alias("number"))


def legacy_predictions(text: DataFrame) -> DataFrame:
    """(qid, answer) of three older shapes: an object by question, a list of predictions, or one under "predictions". text: (value)."""
    flat = F.from_json("value", "map<string,string>")
    listed = F.from_json("value", "array<struct<qid:string,answer:string>>")
    nested = F.from_json(F.get_json_object("value", "$.predictions"), "array<struct<qid:string,answer:string>>")
    as_list = F.transform(F.map_entries(flat), lambda e: F.struct(e["key"].alias("qid"), e["value"].alias("answer")))
    every = text.select(F.coalesce(nested, F.when(F.trim("value").startswith("["), listed), as_list).alias("x"))
    return every.select(F.explode("x").alias("x")).select("x.qid", "x.answer").where("qid is not null")


def csv_corpus(spark: SparkSession, path: str, required: tuple[str, ...] = ("article_url", "article_date", "title", "text")) -> DataFrame:
    """A corpus of articles, all columns text, nulls empty; the last row of an url counts. ValueError if a column is missing."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    if missing := set(required) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    placed = df.na.fill("").withColumn("_at", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")))
    return placed.groupBy("article_url").agg(F.max_by(F.struct(*[c for c in df.columns if c != "article_url"]), "_at").alias("r")).select("article_url", "r.*")


def extraction_records(spark: SparkSession, path: str) -> DataFrame:
    """(rid, article_id, article_date, title, url, event): one row per extracted event of articles that went well, in a reproducible order."""
    articles = json_records(spark, path, EXTRACTION).where("ok")
    events = articles.select("article_id", F.to_date(F.try_to_timestamp(F.substring("article_date", 1, 10), F.lit("yyyy-MM-dd"))).alias("article_date"), "title", F.posexplode("parsed_events_all").alias("pos", "event")).where("event is not null")
    return events.select(F.concat_ws("#", "article_id", F.lpad(F.col("pos").cast("string"), 5, "0")).alias("rid"), "article_id", "article_date", "title", F.col("event.source_article.url").alias("url"), "event")


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_per_entity(df: DataFrame, path: str, entity: str) -> None:
    """A folder per entity, each with its JSON; rows of one entity are brought together first."""
    df.repartition(entity).write.mode("overwrite").partitionBy(entity).json(path)
