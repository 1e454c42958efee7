"""Many small files of JSON records consolidated into few well-sized ones.

The manifest (one row per file) is frozen, ordered and summed in SQL; a file's group is the target-sized interval that
its first byte falls into. The records are rewritten group by group and the counts reconciled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.runtime import broadcast_if_small, read, shared_path, stash

#: Bytes of content per group: so much, but not more than a LEAST_GROUPS-th of all content, and at least SMALLEST.
LARGEST, SMALLEST, LEAST_GROUPS = 128 << 20, 1 << 20, 8
#: Files per range of the manifest's order: what one task sums.
FILES_PER_RANGE = 100_000


def target_bytes(manifest: DataFrame) -> int:
    total = manifest.agg(F.sum(F.greatest("n_bytes", F.lit(0)))).first()[0] or 0
    return max(SMALLEST, min(LARGEST, -(-total // LEAST_GROUPS)))


def plan_groups(manifest: DataFrame, target: int | None = None) -> DataFrame:
    """(file_id, n_bytes, grp): groups of about target bytes (null: target_bytes), in the order of the paths.

    A file is never split: a larger one makes its group larger. Null sizes count as 0. The manifest is frozen in ranges
    of its order, cut by number of files wherever folders begin or end; the prefix sums run inside each range and start
    where the ranges before end.
    """
    spark = manifest.sparkSession
    target = target or target_bytes(manifest)
    ranges = max(1, -(-manifest.count() // FILES_PER_RANGE))
    manifest.createOrReplaceTempView("evtide_manifest")
    frozen = spark.sql(
        f"""
        SELECT *, spark_partition_id() AS r FROM (SELECT /*+ REPARTITION_BY_RANGE({ranges}, path, file_id) */ * FROM (
            SELECT file_id, greatest(coalesce(n_bytes, 0), 0) AS n_bytes, coalesce(file_path, '') AS path FROM evtide_manifest))
        """
    )
    stash(frozen, "manifest").createOrReplaceTempView("evtide_frozen")
    return spark.sql(
        f"""
        WITH sums AS (SELECT r, sum(n_bytes) AS total FROM evtide_frozen GROUP BY r),
        starts AS (SELECT r, coalesce(sum(total) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sums),
        inside AS (SELECT *, sum(n_bytes) OVER (PARTITION BY r ORDER BY path, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_bytes AS first FROM evtide_frozen)
        SELECT file_id, n_bytes, cast((start + first) DIV {target} AS bigint) AS grp FROM inside JOIN starts USING (r)
        """
    )


def whole_records(content: str) -> Iterator[tuple[str, int | None, str]]:
    """(article_id, attempt, JSON as it stands) of each complete object with an article_id in a file's content.

    Lines, arrays and pretty-printed objects alike; what is broken off or no JSON is passed over, and so are objects
    without an id. Objects inside another record belong to it; inside anything else they are records themselves.
    """
    decode, at, n = json.JSONDecoder().raw_decode, content.find("{"), len(content)
    while at >= 0:
        try:
            value, end = decode(content, at)
        except (ValueError, RecursionError):
            value, end = {}, at + 1
        key = value.get("article_id")
        if isinstance(key, (str, int)) and not isinstance(key, bool) and str(key).strip():
            yield str(key).strip(), _whole(value.get("attempt")), content[at:end]
        else:  # a brace inside a string can't begin an object with a key
            end = at + 1
        at = content.find("{", end) if end < n else -1


def _whole(value: object) -> int | None:
    try:
        return None if isinstance(value, bool) else int(float(str(value).strip()))
    except (ValueError, OverflowError):
        return None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(g, i, *r) for g, i, c in zip(pdf["grp"], pdf["file_id"], pdf["content"], strict=True) for r in whole_records(c)]
        out = pd.DataFrame(rows, columns=["grp", "file_id", "article_id", "attempt", "record"])
        yield out.astype({"attempt": "Int64"})


def records_of(files: DataFrame, target: int | None = None) -> DataFrame:
    """(grp, file_id, article_id, attempt, record) of every file; files without content give none."""
    groups = plan_groups(files.select("file_id", "file_path", "n_bytes"), target)
    contents = files.select("file_id", "content").where("content is not null and content like '%{%'")
    return contents.join(broadcast_if_small(stash(groups.select("file_id", "grp"), "groups")), "file_id").mapInPandas(_parsed, "grp bigint, file_id bigint, article_id string, attempt bigint, record string")


def compact(files: DataFrame, path: str | None = None, target: int | None = None) -> DataFrame:
    """Rewrite all whole records to one Parquet file per group, equal (article_id, attempt) once, and read them back.

    files: (file_id unique, file_path, n_bytes, content). Records keep their bytes. Of records alike in article_id and
    attempt the longest is kept, of those one by its hash; records without an attempt have null there. An empty manifest
    gives no rows. Raises ValueError if the rewritten records are not exactly the chosen ones of those that were read.
    """
    spark = files.sparkSession
    parsed = stash(records_of(files, target), "records")
    best = F.max_by(F.struct("grp", "record"), _preference())
    unique = parsed.groupBy("article_id", "attempt").agg(best.alias("x")).select("x.grp", "article_id", "attempt", "x.record")
    groups = (parsed.agg(F.max("grp")).first()[0] or 0) + 1
    path = path or shared_path(spark, "compacted")
    unique.repartitionById(groups, F.col("grp").cast("int")).sortWithinPartitions("article_id", "attempt").write.mode("overwrite").parquet(path)
    back = spark.read.schema("grp bigint, article_id string, attempt bigint, record string").parquet(path)
    reconcile(parsed, back)
    return back


def _preference() -> Column:
    return F.struct(F.octet_length("record").alias("n"), F.xxhash64("record").alias("h"))


def reconcile(before: DataFrame, after: DataFrame) -> None:
    """Raise unless after holds the preferred record of each (article_id, attempt) of before exactly once, byte for byte: by number and checksum of keys and contents."""
    total = lambda h: F.sum(F.xxhash64("article_id", F.coalesce("attempt", F.lit(-1)), h["n"], h["h"]).cast("decimal(38,0)"))
    count = F.count(F.lit(1)).alias("n")
    want = before.groupBy("article_id", "attempt").agg(F.max(_preference()).alias("p")).agg(count, total(F.col("p")).alias("h")).first()
    have = after.withColumn("p", _preference()).agg(count, total(F.col("p")).alias("h")).first()
    if want != have:
        raise ValueError(f"{want.n} records read, {have.n} rewritten, or others")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return compact(read(spark, base, "article_files")).select("article_id", "attempt")


def p5_plan(spark: SparkSession, base: str) -> DataFrame:
    """The groups that p5_found writes, with their files and bytes."""
    groups = plan_groups(read(spark, base, "article_files").select("file_id", "file_path", "n_bytes"))
    return groups.groupBy("grp").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("bytes"))
