"""Session helpers: reading tables, shared storage for cut lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to have at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_stashed: dict[str, SparkSession] = {}


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_by_code = spark.sparkContext.getCheckpointDir()
        if not set_by_code:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            local = tempfile.mkdtemp(prefix="evtide-")
            atexit.register(shutil.rmtree, local, True)
            spark.sparkContext.setCheckpointDir(local)
            set_by_code = spark.sparkContext.getCheckpointDir()
        root = set_by_code
    return root.rstrip("/")


def stash(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there and an executor may be lost.

    Smaller than checkpoint(), which stores rows uncompressed. Removed by discard(), else when the driver's process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/evtide-{name}-{uuid.uuid4().hex}"
    _stashed[path] = spark
    return path


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more; other DataFrames are passed over."""
    for df in tables:
        path = getattr(df, "_stashed_at", None)
        if path and (spark := _stashed.pop(path, None)):
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    for path, spark in _stashed.items():
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcasting only if it has at most so many rows and bytes (as JSON); else leave the join to shuffle.

    Counting stops at rows. It runs df's plan: a costly one should be stashed before.
    """
    least = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("size")).first()
    return F.broadcast(df) if least.n <= rows and (least["size"] or 0) <= size else df


#: The white space of Unicode.
WHITE_SPACE = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(value: Column) -> Column:
    """Without white space of any kind around."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def clean_key(value: Column) -> Column:
    """Without white space around and in lower case."""
    return F.lower(stripped(value))


#: Texts that stand for "nothing known".
STAND_INS = ("", "n/a", "unknown", "none", "-", "null", "tbd")


def stand_in(cleaned: Column) -> Column:
    """True for blanks, the fixed stand-ins and identifiers of zeros only."""
    return cleaned.isin(*STAND_INS) | cleaned.rlike("^0+$")
