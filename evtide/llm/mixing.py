"""Sources mixed to target weights by Pfair scheduling.

Sizes are tokens of a public tokenizer. Each source's quota is cut into blocks; block k of a source of weight w is
released at slot floor(k / w) and due at slot ceil((k + 1) / w); of the released blocks that with the earliest deadline
goes next, so at every slot each source is within one block of its share. Documents find their block by prefix sums. The
shares reached, and the targets out of reach, are those of the documents placed.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evtide.runtime import clean_key, read, stash

#: Ranks of a public byte-level tokenizer; a parameter, the file is not part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that tokenizer splits texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots of a cycle of the schedule; tokens of a block at most. A mixture of more than SLOTS such blocks is several cycles, in each of which every source gives the same part of its quota.
SLOTS, BLOCK_TOKENS = 2000, 1 << 20
#: Records per hash range for the prefix sums: no task sums a whole source, however large.
RANGE_RECORDS = 100_000


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A stretch without white space is given to the tokenizer in pieces of at most so many characters; longer ones take it quadratic time.
LONGEST_STRETCH = 20_000


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    encode = tokenizer(path).encode_ordinary
    return sum(len(encode(text[i : i + LONGEST_STRETCH])) for i in range(0, len(text), LONGEST_STRETCH)) if len(text) > LONGEST_STRETCH and max(map(len, text.split()), default=0) > LONGEST_STRETCH else len(encode(text))


def _sizes(path: str):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shipped = SparkFiles.get(os.path.basename(path))
        there = shipped if os.path.exists(shipped) else path
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "tokens": [count_tokens(t, there) for t in pdf["text"]]})

    return f


def sized(records: DataFrame, id_column: str, source_column: str, text_column: str, path: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens): sources trimmed and in lower case, '' for null; a null text has no tokens. The tokenizer's file goes from the driver to the executors."""
    if os.path.exists(path):
        records.sparkSession.sparkContext.addFile(path)
    slim = records.select(F.col(id_column).alias("id"), F.coalesce(clean_key(F.col(source_column)), F.lit("")).alias("source"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return slim.mapInPandas(_sizes(path), f"id {slim.schema['id'].dataType.simpleString()}, source string, tokens bigint")


def pfair(weights: dict[str, Fraction], slots: int) -> list[tuple[str, int]]:
    """The source and its block number of each slot, earliest deadline first; weights sum to 1, ties go to the smaller name."""
    release = [(0, s) for s in sorted(weights) if weights[s] > 0]
    heapq.heapify(release)
    done = dict.fromkeys(weights, 0)
    due: list[tuple[int, str]] = []
    out = []
    for slot in range(slots):
        while release and release[0][0] <= slot:
            _, s = heapq.heappop(release)
            heapq.heappush(due, (math.ceil((done[s] + 1) / weights[s]), s))
        if not due:
            break
        _, s = heapq.heappop(due)
        out.append((s, done[s]))
        done[s] += 1
        heapq.heappush(release, (max(slot + 1, math.floor(done[s] / weights[s])), s))
    return out


class Mix:
    """The plan of a mixture.

    sizes: (id, source, tokens). targets: (source, target_share, max_repeats). The mixture is as large as all records
    together; a source whose target is more than max_repeats times its size gives all it may, and the shares reached
    are reported. Sources without a target are not used; targets without records reach 0. Null shares count as 0,
    null max_repeats as 1; of repeated targets the largest counts. No records or no targets: an empty mixture.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, slots: int = SLOTS, block_tokens: int = BLOCK_TOKENS):
        spark = sizes.sparkSession
        self.sizes = sizes = sizes.select("id", "source", "tokens")
        self.n_ranges = max(1, -(-sizes.count() // RANGE_RECORDS))
        ranges = sizes.groupBy("source", self._range().alias("r")).agg(F.sum("tokens").alias("tokens"))
        self.ranges = stash(ranges, "ranges")
        wanted = targets.select(clean_key(F.col("source")).alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("repeats")).where("source is not null")
        wanted = wanted.groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats"))
        totals = self.ranges.groupBy("source").agg(F.sum("tokens").alias("size"))
        total = self.ranges.agg(F.sum("tokens")).first()[0] or 0
        # One row per target source: as many as the caller's list of weights has.
        rows = wanted.join(totals, "source", "left").select("source", "share", "repeats", F.coalesce("size", F.lit(0)).alias("size")).collect()
        self.plan = []
        for r in rows:
            demand = math.ceil(Fraction(str(r["share"])) * total)
            self.plan.append((r["source"], r["share"], r["repeats"], r["size"], demand, min(demand, r["repeats"] * r["size"])))
        cycles = max(1, -(-sum(p[5] for p in self.plan) // (slots * block_tokens)))
        part = {p[0]: -(-p[5] // cycles) for p in self.plan}  # tokens of each source in a cycle
        cycle = sum(part.values())
        self.block = max(1, -(-cycle // slots))
        self.order = pfair({s: Fraction(n, cycle) for s, n in part.items()}, -(-cycle // self.block)) if cycle else []
        self.quotas = spark.createDataFrame([(*p, part[p[0]]) for p in self.plan], "source string, target_share double, max_repeats int, size bigint, demand bigint, quota bigint, part bigint")
        self.schedule = spark.createDataFrame([(s, k, slot) for slot, (s, k) in enumerate(self.order)], "source string, block bigint, slot bigint")

    def _range(self) -> Column:
        return F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.lit(self.n_ranges)).cast("int")

    def records(self) -> DataFrame:
        """(id, source, copy, slot, place, tokens): every use of a record, in the order of slot and place.

        A source's records are ordered by a hash; each range of hashes is summed by itself and starts where the
        ranges before it end. Copies follow each other until the quota is reached.
        """
        before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.ranges.select("source", "r", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
        placed = self.sizes.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(5))).withColumn("r", self._range())
        inside = Window.partitionBy("source", "r").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = placed.withColumn("end", F.sum("tokens").over(inside)).join(F.broadcast(self.quotas.select("source", "size", "quota", "part").where("quota > 0")), "source")
        placed = placed.join(offsets, ["source", "r"]).withColumn("place", F.col("offset") + F.col("end") - F.col("tokens"))
        last = F.floor((F.col("quota") - F.col("place") - 1) / F.col("size")).cast("int")
        copies = placed.where("place < quota").select("id", "source", "tokens", "size", "part", "place", F.explode(F.sequence(F.lit(0), last)).alias("copy")).withColumn("place", F.col("place") + F.col("copy") * F.col("size"))
        copies = copies.withColumn("block", F.expr(f"(place % part) div {self.block}L"))
        slot = F.expr(f"(place div part) * {max(1, len(self.order))}L") + F.coalesce("slot", F.lit(max(0, len(self.order) - 1)))
        return copies.join(F.broadcast(self.schedule), ["source", "block"], "left").select("id", "source", "copy", slot.alias("slot"), "place", "tokens")

    def reached(self) -> DataFrame:
        """One row per target source: what the placed records come to, against what the target asks for."""
        used = self.records().groupBy("source").agg(F.sum("tokens").alias("used"))
        joined = F.broadcast(self.quotas).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        return joined.withColumn("out_of_reach", F.col("used") < F.col("demand"))


def _mix(spark: SparkSession, base: str) -> Mix:
    sizes = stash(sized(read(spark, base, "documents"), "doc_id", "source", "text"), "sizes")
    return Mix(sizes, read(spark, base, "mix_target"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).records().withColumnRenamed("id", "doc_id")


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    reached = stash(_mix(spark, base).reached(), "reached")
    total = reached.agg(F.sum("used")).scalar()
    return reached.select("source", "target_share", "max_repeats", "size", "quota", "used", "out_of_reach", F.coalesce(F.try_divide(F.col("used"), total), F.lit(0.0)).alias("share_reached"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """The sources whose placed records, with all repeats allowed, don't come to what the target asks for."""
    return _mix(spark, base).reached().where("out_of_reach").select("source")
