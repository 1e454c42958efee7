"""Evaluation passages inside a corpus, by the q-gram lemma.

Texts are reduced to words of plain letters and digits with single blanks. Passages are runs of RUN words of an item; a
stretch of text that differs from a passage of L characters by at most e edits shares L - q + 1 - q e q-grams with it on
neighbouring diagonals. Each text is read once, whole: its q-grams are looked up in a bitmap of the items' q-grams, and
only texts with enough of them close together go on. There the q-grams are joined to the items' index, counted in
overlapping diagonal bands, and the bands that reach the bound are verified by an alignment inside the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.llm.folding import LETTERS
from evtide.runtime import broadcast_if_small, read, stash

#: Words in a row that make a passage; characters of a q-gram; edits allowed inside a passage.
RUN, Q, EDITS = 13, 16, 1
#: Bits of the bitmap per q-gram of the items, and the most it may have (as a power of two): beyond that it lets more pass, but misses nothing.
BITS_EACH, MOST_BITS = 64, 27
#: Characters and passages that are worked on at a time.
CHARS, PASSAGES = 4_000_000, 20_000

_TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*\s*/?>|<!--[^<>]*-->|&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z]+);""")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """text as bytes: lower-case plain letters and digits, a single blank between words and at both ends."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = text.translate(LETTERS)
    return b" %s " % b" ".join(text.encode().translate(_ASCII).split())


def q_grams(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the Q = 16 bytes from each place of raw."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.empty(n + 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - o) // 8, offset=o)
        words[o::8] = part[: len(words[o::8])]
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def passages(body: bytes) -> np.ndarray:
    """(start, end) of every run of RUN words of body, the blanks around it included."""
    cuts = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    return np.stack([cuts[: -RUN or None], cuts[RUN:] + 1], 1) if len(cuts) > RUN else np.empty((0, 2), int)


def bound(body: bytes, edits: int) -> tuple[int, int, int]:
    """(shortest, edits, least) of an item: the length of its shortest passage, how many edits that can have for the lemma to ask for a q-gram at all, and how many q-grams it then asks for."""
    shortest = int(np.diff(passages(body), axis=1).min())
    e = max(0, min(edits, (shortest - Q) // Q))
    return shortest, e, shortest - Q + 1 - Q * e


def _folded_items(edits: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = [letters(t) for t in pdf["t"]]
            keep = [len(passages(b)) > 0 for b in bodies]
            rows = [(i, b, *bound(b, edits)) for i, b, k in zip(pdf["item_id"], bodies, keep, strict=True) if k]
            yield pd.DataFrame(rows, columns=["item_id", "item_body", "shortest", "edits", "least"])

    return f


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        grams = [q_grams(b) for b in pdf["item_body"]]
        sizes = [len(g) for g in grams]
        yield pd.DataFrame({"gram": np.concatenate([np.empty(0, np.uint64), *grams]).view(np.int64), "iid": np.repeat(pdf["iid"].to_numpy(), sizes), "ipos": np.concatenate([np.empty(0, int), *map(np.arange, sizes)]).astype(np.int32)})


def bitmap_of(grams: DataFrame) -> tuple[int, bytes]:
    """(bits, bitmap): which hash prefixes of so many bits the q-grams have. At most 2^MOST_BITS bits come to the driver, whatever the items."""
    bits = min(MOST_BITS, max(16, int(grams.count() * BITS_EACH - 1).bit_length()))
    prefix = F.shiftrightunsigned("gram", 64 - bits)
    words = grams.select(F.shiftright(prefix, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy(int)] = words["word"].to_numpy(np.int64)
    return bits, out.tobytes()


def close_hits(at: np.ndarray, text: np.ndarray, least: int, within: int) -> np.ndarray:
    """Which of the sorted places at lie among least or more of one text within so many places."""
    ok = np.zeros(len(at) + 1, np.int64)
    if len(at) >= least:
        first = np.flatnonzero((at[least - 1 :] - at[: len(at) - least + 1] < within) & (text[least - 1 :] == text[: len(at) - least + 1]))
        np.add.at(ok, first, 1)
        np.add.at(ok, first + least, -1)
    return np.cumsum(ok)[:-1] > 0


def _suspects(bits: int, bitmap: bytes, least: int, within: int):
    """Texts with enough of the items' q-grams close together, and these q-grams with their places."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            ends = np.cumsum([len(t) for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(ends // CHARS)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                bodies = [letters(t) for t in texts[a:b]]
                grams = q_grams(b"\x01".join(bodies))
                starts = np.cumsum([0, *[len(x) + 1 for x in bodies]])
                at = np.flatnonzero(there[(grams >> np.uint64(64 - bits)).astype(np.int64)])
                text = np.searchsorted(starts, at, "right") - 1
                near = close_hits(at, text, least, within)
                at, text = at[near], text[near]
                found = np.unique(text)
                if not len(found):  # pandas takes a column of no lists for numbers, which Arrow does not make lists of
                    continue
                slices = [(np.searchsorted(text, x, "left"), np.searchsorted(text, x, "right")) for x in found]
                yield pd.DataFrame({"id": ids[a:b][found], "body": [bodies[x] for x in found], "grams": [grams[at[i:j]].view(np.int64) for i, j in slices], "at": [(at[i:j] - starts[x]).astype(np.int32) for x, (i, j) in zip(found, slices, strict=True)]})

    return f


def banded_edits(pattern: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray, columns: int) -> np.ndarray:
    """The least edits between each pattern and a stretch of text on the columns diagonals from base.

    pattern, text: all of them one after the other; pattern k is pattern[start : start + size]. Column c of row i stands
    for the text up to place base + i + c; places outside low <= place < high match nothing. A stretch may begin and end
    on any of the diagonals.
    """
    n, steps = len(start), int(size.max(initial=0))
    cost = np.zeros((n, columns), np.int16)
    best = np.zeros(n, np.int16)
    offsets = np.arange(columns)
    for i in range(1, steps + 1):
        live = np.flatnonzero(size >= i)
        place = (base[live] + i - 1)[:, None] + offsets
        inside = (place >= low[live][:, None]) & (place < high[live][:, None])
        same = inside & (text[np.where(inside, place, 0)] == pattern[start[live] + i - 1][:, None])
        before = cost[live]
        now = before + ~same
        now[:, :-1] = np.minimum(now[:, :-1], before[:, 1:] + 1)
        for c in range(1, columns):
            now[:, c] = np.minimum(now[:, c], now[:, c - 1] + 1)
        cost[live] = now
        done = size[live] == i
        best[live[done]] = now[done].min(1)
    return best


def _verified(step: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            items, bodies = pdf["item_body"].tolist(), pdf["region"].tolist()
            pattern, text = np.frombuffer(b"".join(items), np.uint8), np.frombuffer(b"".join(bodies) + b"\x01", np.uint8)
            at_item, at_text = np.cumsum([0, *map(len, items)]), np.cumsum([0, *map(len, bodies)])
            rows, start, size, base = [], [], [], []
            for k, (item, e, band, lo, hi, offset) in enumerate(zip(items, pdf["edits"], pdf["band"], pdf["lo"], pdf["hi"], pdf["offset"], strict=True)):
                runs = passages(item)
                runs = runs[(runs[:, 0] >= lo - Q * e) & (runs[:, 1] <= hi + Q + Q * e)]
                rows.append(np.full(len(runs), k))
                start.append(runs[:, 0] + at_item[k])
                size.append(runs[:, 1] - runs[:, 0])
                base.append(runs[:, 0] - (band * step + 2 * step - 1) - e - offset + at_text[k])
            rows, start, size, base = map(np.concatenate, (rows, start, size, base))
            allowed = pdf["edits"].to_numpy(int)
            least = np.full(len(pdf), 1 << 14)
            for a in range(0, len(rows), PASSAGES):
                r = rows[a : a + PASSAGES]
                got = banded_edits(pattern, start[a : a + PASSAGES], size[a : a + PASSAGES], text, base[a : a + PASSAGES], at_text[r], at_text[r + 1], 2 * step + 2 * int(allowed.max()))
                np.minimum.at(least, r, got)
            keep = least <= allowed
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[keep], "item_id": pdf["item_id"].to_numpy()[keep], "n_edits": least[keep]})

    return f


def find_leaks(texts: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, item_text: str, edits: int = EDITS) -> DataFrame:
    """(id, item_id, n_edits), one row per pair: each text with each item of which it holds a passage of RUN words with at most so many edits (characters put in, left out or changed), and the least number of them; 0 is the passage word for word.

    An item whose shortest passage has under Q (1 + edits) characters is sought with fewer edits, as the lemma asks for
    nothing otherwise. Null and empty texts and items match nothing, nor do items of fewer words; extra columns are not
    used; ids may repeat. Texts are read once; items stay in tables, the driver gets a bitmap of bounded size.
    """
    slim = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text <> ''")
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t <> ''").distinct()
    id_type, item_type = slim.schema["id"].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()
    item = stash(wanted.mapInPandas(_folded_items(edits), f"item_id {item_type}, item_body binary, shortest int, edits int, least int").withColumn("iid", F.monotonically_increasing_id()), "items")
    grams = stash(item.mapInPandas(_item_grams, "gram bigint, iid bigint, ipos int"), "grams")
    limits = item.agg(F.min("shortest").alias("shortest"), F.max("edits").alias("edits")).first()
    if limits.shortest is None:
        return texts.sparkSession.createDataFrame([], f"id {id_type}, item_id {item_type}, n_edits int")
    # Of any passage, a part as long as the shortest passage of all misses no more q-grams than its edits destroy.
    places = limits.shortest - Q + 1
    found = slim.mapInPandas(_suspects(*bitmap_of(grams), max(1, places - Q * limits.edits), places + limits.edits), f"id {id_type}, body binary, grams array<bigint>, at array<int>")
    found = stash(found.withColumn("rid", F.monotonically_increasing_id()), "suspects")
    step = max(1, limits.edits)  # bands of 2 step diagonals, a step apart: each stretch lies inside one
    # A text's hits stay together, so that counting them needs no further shuffle.
    hits = found.select("rid", "grams", "at").repartition("rid").select("rid", F.explode(F.arrays_zip("grams", "at")).alias("h")).select("rid", F.col("h.grams").alias("gram"), F.col("h.at").alias("at"))
    band = F.floor((F.col("ipos") - F.col("at")) / step)
    banded = hits.join(broadcast_if_small(grams), "gram").select("rid", "iid", "ipos", F.explode(F.array(band, band - 1)).alias("band"))
    counted = banded.groupBy("rid", "iid", "band").agg(F.count(F.lit(1)).alias("n"), F.min("ipos").alias("lo"), F.max("ipos").alias("hi"))
    candidates = counted.join(broadcast_if_small(item), "iid").where("n >= least")
    offset = F.greatest(F.lit(0), F.col("lo") - Q * F.col("edits") - (F.col("band") + 2) * step - F.col("edits"))
    length = F.col("hi") - F.col("lo") + Q + 2 * Q * F.col("edits") + 2 * step + 3 * F.col("edits") + 2
    placed = candidates.join(found.select("rid", "id", "body"), "rid").withColumn("offset", offset.cast("int"))
    regions = placed.select("id", "item_id", "item_body", "edits", "band", "lo", "hi", "offset", F.substring("body", F.col("offset") + 1, length.cast("int")).alias("region"))
    pairs = regions.mapInPandas(_verified(step), f"id {id_type}, item_id {item_type}, n_edits int")
    return pairs.groupBy("id", "item_id").agg(F.min("n_edits").alias("n_edits"))


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(read(spark, base, "documents"), "doc_id", "text", read(spark, base, "eval_item"), "item_id", "item_text").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Leaks word for word: of the pairs within the edit budget those that need no edit."""
    return _leaks(spark, base).where("n_edits = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, base: str) -> DataFrame:
    """All leaks within the edit budget with the edits they need."""
    return _leaks(spark, base)
