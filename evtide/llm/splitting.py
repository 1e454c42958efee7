"""Oversized texts cut at natural boundaries with overlap.

A sparse table over the boundary strengths answers "strongest cut in this window, the rightmost of equals" in constant
time; each cut is one such query, the next piece starts an overlap before it, at a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.runtime import read

LIMIT, OVERLAP = 6000, 1000
#: How much shorter than OVERLAP an overlap may be so that it starts at a word.
SLACK = 100
#: Pieces ahead that one sparse table covers.
AHEAD = 16
#: Strength of a cut after a character.
PARAGRAPH, SENTENCE, WORD, NONE = 3, 2, 1, 0

_SPACE = re.compile(r"\s+")
_BREAK = re.compile("[\u2029\f]|\n[^\n]*\n")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)\]]*(?:\s+|$)|(?<=[。！？])")


class RightmostMax:
    """Sparse table: the rightmost position of the maximum of any range in two lookups."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        key = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [key]
        while 2 ** len(self.levels) <= n:
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def __call__(self, low: int, high: int) -> tuple[int, int]:
        """(position, value) over low <= i < high."""
        k = (high - low).bit_length() - 1
        level = self.levels[k]
        best = int(max(level[low], level[high - (1 << k)]))
        return best % (self.n + 1), best // (self.n + 1)


def strengths(text: str) -> np.ndarray:
    """strengths[i]: how natural a cut before character i is; index len(text) included."""
    out = np.zeros(len(text) + 1, np.int8)
    paragraphs = []
    for m in _SPACE.finditer(text):
        out[m.start() : m.end() + 1] = WORD
        if m.end() - m.start() > 1 or m[0] in "\u2029\f":
            if _BREAK.search(m[0]):  # a run of white space with an empty line or a break in it
                paragraphs.append(m.end())
    out[[m.end() for m in _SENTENCE.finditer(text)]] = SENTENCE
    out[paragraphs] = PARAGRAPH
    return out


def _word(text: str, cut: np.ndarray, low: int, high: int) -> int:
    """The first start of a word over low <= i <= high, else low."""
    words = [i for i in np.flatnonzero(cut[low : max(low, high) + 1]) + low if not text[i : i + 1].isspace()]
    return int(words[0]) if words else low


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at end) of the pieces; together they cover the text in order.

    Each piece has at most limit characters. The strongest cut in the window that leaves the piece longer than half the
    limit is taken, else the strongest in what is left of the window. Only where a stretch without white space fits a
    piece but not behind the overlap is as much of the overlap given up as it needs, and only where one is longer than
    the limit is it cut anywhere, with the overlap kept.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)]
    cut = strengths(text)
    pieces, start, done, reach = [], 0, 0, 0
    while True:
        if n - start <= limit:
            pieces.append((start, n, PARAGRAPH))
            return pieces
        if start + limit + 1 > reach:  # the table covers some pieces ahead, so that it stays small for the longest texts
            offset, reach = start, min(n + 1, start + AHEAD * (limit + 1))
            block = RightmostMax(cut[offset:reach])

            def table(low: int, high: int, block=block, offset=offset) -> tuple[int, int]:
                at, value = block(low - offset, high - offset)
                return at + offset, value

        end, strength = table(max(done, start + limit // 2) + 1, start + limit + 1)
        if strength == NONE and done < start + limit // 2:
            end, strength = table(done + 1, start + limit + 1)
        if strength == NONE and start < done and cut[done] != NONE:  # a stretch begins at done
            stop = done + 1 + int(next(iter(np.flatnonzero(cut[done + 1 : done + limit + 1])), n - done - 1))
            if stop - done <= limit:  # it fits a piece: give up as much of the overlap as that takes
                start = _word(text, cut, stop - limit, min(stop - limit + slack, done))
                continue
        pieces.append((start, end, strength))
        done = end
        low, high = max(end - overlap, start + 1), min(end - overlap + slack, end)
        start = _word(text, cut, low, high)


def _pieces(texts: bool):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, s, t[a:b] if texts else None) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, (a, b, s) in enumerate(split(t))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "stop", "strength", "piece_text"])

    return f


def split_long(texts: DataFrame, id_column: str, text_column: str, with_texts: bool = True) -> DataFrame:
    """(id, piece, start, stop, strength, piece_text) of every text longer than LIMIT characters (code points).

    Nulls and texts up to the limit give no rows; of rows alike in id and text one counts; extra columns are not used.
    strength 0 marks a forced cut: a stretch of more than LIMIT characters without white space. Without texts,
    piece_text is null.
    """
    slim = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.length("text") > LIMIT)
    kind = slim.schema["id"].dataType.simpleString()
    return slim.distinct().mapInPandas(_pieces(with_texts), f"id {kind}, piece int, start int, stop int, strength int, piece_text string")


def _all_pieces(spark: SparkSession, base: str, with_texts: bool = True) -> DataFrame:
    documents = read(spark, base, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    articles = read(spark, base, "mna").select(F.concat(F.lit("m"), "article_id").alias("id"), F.col("article_text").alias("text"))
    pieces = split_long(documents.unionByName(articles), "id", "text", with_texts)
    table = F.when(F.col("id").startswith("d"), "documents").otherwise("mna")
    return pieces.select(table.alias("source_table"), F.expr("substr(id, 2)").alias("item_id"), "piece", "start", "stop", "strength", "piece_text")


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    """The pieces themselves, for training."""
    return _all_pieces(spark, base)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    kind = F.when(F.min("strength") == NONE, "forced").otherwise("natural")
    return _all_pieces(spark, base, with_texts=False).groupBy("source_table", "item_id").agg(kind.alias("cut_kind"))
