"""Variant spellings of names linked to reference names.

MinHash banding over padded q-grams of name parts proposes (name, reference) pairs, Monge-Elkan similarity over the
words verifies them, and star clustering with the reference names as centres assigns each name to at most one entity.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.runtime import broadcast_if_small, clean_key, read, stand_in, stash

Q = 2
#: Two spellings of one word with two typing errors share about this part of their padded q-grams.
TARGET_SIMILARITY, TARGET_RECALL = 0.42, 0.98
#: A word in more than this part of the reference names (and in more than GENERIC_MIN) says what a firm does, not who it is.
GENERIC_SHARE, GENERIC_MIN = 0.008, 4
#: Least similarity of an aligned generic word, and of a name as a whole; the weight of a generic word in the mean.
WORD_MIN, NAME_MIN, GENERIC_WEIGHT = 0.6, 0.72, 0.3

#: Legal forms, spelt as single words after punctuation is removed, and those of several words.
LEGAL_WORDS = frozenset("inc incorporated corp corporation co company ltd limited plc llc llp lp ag sa nv gmbh kg se spa bv ab oy group grp holding holdings hldg hldgs aktiengesellschaft".split())
LEGAL_PHRASES = ("public limited company", "societe anonyme", "naamloze vennootschap", "limited liability company", "incorporated company")
#: Words without meaning in a name.
FILLERS = frozenset("the and of".split())


def choose_bands(similarity: float = TARGET_SIMILARITY, recall: float = TARGET_RECALL, most: int = 210) -> tuple[int, int]:
    """(bands, rows): of the bandings of at most so many hashes whose collision curve 1 - (1 - s^r)^b reaches the recall at the similarity, that with the fewest collisions at a similarity of 0.1."""
    best = None
    for r in range(1, 7):
        b = math.ceil(math.log(1 - recall) / math.log(1 - similarity**r))
        if b * r <= most:
            false = 1 - (1 - 0.1**r) ** b
            if best is None or false < best[0]:
                best = (false, b, r)
    return best[1], best[2]


def fold(text: str) -> str:
    """Lower case without accents; digits that stand for letters inside words replaced."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", text.lower()))


def shape(word: str) -> str:
    """Letters that scans and typists confuse made equal."""
    return word.replace("rn", "m").replace("vv", "w").replace("i", "l")


_REMARK = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_TICKER = re.compile(r"[(\[]\s*(?:[A-Za-z]+\s*:\s*)?([A-Za-z]{1,6})\s*[)\]]\s*$|\s-\s+([A-Za-z]{1,6})\s*$")
_DOTTED = re.compile(r"\b(?:\w\.){2,}(?:\w\b)?")


def parse(raw: str) -> tuple[list[str], str]:
    """The words of a name without legal forms, and a ticker given with it or as the whole name (else '')."""
    ticker = ""
    if m := _TICKER.search(raw):
        ticker, raw = (m[1] or m[2]).lower(), raw[: m.start()]
    raw = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", _REMARK.sub(" ", raw))
    text = fold(_DOTTED.sub(lambda m: m[0].replace(".", ""), raw.replace("_", " ")))
    text = " ".join(re.findall(r"[a-z0-9]+", text.replace("'", "").replace("’", "")))
    for phrase in LEGAL_PHRASES:
        text = text.replace(phrase, " ")
    words = [w for w in text.split() if w not in FILLERS]
    kept = [w for w in words if w not in LEGAL_WORDS and len(w) > 1] or words
    if not ticker and len(kept) == 1 and len(kept[0]) <= 6:
        ticker = kept[0]
    return kept, ticker


def parts(words: list[str], generic: frozenset[str], reference: bool = False) -> list[str]:
    """What is indexed of a name: its telling words, and neighbours run together; of a reference in both orders, so that a name finds it in whichever order it has the words."""
    out = [w for w in words if len(w) > 2 and w not in generic]
    for a, b in zip(words, words[1:], strict=False):
        out += [a + b, b + a] if reference else [a + b]
    return list(dict.fromkeys(map(shape, out)))


def band_keys(words: list[str], bands: int, rows: int) -> np.ndarray:
    """For each word its band hashes (len(words) x bands) of MinHash signatures over its padded q-grams."""
    if not words:
        return np.empty((0, bands), np.int64)
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    grams = data[:-1] * np.uint64(1 << 21) + data[1:]
    keep = np.ones(len(grams), bool)
    keep[ends[:-1] - 1] = False
    grams, starts = grams[keep], np.concatenate([[0], np.cumsum(lengths - 1)[:-1]])
    grams = (grams ^ (grams >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
    rng = np.random.default_rng(11)
    factor, offset = rng.integers(1, 1 << 62, (2, bands * rows)).astype(np.uint64) | np.uint64(1)
    out = np.empty((len(words), bands), np.int64)
    for b in range(bands):
        key = np.full(len(words), b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            h = (grams ^ offset[i]) * factor[i]
            key = (key ^ np.minimum.reduceat(h, starts)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[:, b] = key.view(np.int64)
    return out


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    if len(a) == len(b) == 1 or len(a) == len(b) == 2 and a == b[::-1]:
        return 1
    before, last = [], list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        now = [x]
        for y in range(1, len(b) + 1):
            d = min(last[y] + 1, now[-1] + 1, last[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, before[y - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def abbreviates(short: str, long: str) -> bool:
    rest = iter(long)
    return 2 <= len(short) < len(long) and short[0] == long[0] and all(c in rest for c in short)


def telling_similarity(word: str, reference: str) -> float:
    """1 for equal words, less for one edit (two in words of more than ten letters) once letters that look alike are equal, else 0.

    Two edits in a word of eight letters lead to other words as often as to the same one.
    """
    if word == reference:
        return 1.0
    most = 1 if len(reference) <= 10 else 2
    if abs(len(word) - len(reference)) > most + 1:
        return 0.0
    d = min(edits(word, reference), edits(shape(word), shape(reference)))
    return 1 - d / max(len(word), len(reference)) if d <= most else 0.0


class Scorer:
    """Monge-Elkan similarity of names, given the generic words of the reference names.

    generic: bounded by its definition: each is in more than GENERIC_SHARE of the names, so there are at most as many as
    a name has words on average, divided by that share.
    """

    def __init__(self, generic: frozenset[str]):
        self.generic = generic
        self.nearest = lru_cache(100_000)(self._nearest)
        self.telling = lru_cache(200_000)(telling_similarity)

    def _nearest(self, word: str) -> tuple[str, float]:
        """The generic word that a word is, misspells or abbreviates most nearly."""
        best = ("", 0.0)
        for g in self.generic:
            s = 1.0 if word == g else (0.87 if g.startswith(word) else 0.83) + 0.12 * len(word) / len(g) if abbreviates(word, g) else 0.0
            if not s and abs(len(word) - len(g)) <= 3:
                s = 1 - edits(word, g) / max(len(word), len(g))
            if s > best[1]:
                best = (g, s)
        return best

    def similarity(self, word: str, reference: str) -> float:
        if reference in self.generic:
            near, s = self.nearest(word)
            return s if near == reference else 0.0
        return self.telling(word, reference)

    def __call__(self, words: list[str], reference: list[str]) -> float:
        """The weighted mean of the best similarity of each word of either name; 0 if a word of the name, or a telling word of the reference, is without a counterpart.

        Neighbouring words of the name are run together where that brings them nearer to a word of the reference.
        """
        i, best_of, sum_used, weight_used = 0, [0.0] * len(reference), 0.0, 0.0
        weights = [GENERIC_WEIGHT if r in self.generic else 1.0 for r in reference]
        while i < len(words):
            sims = [self.similarity(words[i], r) for r in reference]
            k = max(range(len(sims)), key=sims.__getitem__)
            step = 1
            if i + 1 < len(words):
                joined = [self.telling(words[i] + words[i + 1], r) for r in reference]
                j = max(range(len(joined)), key=joined.__getitem__)
                if joined[j] > 0.75 and joined[j] > min(sims[k], max(self.similarity(words[i + 1], r) for r in reference)):
                    sims, k, step = joined, j, 2
            if sims[k] < WORD_MIN:
                return 0.0
            sum_used, weight_used = sum_used + weights[k] * sims[k], weight_used + weights[k]
            best_of[k] = max(best_of[k], sims[k])
            i += step
        if any(s < WORD_MIN for s, r in zip(best_of, reference, strict=True) if r not in self.generic or all(w < 1 for w in weights)):
            return 0.0
        return (sum_used / weight_used + sum(w * s for w, s in zip(weights, best_of, strict=True)) / sum(weights)) / 2


def _run_together(words: list[str], reference: list[str]) -> float:
    a, b = "".join(words), "".join(reference)
    return 1 - edits(a, b) / max(len(a), len(b)) if a[:1] == b[:1] and abs(len(a) - len(b)) <= 2 and len(words) != len(reference) else 0.0


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse(x) for x in pdf["name"]]
        pdf["words"], pdf["ticker"] = [w for w, _ in parsed], [t for _, t in parsed]
        yield pdf


def _bands_of(bands: int, rows: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = band_keys(list(pdf["part"]), bands, rows)
            yield pd.DataFrame({"part": pdf["part"], "bands": list(keys)})

    return f


def _parts_of(generic: frozenset[str], reference: bool):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "parts": [parts(list(w), generic, reference) for w in pdf["words"]]})

    return f


def _score_of(generic: frozenset[str]):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(generic)
        for pdf in batches:
            score = []
            for words, ticker, ref, ref_tickers in zip(pdf["words"], pdf["ticker"], pdf["ref_words"], pdf["ref_tickers"], strict=True):
                words, ref = list(words), list(ref)
                s = max(scorer(words, ref), _run_together(words, ref) - 0.05)
                if ticker and ref_tickers is not None and s and ticker in ref_tickers:
                    s += 0.2
                score.append(s)
            out = pdf[["id", "entity"]].copy()
            out["score"] = np.round(score, 4)
            yield out[out["score"] >= NAME_MIN]

    return f


def link_names(names: DataFrame, name: str, references: DataFrame, entity: str, ref_name: str, tickers: DataFrame) -> DataFrame:
    """(name, entity): the entity that each distinct name stands for; names without one, or with several equally near, are left out.

    references: (entity, ref_name), several rows per entity allowed; tickers: (entity, ticker). Null and blank names and
    references are ignored, repeated rows change nothing, empty tables give no rows, extra columns are not used. Every distinct name is compared with every reference name that
    shares a band; a hot band holds each distinct part once, whatever the number of rows.
    """
    bands, rows = choose_bands()
    blank = r"^\W*$"
    ref = references.select(F.col(entity).alias("entity"), clean_key(F.col(ref_name)).alias("name")).where("entity is not null and name is not null").where(~stand_in(F.col("name"))).distinct()
    schema = "name string, words array<string>, ticker string"
    ref = ref.mapInPandas(_parse_batches, f"entity {references.schema[entity].dataType.simpleString()}, {schema}")
    ref = stash(ref.withColumn("id", F.xxhash64("entity", "name")), "refs")
    limit = max(GENERIC_MIN, int(GENERIC_SHARE * ref.count()))
    frequent = ref.select("entity", F.explode("words").alias("w")).distinct().groupBy("w").count().where(F.col("count") > limit)
    generic = frozenset(r["w"] for r in frequent.collect())  # at most the words of an average name / GENERIC_SHARE
    own = tickers.select(F.col(tickers.columns[0]).alias("entity"), F.lower(F.regexp_replace(F.col(tickers.columns[1]), r"[\s.]", "")).alias("t")).where("entity is not null and t <> ''").distinct()
    ref = ref.join(own.groupBy("entity").agg(F.collect_set("t").alias("ref_tickers")), "entity", "left")
    ref = stash(ref.select(F.col("id").alias("ref_id"), "entity", F.col("words").alias("ref_words"), "ref_tickers", "name"), "refs")

    def indexed(of: DataFrame, reference: bool) -> DataFrame:
        return of.mapInPandas(_parts_of(generic, reference), "id bigint, parts array<string>").select("id", F.explode("parts").alias("part"))

    def banded(of: DataFrame, as_part: str) -> DataFrame:
        distinct = of.select("part").distinct().mapInPandas(_bands_of(bands, rows), "part string, bands array<bigint>")
        return distinct.select(F.col("part").alias(as_part), F.explode("bands").alias("h"))

    ref_parts = indexed(ref.select(F.col("ref_id").alias("id"), F.col("ref_words").alias("words")), True)
    todo = names.select(F.col(name).alias("name")).where("name is not null").where(~F.col("name").rlike(blank)).distinct()
    todo = stash(todo.mapInPandas(_parse_batches, schema).withColumn("id", F.xxhash64("name")), "names")
    mine = stash(indexed(todo.select("id", "words"), False), "parts")
    # The verification accepts two edits of a word, each perhaps a swap of neighbours, which counts twice here.
    close = F.levenshtein("part", "ref_part", 4) >= 0
    ref_bands = broadcast_if_small(stash(banded(ref_parts, "ref_part"), "bands"))
    alike = banded(mine, "part").join(ref_bands, "h").select("part", "ref_part").distinct().where(close)
    by_band = mine.join(alike, "part").join(ref_parts.select(F.col("id").alias("ref_id"), F.col("part").alias("ref_part")), "ref_part").select("id", "ref_id").distinct()
    candidates = by_band.join(todo, "id").join(broadcast_if_small(ref), "ref_id")
    entity_type = ref.schema["entity"].dataType.simpleString()
    scored = candidates.select("id", "words", "ticker", "entity", "ref_words", "ref_tickers").mapInPandas(_score_of(generic), f"id bigint, entity {entity_type}, score double")
    initials = F.regexp_replace("name", r"(?<=[a-z0-9])[a-z0-9]*[^a-z0-9]*", "")
    by_initials = ref.select("entity", initials.alias("t")).where("length(t) >= 3").distinct()
    short = todo.where("size(words) = 1 and ticker = words[0]")
    exact = own.withColumn("score", F.lit(0.99)).unionByName(by_initials.withColumn("score", F.lit(0.9)))
    by_ticker = short.join(exact, F.col("ticker") == F.col("t")).select("id", "entity", "score")
    star = scored.unionByName(by_ticker).groupBy("id").agg(F.max(F.struct("score", "entity")).alias("hi"), F.min(F.struct((-F.col("score")).alias("score"), "entity")).alias("lo"))
    star = star.where("hi.entity = lo.entity").select("id", F.col("hi.entity").alias("entity"))
    return todo.select("id", "name").join(star, "id").select(F.col("name"), F.col("entity"))


def firm_references(canonical: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = alias.join(canonical.select("firm_id").distinct(), "firm_id", "left_semi")
    names = canonical.select("firm_id", F.col("canonical_name").alias("name")).unionByName(known.where("atom_type = 'normalized_name'").select("firm_id", F.col("atom_value").alias("name")))
    tickers = canonical.select("firm_id", F.col("canonical_ticker").alias("t")).unionByName(known.where("atom_type = 'ticker'").select("firm_id", F.col("atom_value").alias("t")))
    return names, tickers.where(~stand_in(clean_key(F.col("t"))))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    events = read(spark, base, "corp_events").where("firm_id is null").select("event_id", "firm_name_raw")
    names, tickers = firm_references(read(spark, base, "firm_canonical"), read(spark, base, "firm_alias"))
    linked = link_names(events, "firm_name_raw", names, "firm_id", "name", tickers)
    return events.join(linked.select(F.col("name").alias("firm_name_raw"), F.col("entity").alias("firm_id")), "firm_name_raw").select("event_id", "firm_id").distinct()
