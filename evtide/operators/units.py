"""Quantities in many units and notations converted to common units.

Rows are reduced to their distinct unit spellings (texts with the figure masked, currency and scale columns). The words
of the spellings find known units through an inverted index of character n-grams, verified by a weighted edit distance;
the resulting dictionary is joined to all rows, where the arithmetic is exact decimal SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from evtide.runtime import broadcast_if_small, clean_key, read, stand_in, stash

#: Spellings of currencies. A currency named by two words is an adjective before "dollar" and the like.
CURRENCIES = {
    "USD": "usd us$ $ usdollar", "EUR": "eur € euro euros", "GBP": "gbp £ pound pounds sterling stg quid", "JPY": "jpy ¥ yen", "INR": "inr ₹ rs rupee rupees", "CAD": "cad c$ cdn ca$", "AUD": "aud a$ au$", "CHF": "chf sfr franc francs franken fr",
}
#: Minor units with their currency ("" if it is that of the context) and size.
MINOR = {"cent": "", "cents": "", "¢": "", "pence": "GBP", "penny": "GBP", "p": "GBP", "gbx": "GBP", "paise": "INR", "rappen": "CHF"}
#: Words that make "dollar" another currency.
ADJECTIVES = {"us": "USD", "american": "USD", "canadian": "CAD", "australian": "AUD", "swiss": "CHF", "british": "GBP", "japanese": "JPY", "indian": "INR"}
#: Spellings of scales, by power of ten.
SCALES = {0: "unit units one ones", 3: "thousand thousands k 000s 000 tsd", 5: "lakh lakhs lac", 6: "million millions m mn mm mio mill mln millionen", 7: "crore crores cr", 9: "billion billions b bn bln mrd milliarde milliarden milliard", 12: "trillion trillions tn trn t bio billionen"}
#: English number words.
NUMBERS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety".split(), ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "30", "40", "50", "60", "70", "80", "90"], strict=True)) | {"half": "0.5", "quarter": "0.25", "hundred": "100", "dozen": "12"}

#: A word may differ from a known one by this part of its length; in words shorter than SHORT, where other edits lead to
#: other words, only by one of the CHEAPEST edits.
FUZZY_SHARE, SHORT, CHEAPEST = 0.2, 5, 0.3
EXACT = DecimalType(38, 8)


def known_units(spark: SparkSession) -> DataFrame:
    """(alias, kind, code, value) of all known unit words."""
    rows = [(a, "currency", c, "1") for c, words in CURRENCIES.items() for a in words.split()]
    rows += [(a, "minor", c, "0.01") for a, c in MINOR.items()]
    rows += [(a, "adjective", c, "1") for a, c in ADJECTIVES.items()]
    rows += [(a, "scale", "", str(10**p)) for p, words in SCALES.items() for a in words.split() if a != "one"]
    rows += [(a, "number", "", v) for a, v in NUMBERS.items()]
    rows += [("dollar", "dollar", "USD", "1"), ("dollars", "dollar", "USD", "1")]
    return spark.createDataFrame(rows, "alias string, kind string, code string, value string")


def grams(word: Column) -> Column:
    """The distinct padded bigrams of a word."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which vowels, doubled letters, a final s and swapped neighbours cost less than other edits."""
    light = lambda s, i: 0.3 if i and s[i] == s[i - 1] or s[i] == "s" and i == len(s) - 1 else 0.6 if s[i] in "aeiou" else 1.0
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        d[i][0] = d[i - 1][0] + light(a, i - 1)
    for j in range(1, m + 1):
        d[0][j] = d[0][j - 1] + light(b, j - 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = 0.0 if a[i - 1] == b[j - 1] else 0.6 if a[i - 1] in "aeiou" and b[j - 1] in "aeiou" else 1.0
            d[i][j] = min(d[i - 1][j - 1] + same, d[i - 1][j] + light(a, i - 1), d[i][j - 1] + light(b, j - 1))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 0.6)
    return d[n][m]


def allowed(length: int) -> float:
    return CHEAPEST if length < SHORT else FUZZY_SHARE * length


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["distance"] = [weighted_distance(a, b) for a, b in zip(pdf["word"], pdf["alias"], strict=True)]
        yield pdf[pdf["distance"] <= pdf["word"].str.len().map(allowed) + 1e-9]


def alias_dictionary(words: DataFrame) -> DataFrame:
    """(word, kind, code, value): the known unit of each distinct word; words near none are left out, ties go to the smaller alias."""
    units = known_units(words.sparkSession)
    words = words.select("word").distinct()
    exact = words.join(F.broadcast(units), words["word"] == units["alias"]).select("word", "kind", "code", "value")
    rest = words.join(F.broadcast(units.select("alias")), words["word"] == F.col("alias"), "left_anti")
    index = units.select("alias", F.explode(grams(F.col("alias"))).alias("gram"))
    shared = rest.select("word", F.explode(grams(F.col("word"))).alias("gram")).join(F.broadcast(index), "gram").select("word", "alias").distinct()
    # No edit destroys more than five bigrams for each unit of its distance, but for a final s, which destroys two: of the
    # length + 1 bigrams of a word one at least is left within the distance allowed, so the index misses no pair. Lengths
    # differ by one for each edit of CHEAPEST or more.
    most = F.when(F.length("word") < SHORT, CHEAPEST).otherwise(F.length("word") * FUZZY_SHARE)
    near = shared.where(F.abs(F.length("word") - F.length("alias")) <= most / CHEAPEST + 1e-9)
    fuzzy = near.mapInPandas(_verified, "word string, alias string, distance double").groupBy("word").agg(F.min(F.struct("distance", "alias")).alias("best"))
    fuzzy = fuzzy.join(F.broadcast(units), F.col("best.alias") == F.col("alias")).select("word", "kind", "code", "value")
    return exact.unionByName(fuzzy)


#: A figure, but not the 000 of "000s".
_FIGURE = r"(?<![\d.,])(?!000'?s)\d[\d.,]*"
_WORD = r"[a-z]{0,3}\$|000'?s|[\p{L}]+|[€£¥₹¢]"


def spelling(text: Column) -> Column:
    """The text in lower case with its first figure masked."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")), _FIGURE, "#")


def figure(text: Column) -> Column:
    """The first figure of a text as a decimal. The last of two kinds of marks is the decimal mark; a single kind groups thousands if three digits follow each (a lone point only in German phrases or when repeated)."""
    raw = F.regexp_replace(F.regexp_extract(text, _FIGURE, 0), r"[.,]+$", "")
    german = F.lower(text).rlike(r"mio\.|mrd\.|\baktie\b|tsd\.")
    both = F.when(F.instr(F.reverse(raw), ".") < F.instr(F.reverse(raw), ","), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = (
        F.when(raw.contains(".") & raw.contains(","), both)
        .when(raw.rlike(r"^\d{1,3}(,\d{2,3})*,\d{3}$"), F.replace(raw, F.lit(","), F.lit("")))
        .when(raw.contains(","), F.replace(raw, F.lit(","), F.lit(".")))
        .when(raw.rlike(r"^\d{1,3}(\.\d{3}){2,}$") | (german & raw.rlike(r"^\d{1,3}\.\d{3}$")), F.replace(raw, F.lit("."), F.lit("")))
        .otherwise(raw)
    )
    return plain.try_cast(EXACT)


def _meaning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for spelt, units in zip(pdf["spelling"], pdf["units"], strict=True):
            currency, minor, scale, worded, total, current, half, adjective = None, None, None, False, Decimal(0), None, False, None
            for _, word, kind, code, value in sorted(tuple(u[k] for k in ("pos", "word", "kind", "code", "value")) for u in units):
                if kind == "currency" and currency is None:
                    currency = code
                elif kind == "dollar" and currency is None:
                    currency = adjective or code
                elif kind == "adjective":
                    adjective = code
                elif kind == "minor":
                    minor, currency = Decimal(value), currency or code or adjective
                elif kind == "scale" and scale is None:
                    scale = Decimal(value)
                elif kind == "number" and "#" not in spelt:
                    worded, v = True, Decimal(value)
                    if word == "hundred":
                        current = (current or 1) * v
                    else:
                        current = (current or 0) + v
            rows.append((spelt, currency, str(scale) if scale is not None else None, str(minor or 1), str(current) if worded and current else None))
        yield pd.DataFrame(rows, columns=["spelling", "currency", "scale", "minor", "worded"])


def unit_dictionary(spellings: DataFrame) -> DataFrame:
    """(spelling, currency, scale, minor, worded): what each distinct spelling says; null where it says nothing."""
    distinct = stash(spellings.select("spelling").where("spelling is not null").distinct(), "spellings")
    words = distinct.select("spelling", F.posexplode(F.regexp_extract_all(F.regexp_replace("spelling", r"\.(?=[a-z]\.|\B|$)", ""), F.lit(_WORD), 0)).alias("pos", "word"))
    dictionary = stash(alias_dictionary(words), "aliases")
    units = words.join(broadcast_if_small(dictionary), "word").groupBy("spelling").agg(F.collect_list(F.struct("pos", "word", "kind", "code", "value")).alias("units"))
    found = units.mapInPandas(_meaning, "spelling string, currency string, scale string, minor string, worded string")
    typed = found.select("spelling", "currency", *[F.col(c).cast(EXACT).alias(c) for c in ("scale", "minor", "worded")])
    return stash(typed, "units")


def in_usd(details: DataFrame, rates: DataFrame) -> DataFrame:
    """(event_id, deal_usd, price_cents) of each distinct row: whole US dollars and US cents, rounded half up; null where nothing is known.

    Figure, currency and scale come from the text where it states them, else from the columns, else plain units and US
    dollars; a figure written in a text without a scale word is in plain units. Amounts that are null, NaN or not
    positive count only with a figure in the text. Unknown currency words count as none; a currency without a rate
    gives null, and so does a value beyond 64 bits. Repeated rows give one row; extra columns are not used; null event ids are ignored.
    """
    columns = ["event_id", "deal_value_amount", "deal_value_currency", "deal_value_scale", "deal_value_text", "per_share_price_amount", "per_share_price_text"]
    rows = details.select(*columns).where("event_id is not null")
    known = lambda c: F.when(~stand_in(clean_key(F.col(c))), spelling(F.col(c)))
    spelt = rows.withColumns({"s_text": known("deal_value_text"), "s_price": known("per_share_price_text"), "s_currency": known("deal_value_currency"), "s_scale": known("deal_value_scale")})
    units = unit_dictionary(spelt.select(F.explode(F.array("s_text", "s_price", "s_currency", "s_scale")).alias("spelling")))
    units = broadcast_if_small(units)
    out = spelt
    for c in ("text", "price", "currency", "scale"):
        out = out.join(units.select(F.col("spelling").alias(f"s_{c}"), F.struct("currency", "scale", "minor", "worded").alias(f"u_{c}")), f"s_{c}", "left")
    positive = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c).try_cast(EXACT))
    stated = F.coalesce(figure(F.col("deal_value_text")), F.col("u_text.worded"))
    currency = F.coalesce("u_text.currency", "u_currency.currency", F.lit("USD"))
    scale = F.coalesce("u_text.scale", F.when(stated.isNotNull(), F.lit(1).cast(EXACT)), "u_scale.scale", F.lit(1).cast(EXACT))
    price = F.coalesce(figure(F.col("per_share_price_text")), F.col("u_price.worded"))
    price_currency = F.coalesce(F.nullif(F.col("u_price.currency"), F.lit("")), currency)
    amounts = out.select(
        "event_id", "deal_value_amount", "per_share_price_amount", currency.alias("code"), price_currency.alias("price_code"),
        F.try_multiply(F.coalesce(stated, positive("deal_value_amount")).try_cast("decimal(30,6)"), scale.cast("decimal(13,0)")).alias("value"),
        F.try_multiply(F.coalesce(price, positive("per_share_price_amount")).try_cast("decimal(24,8)"), F.coalesce("u_price.minor", F.lit(1)).cast("decimal(3,2)")).alias("price"),
    )
    rate = rates.groupBy(F.upper(F.trim("currency")).alias("code")).agg(F.max("usd_per_unit").cast("decimal(18,8)").alias("rate"))
    rate = broadcast_if_small(rate)
    rated = amounts.join(rate, "code", "left").join(rate.select(F.col("code").alias("price_code"), F.col("rate").alias("price_rate")), "price_code", "left")
    whole = lambda x: F.when(x > 0, F.round(x, 0).try_cast("bigint"))
    return rated.select("event_id", "deal_value_amount", "per_share_price_amount", whole(F.try_multiply("value", "rate")).alias("deal_usd"), whole(F.try_multiply("price", (F.col("price_rate") * 100).cast("decimal(18,8)"))).alias("price_cents")).distinct()


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    usd = in_usd(read(spark, base, "ma_details"), read(spark, base, "fx_rate"))
    both = F.array(
        F.struct(F.lit("deal_value").alias("field_name"), F.col("deal_usd").alias("usd_value"), F.col("deal_value_amount").alias("was")),
        F.struct(F.lit("per_share_price").alias("field_name"), F.col("price_cents").alias("usd_value"), F.round(F.col("per_share_price_amount") * 100, 4).alias("was")),
    )
    rows = usd.select("event_id", F.explode(both).alias("x")).select("event_id", "x.field_name", "x.usd_value", "x.was")
    return rows.where("usd_value is not null and not coalesce(cast(usd_value as double) = was, false)").select("event_id", "field_name", "usd_value").distinct()
