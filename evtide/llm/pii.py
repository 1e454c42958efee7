"""Personal information in free text replaced by typed placeholders.

One Aho-Corasick pass finds anchors (at-signs, cues of numbers, street words, given names, titles); at each anchor a
deterministic parser expands to the exact span and validates it. Texts are read whole; nothing outside spans changes.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.llm.folding import same_length_fold, same_length_lower
from evtide.runtime import read

EMAIL, PHONE, ID, STREET, NAME = "email", "phone", "id_number", "street_address", "person_name"
#: Of overlapping spans the kind that comes first here stays.
ORDER = (EMAIL, ID, PHONE, STREET, NAME)

#: Common given names of several languages.
GIVEN_NAMES = """
aaron adam ahmed aisha alan albert alejandro alex alexander ali alice amanda amy ana andre andrea andrew angela anita anna
anne anthony antonio barbara benjamin bernard brian camille carla carlos carmen caroline catherine charles charlotte
chen christian christine claire clara claudia daniel david deborah diana diego dmitri edward elena elizabeth emily emma
eric erik eva fatima felix fiona francesca francis francois frank gabriel george giovanni giulia grace hannah hans
harry hassan heather heinrich helen helena henri henrik henry hiroshi ibrahim igor ines ingrid irene isabel ivan jack
jacques james jane javier jean jennifer jessica joan johan john jonas jorge jose joseph juan julia julie jurgen karen karl
kate katherine kenji kevin klaus laura leila leo linda lisa louis lucas lucia luis lukas magnus manuel marco margaret
maria marie mario mark martin mary matteo matthew mei michael michel mohammed monica nadia naomi natalia nicolas nina
nora olga oliver omar oscar otto pablo patricia paul pedro peter philip pierre priya rachel rahul raj ravi richard robert
roberto rosa ruth samuel sandra sara sarah sergei silvia simon sofia sophie stefan stephen steven sunita susan thomas
tomas ursula valerie vera victor vincent walter wei wilhelm william yuki yusuf
""".split()
#: Titles before a name; particles inside one.
TITLES = ["mr.", "mrs.", "ms.", "dr.", "prof.", "herr", "frau", "mme", "mlle", "monsieur", "madame", "señor", "señora", "sr.", "sra.", "sir", "mr", "mrs", "ms", "dr"]
PARTICLES = "van der|van den|van de|van|von der|von|de la|de los|de|del|della|da|dos|di|du|der|den|ter|ten|la|le|el|al|bin|ibn"
#: Words that a capitalised word after a given name may be without being a family name.
NOT_FAMILY = frozenset("""
street st avenue ave road rd lane drive blvd boulevard court square inc incorporated corp corporation co company ltd limited plc llc ag
sa nv gmbh group holdings holding bancorp bank insurance foods water energy media mining shipping airways chemical textiles
robotics logistics manufacturing properties semiconductor technologies telecommunications therapeutics pharmaceuticals
january february march april may june july august september october november december monday tuesday wednesday thursday
friday saturday sunday and or the of in at
""".split())
#: Cues of telephone and identity numbers.
PHONE_CUES = ["tel", "phone", "telephone", "telefon", "téléphone", "teléfono", "call", "ring", "dial", "dial-in", "fax", "mobile", "cell", "ph.", "t:", "m:", "p:", "hotline"]
ID_CUES = ["ssn", "social", "social security", "national insurance", "nino", "ni number", "ni no", "passport", "reisepass", "passeport", "pasaporte", "identity card", "id card", "personalausweis", "national id", "tax id", "tax identification", "taxpayer", "tin", "steuer-id", "steuernummer", "utr", "nif", "dni", "itin"]
AT_SIGNS = ["@", "(at)", "[at]", "{at}", "<at>", " at "]
STREETS_AFTER = ["street", "st", "st.", "avenue", "ave", "ave.", "road", "rd", "rd.", "lane", "ln", "ln.", "drive", "dr.", "boulevard", "blvd", "blvd.", "court", "square", "terrace", "crescent", "place", "parkway", "pkwy"]
STREETS_WORD_END = ["straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ufer"]
STREETS_BEFORE = ["rue", "boulevard", "avenue", "quai", "chemin", "impasse", "calle", "avenida", "plaza", "paseo", "via"]

#: Words of mailboxes that belong to no person.
ROLE_WORDS = frozenset("investor relations press office media info contact news support sales service team desk help admin editor".split())
#: Characters around an address in which its owner's name is looked for.
NEAR = 80

_HYPHENS = r"\-‐‑–"
_LOCAL = re.compile(r"[\w.%+'-]+$")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|\s?[\[({{<]\s?dot\s?[\])}}>]\s?|\sdot\s){_LABEL})+", re.I)
_AT = re.compile(r"\s?(?:@|[\[({<]\s?at\s?[\])}>]|(?<=\s)at(?=\s))\s?", re.I)

_TO_NUMBER = re.compile(rf"(?:[a-z{_HYPHENS}]+)?(?:[ .:]{{0,3}}(?:us|me|on|at|is|no\.?|number|nr\.?|in|our|desk|line)\b)*[\s.:#]{{0,3}}(?=[+(\d])", re.I)
_NUMBER = re.compile(rf"\+?\(?\d(?:(?:[ .\xa0{_HYPHENS}()]|\s/\s|/){{0,3}}\d){{6,16}}")
_EXTENSION = re.compile(r"[ ,;]{0,2}(?:ext\.?|extension|x|#|Durchwahl|poste)[ .:]{0,2}\d{1,6}\b", re.I)
_PLUS = re.compile(r"\+|(?<![\w.,/-])00(?=[1-9]\d)")
_UNCUED = re.compile(rf"(?<![\w.,/+{_HYPHENS}|])(?:\(\d{{3}}\) ?|\d{{3}}([.{_HYPHENS} ]))\d{{3}}(?(1)\1|[.{_HYPHENS} ])\d{{4}}(?![\w|])")

_TO_ID = re.compile(r"(?:\s*(?:card|number|no\.?|nr\.?|num\.?|code|id(?![-\w])|#|n°|is))*\s*[:#]?\s*", re.I)
_NI = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b")
_ID = re.compile(rf"[A-Z]{{0,4}}[{_HYPHENS} ]?\d[0-9A-Z]*(?:[ ./{_HYPHENS}]\d[0-9A-Z]*)*")

_UNIT = re.compile(r",? (?:#\s?\d+[A-Za-z]?|(?:Apt|Apartment|Suite|Ste|Unit|Flat|Room|Rm|Floor|Fl)\b\.? ?#?\d*[A-Za-z]?(?<=[\dA-Za-z]))")
_STREET_LEFT = re.compile(r"(?<![\w.,/-])\d{1,5}(?:[A-Za-z]|-\d+)?,? (?:(?:[NSEW]|NE|NW|SE|SW)\.? |(?:North|South|East|West) )?(?:(?:[A-ZÀ-Þ][\w'’.-]*|\d{1,3}(?:st|nd|rd|th)) ){1,4}$")
_HOUSE = r"\d{1,4}(?: ?(?:bis|ter|quater)| ?[a-z]\b)?"
_HOUSE_AFTER = re.compile(rf",? {_HOUSE}(?![\w])")
_HOUSE_BEFORE = re.compile(rf"(?<![\w.,/-]){_HOUSE},? $")
_ROMANCE = re.compile(r"(?: (?:de|du|des|del|la|las|le|les|los|d'|l'))*(?:[ '’](?:[A-ZÀ-Þ][\w'’-]*)){1,3}")

_FAMILY = r"(?:O['’]|D['’]|Mc|Mac)?[A-ZÀ-Þ][^\W\d_]+"
_FAMILIES = rf"{_FAMILY}(?:[-‐‑]{_FAMILY})*"
_INITIALS = r"(?:[ \xa0][A-ZÀ-Þ]\.(?:[-]?[A-ZÀ-Þ]\.)*)*"
_AFTER = re.compile(rf"{_INITIALS}[ \xa0](?:(?:{PARTICLES})[ \xa0])*({_FAMILIES})(?![\w])")
_AFTER_UPPER = re.compile(rf"{_INITIALS}[ \xa0](?:(?:{PARTICLES.upper()})[ \xa0])*((?:O['’]|D['’])?[A-ZÀ-Þ]{{2,}}(?:[-‐‑](?:O['’])?[A-ZÀ-Þ]{{2,}})*)(?![\w])")
_AFTER_LOWER = re.compile(rf"(?:[ \xa0][a-z]\.)*[ \xa0](?:(?:{PARTICLES})[ \xa0])*((?:o['’])?[^\W\d_]{{3,}}(?:[-‐‑](?:o['’])?[^\W\d_]+)*)(?![\w])")
_BEFORE = re.compile(rf"(?:^|\n|[:;(>•]\s?)((?:(?:{PARTICLES}|{PARTICLES.upper()})[ \xa0])*{_FAMILIES},[ \xa0])$")
_MORE_INITIALS = re.compile(r"(?:[ \xa0][A-ZÀ-Þ]\.)+")
_SIGN_OFF = re.compile(r"(?:thanks|regards|cheers|best|sincerely|contact|from|attn|cc)[,:]?\s+$", re.I)
_FULL_NAME = re.compile(rf"(?<!\w)([A-ZÀ-Þ][^\W\d_]+){_INITIALS}[ \xa0](?:(?:{PARTICLES})[ \xa0])*({_FAMILIES})(?!\w)")
_STREET_NEXT = re.compile(r"[ \xa0](?:Street|Avenue|Ave|Road|Lane|Drive|Boulevard|Blvd|Square|Place|Platz|Straße)\b")
_TITLED = re.compile(rf"\.?[ \xa0](?=([A-ZÀ-Þ][^\W\d_]+)({_AFTER.pattern}))")


class Accents(dict):
    """str.translate table that keeps the length: an accented letter becomes its plain letter."""

    def __missing__(self, code: int) -> int:
        plain = unicodedata.normalize("NFD", chr(code))
        self[code] = ord(plain[0]) if code > 127 and len(plain) > 1 and unicodedata.combining(plain[1]) else code
        return self[code]


_ACCENTS = Accents()


def unaccented(text: str) -> str:
    return text if text.isascii() else text.translate(_ACCENTS)


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[str]] = {}
    for kind, words in (("at", AT_SIGNS), ("phone", PHONE_CUES), ("id", ID_CUES), ("street", STREETS_AFTER), ("strasse", STREETS_WORD_END), ("rue", STREETS_BEFORE), ("given", GIVEN_NAMES), ("title", TITLES)):
        for w in words:
            kinds = found.setdefault(unaccented(w), [])
            if kind not in kinds:
                kinds.append(kind)
    out = ahocorasick.Automaton()
    for w, kinds in found.items():
        out.add_word(w, (len(w), tuple(kinds)))
    out.make_automaton()
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """find(text): the spans (start, end, kind) of personal information, in order and without overlaps."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        original, text = text, same_length_fold(text)
        low, n = unaccented(same_length_lower(text)), len(text)
        spans: list[tuple[int, int, str]] = []
        for last, (length, kinds) in self.anchors.iter(low):
            start, end = last + 1 - length, last + 1
            left = start == 0 or not _word(text[start - 1])
            right = end == n or not _word(text[end]) or not _word(text[end - 1])
            for kind in kinds:
                if kind == "given":
                    span = self._name(text, start, end) if left and right else None
                elif kind == "title":
                    span = self._titled(text, end) if left and right else None
                elif kind == "street":
                    span = self._street(text, start, end) if left and right else None
                elif kind == "strasse":
                    span = self._strasse(text, start, end) if right else None
                elif kind == "at":
                    span = self._email(text, start, end)
                elif kind == "rue":
                    span = self._rue(text, start, end) if left and right else None
                elif kind == "phone":
                    span = self._phone(text, end) if left else None
                else:
                    span = self._id(text, end) if left and right else None
                if span:
                    spans.append(span)
        if "+" in text or "00" in text:
            spans += [s for m in _PLUS.finditer(text) if (s := self._number(text, m.start()))]
        spans += [(m.start(), self._extended(text, m.end()), PHONE) for m in _UNCUED.finditer(text)]
        for a, b, kind in set(spans):
            if kind == EMAIL:
                spans += self._owners(text, a, b)
        return self._resolve(spans) if spans else []

    @staticmethod
    def _resolve(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The spans without overlaps: the kind that comes first stays, of one kind the longest. Kept spans stay in order, so that only the two neighbours need a look."""
        kept: list[tuple[int, int, str]] = []
        for span in sorted(set(spans), key=lambda s: (ORDER.index(s[2]), s[0] - s[1], s[0])):
            i = bisect.bisect(kept, span)
            if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or kept[i][0] >= span[1]):
                kept.insert(i, span)
        return kept

    @staticmethod
    def _owners(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
        """Names near an email address whose local part is made of them, whatever the names."""
        local = re.split(r"[^a-z]+", unaccented(_AT.split(text[start:end].lower(), maxsplit=1)[0]))
        tokens = {w for w in local if len(w) >= 3}
        if not tokens or tokens & ROLE_WORDS:
            return
        for a, b in ((max(0, start - NEAR), start), (end, end + NEAR)):
            for m in _FULL_NAME.finditer(text, a, min(b, len(text))):
                given, family = unaccented(m[1].lower()), unaccented(m[2].lower())
                if {given, family} & (NOT_FAMILY | ROLE_WORDS):
                    continue
                if tokens & {given[0] + family, given + family, family + given[0], family + given} or family in tokens and (given in tokens or given[0] in local):
                    yield m.start(), m.end(), NAME

    @staticmethod
    def _email(text: str, start: int, end: int) -> tuple[int, int, str] | None:
        while start > 0 and text[start - 1] == " " and text[start] != " ":
            start -= 1
        at = _AT.match(text, start)
        if not at:
            return None
        local = _LOCAL.search(text[max(0, start - 64) : start])
        domain = _DOMAIN.match(text, at.end())
        if not local or not domain:
            return None
        name = local[0].lstrip(".'-+%")
        if not name or not any(c.isalnum() for c in name) or not re.search(r"[A-Za-z]{2,}$", domain[0]):
            return None
        if at[0].strip().lower() == "at" and "dot" not in domain[0].lower():  # plain "at" is a word unless the dots are written out too
            return None
        return start - len(name), domain.end(), EMAIL

    @staticmethod
    def _extended(text: str, end: int) -> int:
        extension = _EXTENSION.match(text, end)
        return extension.end() if extension else end

    def _number(self, text: str, at: int) -> tuple[int, int, str] | None:
        m = _NUMBER.match(text, at)
        if not m:
            return None
        digits, end = sum(c.isdigit() for c in m[0]), m.end()
        if not 7 <= digits <= 15 or (end < len(text) and _word(text[end]) and text[end] not in "xX") or m[0].count("(") != m[0].count(")"):
            return None
        return at, self._extended(text, end), PHONE

    def _phone(self, text: str, end: int) -> tuple[int, int, str] | None:
        m = _TO_NUMBER.match(text, end)
        return self._number(text, m.end()) if m else None

    @staticmethod
    def _id(text: str, end: int) -> tuple[int, int, str] | None:
        at = _TO_ID.match(text, end).end()
        if at == end:
            return None
        m = _NI.match(text, at) or _ID.match(text, at)
        if not m or not 5 <= sum(c.isdigit() for c in m[0]) <= 14:
            return None
        return at, m.end(), ID

    @staticmethod
    def _street(text: str, start: int, end: int) -> tuple[int, int, str] | None:
        left = _STREET_LEFT.search(text[max(0, start - 70) : start])
        if not left:
            return None
        if text[end - 1] != "." and text[end : end + 1] == "." and end - start <= 4 and (text[end + 1 : end + 2] == "," or not re.match(r"\.\s+[A-Z]|\.$|\.\n", text[end : end + 4])):
            end += 1
        unit = _UNIT.match(text, end)
        return start - len(left[0]), unit.end() if unit else end, STREET

    @staticmethod
    def _strasse(text: str, start: int, end: int) -> tuple[int, int, str] | None:
        house = _HOUSE_AFTER.match(text, end)
        while start > 0 and (text[start - 1].isalpha() or text[start - 1] in "-"):
            start -= 1
        if not house or not text[start].isupper():
            return None
        more = re.search(r"((?:[A-ZÄÖÜ][\w]+-)*(?:Am|An der|Alte|Neue|Große|Kleine) )$", text[max(0, start - 24) : start])
        return start - (len(more[0]) if more else 0), house.end(), STREET

    @staticmethod
    def _rue(text: str, start: int, end: int) -> tuple[int, int, str] | None:
        name = _ROMANCE.match(text, end)
        if not name:
            return None
        before = _HOUSE_BEFORE.search(text[max(0, start - 14) : start])
        if before:
            return start - len(before[0]), name.end(), STREET
        after = _HOUSE_AFTER.match(text, name.end())
        return (start, after.end(), STREET) if after else None

    @staticmethod
    def _name(text: str, start: int, end: int) -> tuple[int, int, str] | None:
        given = text[start:end]
        if given.isupper():
            m = _AFTER_UPPER.match(text, end)
        elif given[0].isupper():
            m = _AFTER.match(text, end)
        else:
            m = _AFTER_LOWER.match(text, end) if _SIGN_OFF.search(text[max(0, start - 16) : start]) else None
        if m and m[1].lower() not in NOT_FAMILY and not _STREET_NEXT.match(text, m.end()):
            return start, m.end(), NAME
        if given[0].isupper() and (before := _BEFORE.search(text[max(0, start - 60) : start])) and before[1].rstrip(", \xa0").lower() not in NOT_FAMILY:
            more = _MORE_INITIALS.match(text, end)
            return start - len(before[1]), more.end() if more else end, NAME
        return None

    @staticmethod
    def _titled(text: str, end: int) -> tuple[int, int, str] | None:
        m = _TITLED.match(text, end)
        if not m or m[1].lower() in NOT_FAMILY or m[3].lower() in NOT_FAMILY:
            return None
        return m.end(), m.end(2), NAME

    def redact(self, text: str) -> str:
        out, done = [], 0
        for a, b, kind in self.find(text):
            out += [text[done:a], f"[{kind.upper()}]"]
            done = b
        return "".join([*out, text[done:]])


_finder: Finder | None = None


def finder() -> Finder:
    global _finder
    if _finder is None:
        _finder = Finder()
    return _finder


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = finder().find
    for pdf in batches:
        rows = [(i, kind, text[a:b]) for i, text in zip(pdf["id"], pdf["text"], strict=True) for a, b, kind in find(text)]
        yield pd.DataFrame(rows, columns=["id", "pii_type", "pii_text"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    redact = finder().redact
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "text": [redact(t) for t in pdf["text"]]})


def find_pii(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pii_type, pii_text), distinct: what each text holds. Null and empty texts give no rows; extra columns are not used; ids may repeat."""
    slim = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text <> ''")
    return slim.mapInPandas(_found, f"id {slim.schema['id'].dataType.simpleString()}, pii_type string, pii_text string").distinct()


def redact_pii(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text) with each span replaced by a placeholder such as [EMAIL]; a null text stays null, rows are neither lost nor merged."""
    slim = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    done = slim.where("text is not null").mapInPandas(_redacted, f"id {slim.schema['id'].dataType.simpleString()}, text string")
    return done.unionByName(slim.where("text is null"))


def p10_redacted(spark: SparkSession, base: str) -> DataFrame:
    return redact_pii(read(spark, base, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return find_pii(read(spark, base, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
