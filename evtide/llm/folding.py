"""Folding of look-alike letters and invisible characters, shared by the text operators."""

from __future__ import annotations

import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("авсԁеһіјӏкмнорԛѕтԝхуАВСЕНІЈКМОРЅТХУαεικνορτυχΑΒΕΗΙΚΜΝΟΡΤΥΧΖаɑɡıℓ", "abcdehijlkmhopqstwxyABCEHIJKMOPSTXYaeiknoptuxABEHIKMNOPTYXZaagil", strict=True))


class LookAlikes(dict):
    """str.translate table that keeps the length: a look-alike or compatibility letter becomes its plain letter."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        plain = LOOK_ALIKES.get(c)
        if plain is None and code > 0x2000:
            folded = unicodedata.normalize("NFKC", c)
            plain = folded if len(folded) == 1 else None
        self[code] = ord(plain) if plain else code
        return self[code]


class Letters(dict):
    """str.translate table to lower-case letters and digits without accents: invisible characters vanish, all others become blanks."""

    def __missing__(self, code: int) -> str:
        c = LOOK_ALIKES.get(chr(code), chr(code))
        if unicodedata.category(c) in ("Cf", "Mn", "Me"):
            out = ""
        else:
            out = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            out = "".join(x if x.isalnum() else " " for x in out)
        self[code] = out
        return out


LOOK, LETTERS = LookAlikes(), Letters()


def same_length_fold(text: str) -> str:
    """text with look-alikes made plain, each character at its place."""
    return text if text.isascii() else text.translate(LOOK)


def same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)
