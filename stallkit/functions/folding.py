"""Light text folding by JVM expressions, for matching only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic and Greek letters that look like Latin ones, and the Latin letters. Fixed values.
LOOKALIKE_FROM = "аеорсухіјѕАВЕКМНОРСТУХІЈЅԁѡԛοανΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LOOKALIKE_TO = "aeopcyxijsABEKMHOPCTYXIJSdwqoavABEZHIKMNOPTYX"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_SPACES = "".join(map(chr, [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
INVISIBLE = r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u0300-\u036f]"


def _accented() -> tuple[str, str]:
    """Latin letters with accents and their plain letters, by decomposition; and letters with strokes, which have none."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()] + [("ł", "l"), ("Ł", "L"), ("ø", "o"), ("Ø", "O")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED_FROM, ACCENTED_TO = _accented()


def without_accents(text: str) -> str:
    """What ``fold_for_match`` makes of the accents in a text, for patterns and names to be matched."""
    return unicodedata.normalize("NFC", text).translate(str.maketrans(ACCENTED_FROM, ACCENTED_TO))


def fold_for_match(c: Column) -> Column:
    """Full-width forms, odd spaces, look-alike and accented letters become plain; invisible characters and marks go.

    Composed and decomposed letters come out alike. Null stays null.
    """
    plain = F.translate(c, _WIDE + _SPACES + LOOKALIKE_FROM + ACCENTED_FROM, _ASCII + " " * len(_SPACES) + LOOKALIKE_TO + ACCENTED_TO)
    # Texts of ASCII alone have nothing to fold.
    return F.when(c.rlike(r"[^\x00-\x08\x0a-\x7f]"), F.regexp_replace(plain, INVISIBLE, "")).otherwise(c)
