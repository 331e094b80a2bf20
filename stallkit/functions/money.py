"""Amounts of money in free text: the asking price, its currency and scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallkit.functions.folding import without_accents

#: Spellings of each currency, in lower case. Fixed values.
SPELLINGS = {
    "EUR": ["eur", "euro", "euros", "€"],
    "USD": ["usd", "us$", "$", "dollar", "dollars", "us dollar", "us dollars", "us-dollar"],
    "GBP": ["gbp", "£", "pfund", "pound", "pounds", "livre sterling", "livres sterling", "britischen pfund", "pounds sterling"],
    "CHF": ["chf", "sfr", "fr", "franken", "francs suisses", "franc suisse", "schweizer franken", "swiss francs"],
    "PLN": ["pln", "zł", "zl", "zloty", "złoty", "złotych", "zlotych", "zlotys"],
    "SEK": ["sek", "skr", "kronor", "svenska kronor", "schwedische kronen"],
    "CZK": ["czk", "kč", "kc", "korun", "tschechische kronen"],
}
#: Spellings of hundredths, and marks before a currency that mean thousands. Fixed values.
HUNDREDTHS = {"EUR": ["cent", "cents", "ct", "eurocent", "eurocents", "eur-cent", "euro-cent", "eurc"], "GBP": ["p", "pence", "penny"], "USD": ["us cent", "us-cent", "us cents"], "CHF": ["rappen", "rp"], "PLN": ["grosz", "groszy", "gr"], "SEK": ["öre"], "CZK": ["haléř"]}
THOUSAND_MARK = r"^(?:k|tsd\.?|tausend|thousand|mille|t)\s*"
SCALES = {"unit": 1.0, "cent": 0.01, "thousand": 1000.0}

_NAME = "|".join(sorted({without_accents(s).replace("$", r"\$") for names in [*SPELLINGS.values(), *HUNDREDTHS.values()] for s in names if s not in ("p", "gr", "rp")}, key=len, reverse=True))
_TOKEN = rf"(?:(?:tsd\.?\s*|tausend\s*|k|t)?(?:{_NAME}))"
_AMOUNT = r"\d{1,3}(?:[ .,'’]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: A currency and an amount, in either order.
_MONEY = rf"(?:({_TOKEN})\.?\s*(?<![\d.,])({_AMOUNT})(?!\d)|(?<![\d.,])({_AMOUNT})\s*({_TOKEN}){_END})"
_CUES = without_accents(r"(?:fest)?preis|price|prix|asking(?: price)?|vb|vhb|fp|ich hätte gern|je demande|cena|pris")
_OFFERS = r"or near offer|o\.?n\.?o|obo|a debattre|vb|vhb|verhandlungsbasis|negotiable"
#: A price with a word before it that asks for it, or one after it that offers to bargain.
ASKING_BEFORE = rf"(?iu){_EDGE}(?:{_CUES})\s*[:=]?\s*{_MONEY}"
ASKING_AFTER = rf"(?iu){_EDGE}{_MONEY}\.?\s*(?:{_OFFERS}){_END}"
#: A title ends with its price, if it has one.
IN_TITLE = rf"(?iu){_EDGE}{_MONEY}\.?\s*$"
#: Words that name the currency of the stated number without repeating the number.
STATED_UNIT = rf"(?iu){_EDGE}(?:preis|price|prix|angaben?|betrag|cena|priset|amounts?|montants?)(?![\p{{L}}])[^.\n\d]{{0,30}}?{_EDGE}({_TOKEN}){_END}"
ONLY_UNIT = rf"(?iu){_EDGE}({_TOKEN})\s+(?:only|nur|seulement){_END}"


#: Words without which the patterns above fit nowhere; looked for first, since that is quick.
STATED_HINT, ONLY_HINT = r"(?i)preis|price|prix|angabe|betrag|cena|priset|amount|montant", r"(?i)only|nur|seulement"


def _lookup_map() -> str:
    """SQL of the map from spellings to ``CODE|scale``; as text, since thousands of separate literals are slow to build."""
    rows = [(without_accents(s), f"{code}|unit") for code, names in SPELLINGS.items() for s in names] + [(without_accents(s), f"{code}|cent") for code, names in HUNDREDTHS.items() for s in names]
    return f"map({', '.join(repr(x) for row in dict(reversed(rows)).items() for x in row)})"


def unit_of(token: Column) -> Column:
    """``struct<code, scale>`` of a spelling, or null when it is blank or unknown. Only GBp differs by case from GBP."""
    clean = F.trim(F.regexp_replace(F.lower(F.trim(token)), r"\.$", ""))
    names = F.expr(_lookup_map())
    base = F.regexp_replace(clean, THOUSAND_MARK, "")
    whole, part = F.try_element_at(names, clean), F.try_element_at(names, base)
    thousand = F.when((base != clean) & part.endswith("|unit"), F.concat(F.substring_index(part, "|", 1), F.lit("|thousand")))
    told = F.when(F.trim(token) == "GBp", "GBP|cent").otherwise(F.coalesce(whole, thousand))
    return F.when(told.isNotNull(), F.struct(F.substring_index(told, "|", 1).alias("code"), F.substring_index(told, "|", -1).alias("scale")))


def amount_of(text: Column) -> Column:
    """The number a written amount means: one or two digits after the last mark are decimals, other marks group."""
    bare = F.regexp_replace(text, r"[ '’]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,]\d{1,2}$", ""), r"[.,]", "")
    return F.concat(whole, F.regexp_replace(F.regexp_extract(bare, r"[.,]\d{1,2}$", 0), ",", ".")).try_cast("double")


def first_money(text: Column, pattern: str) -> Column:
    """The first stretch of ``text`` that fits one of the patterns above, or null. It is short; ``money_in`` reads it."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def money_in(stretch: Column) -> Column:
    """``struct<amount, token>`` of a stretch that ``first_money`` found."""
    part = lambda i: F.regexp_extract(stretch, rf"(?iu){_EDGE}{_MONEY}", i)
    return F.when(stretch.isNotNull(), F.struct(amount_of(F.concat(part(2), part(3))).alias("amount"), F.concat(part(1), part(4)).alias("token")))


def asking_price(title: Column, description: Column) -> Column:
    """The stretch that states the asking price; shipping costs and former prices have no such words. Texts without such a word are not searched."""
    found = [F.when(c.rlike(hint), first_money(c, p)) for c, p, hint in ((description, ASKING_BEFORE, f"(?i){_CUES}"), (description, ASKING_AFTER, f"(?i){_OFFERS}"), (title, IN_TITLE, "[0-9]"))]
    return F.coalesce(*found)


def stated_unit(text: Column) -> Column:
    """The spelling by which the text names the currency of its price, or null."""
    return F.coalesce(*[F.when(text.rlike(hint), F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p, hint in ((STATED_UNIT, STATED_HINT), (ONLY_UNIT, ONLY_HINT))])
