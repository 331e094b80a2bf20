"""Text helpers as column expressions. Null inputs are blank, unless a function says otherwise."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stallkit.functions.vocabulary import sql_text

#: White space of any script.
WS = r"[\s\x{0B}\x{85}\p{Z}]"
#: Names of marketplaces and card games that say nothing of the product. A fixed value.
SITE_NOISE = r"(?<![\p{L}\p{N}_])(eBay\.?de|eBay|Cardmarket|Pokémon TCG|Pokemon TCG)(?![\p{L}\p{N}_])"
#: Currencies and grouped amounts of money. Fixed values.
CURRENCY = r"€|EUR|CHF|US\$|\$|£|GBP"
GROUPED = rf"\d{{1,3}}(?:(?:\.|{WS})\d{{3}})*(?:[,\.]\d{{1,2}})?"
PRICE_NOISE = rf"(?:(?:{CURRENCY}){WS}*{GROUPED}|{GROUPED}{WS}*(?:{CURRENCY}))"
QUERY_LENGTH = 140


def trimmed(c: Column) -> Column:
    """Without white space of any script at the ends; null stays null."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a costly value that it names more than once; the value is worked out once a row."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def literal_map(entries: list[tuple[str, str]]) -> Column:
    """A map literal, built as text since hundreds of separate literals are slow to build."""
    return F.expr("map(" + ", ".join(x for kv in entries for x in map(sql_text, kv)) + ")")


def literal_list(words: list[str]) -> Column:
    return F.expr("array(" + ", ".join(map(sql_text, words)) + ")")


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(html.unescape(t)) if t and "&" in t else t)


def normalized_text(c: Column, entities: bool = True) -> Column:
    """Character entities decoded twice, ends trimmed, runs of white space one space; blank gives ``""``.

    ``entities=False`` keeps the work in the JVM where texts hold none.
    """
    plain = _decoded(c) if entities else c
    return F.coalesce(F.regexp_replace(trimmed(plain), f"{WS}+", " "), F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    """The first that is not blank, as it is; ``""`` if there is none."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in columns], F.lit(""))


def without_site_noise(c: Column) -> Column:
    return F.regexp_replace(c, f"(?iu){SITE_NOISE}", "")


def without_price_noise(c: Column) -> Column:
    return F.regexp_replace(c, f"(?iu){PRICE_NOISE}", "")


def search_query(c: Column, entities: bool = True) -> Column:
    """What to search for to find a titled product: the first part between bars without site names and amounts.

    At most ``QUERY_LENGTH`` code points; blank gives ``""``.
    """
    text = _decoded(c) if entities else c
    first = F.get(F.filter(F.transform(F.split(text, r"\|"), trimmed), lambda x: x != ""), F.lit(0))
    bare = without_price_noise(without_site_noise(F.coalesce(first, text)))
    bare = F.btrim(normalized_text(bare, entities), F.lit("-|:,. "))
    return F.when(is_blank(c), "").otherwise(F.when(F.length(bare) > QUERY_LENGTH, trimmed(F.substring(bare, 1, QUERY_LENGTH))).otherwise(bare))


def css_identifier(c: Column) -> Column:
    """Every sign but ASCII letters, digits, ``_`` and ``-`` becomes ``_``; null stays null."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")
