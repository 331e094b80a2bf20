"""Prices as pages write them.

A stretch is a run of up to three digits with groups of three, or of plain digits, with a currency on either side or none.
The first alternative wins where it fits, so of an ungrouped amount of four digits or more only three are read at a time:
``1234.56 €`` is 4.56 EUR. Results must agree with that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallkit.functions.text import CURRENCY, GROUPED, WS, is_blank, once

STRETCH = rf"(?:({CURRENCY}){WS}*)?({GROUPED}|\d+(?:[,\.]\d{{1,2}})?)(?:{WS}*({CURRENCY}))?"
#: What a stretch can begin with, looked at first since most signs of a text are nothing of the kind.
_START = r"(?=[\d€$£ECUGecug])"
#: Amounts above it are no prices. A fixed value.
MOST = 100_000


def parsed_amount(c: Column) -> Column:
    """The number a written amount means, null if it means none.

    The last mark is the decimal one, unless it is a dot with three digits after it; other marks group.
    """
    return once(F.regexp_replace(c, r"[\x{A0} ]", ""), _amount)


def _amount(bare: Column) -> Column:
    comma, dot = (F.length(bare) - F.length(F.substring_index(bare, mark, -1)) for mark in ",.")
    tail = F.length(F.substring_index(bare, ".", -1))
    decimal_comma = F.translate(F.replace(bare, F.lit("."), F.lit("")), ",", ".")
    no_comma = F.replace(bare, F.lit(","), F.lit(""))
    decimal_dot = F.when(tail == 3, F.replace(no_comma, F.lit("."), F.lit(""))).otherwise(no_comma)
    number = F.when(comma > dot, decimal_comma).when(dot > comma, decimal_dot).otherwise(bare)
    return once(number, lambda n: F.when(n.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), n.try_cast("double")))


def currency_code(c: Column) -> Column:
    """The code of a written currency; blank means euros, unknown ones come in capitals."""
    up = F.upper(c)
    return F.when(is_blank(c) | up.isin("€", "EUR"), "EUR").when(up.isin("$", "US$"), "USD").when(up.isin("£", "GBP"), "GBP").otherwise(up)


def names_currency(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?iu)€|\$|£|EUR|CHF|GBP"), F.lit(False))


def price_in(c: Column, currency_optional: bool | Column = False) -> Column:
    """``struct<amount, currency>`` of the first stretch with a currency whose amount is above 0 and not above ``MOST``.

    Without one, and if the currency is optional, the first such amount in euros. Null if there is none.
    """
    # One scan of the text finds the stretches; what is in one is read from it alone.
    stretches = F.when(c.rlike("[0-9]"), F.regexp_extract_all(c, F.lit(f"(?iu){_START}{STRETCH}"), F.lit(0)))
    part = lambda x, i: F.regexp_extract(x, f"(?iu){STRETCH}", i)
    parts = F.transform(stretches, lambda x: F.struct(part(x, 1).alias("before"), part(x, 2).alias("amount"), part(x, 3).alias("after")))
    read = lambda x: F.struct(parsed_amount(x["amount"]).alias("amount"), F.concat(x["before"], F.when(x["before"] == "", x["after"]).otherwise("")).alias("sign"))
    usable = F.filter(F.transform(parts, read), lambda x: (x["amount"] > 0) & (x["amount"] <= MOST))
    optional = F.lit(currency_optional) if isinstance(currency_optional, bool) else currency_optional
    first = lambda u: F.coalesce(F.get(F.filter(u, lambda x: x["sign"] != ""), F.lit(0)), F.when(optional, F.get(u, F.lit(0))))
    told = lambda best: F.when(best.isNotNull(), F.struct(best["amount"].alias("amount"), currency_code(best["sign"]).alias("currency")))
    return once(once(usable, first), told)
