"""Conditions, colours and product attributes brought to canonical forms, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkit.functions.text import is_blank, literal_list, literal_map, trimmed
from stallkit.functions.vocabulary import COLOUR_ENTRIES, COLOURS, CONDITION_ENTRIES, CONDITION_SIGNS

#: A condition that is no known one is kept up to this length.
LONGEST_CONDITION = 30
#: Known conditions of at least so many letters are also found inside a longer text.
LEAST_CONTAINED = 3


def looks_like_condition(c: Column) -> Column:
    """Whether a lower-case text holds a sign of a condition; null is none."""
    return F.exists(literal_list(CONDITION_SIGNS), lambda sign: F.coalesce(c.contains(sign), F.lit(False)))


def normalized_condition(c: Column) -> Column:
    """``new``, ``used``, ``broken``, ``refurbished`` or ``unknown``, or a short text that looks like another condition.

    A known condition counts before one contained in the text, and of those the first in the list's order counts, not
    the longest. Blank and null give ``unknown``. A second application may change the result.
    """
    low = F.lower(trimmed(c))
    meanings = literal_map(CONDITION_ENTRIES)
    inside = F.get(F.filter(literal_list([w for w, _ in CONDITION_ENTRIES if len(w) >= LEAST_CONTAINED]), lambda w: low.contains(w)), F.lit(0))
    other = F.when((F.length(low) <= LONGEST_CONDITION) & looks_like_condition(low), low)
    return F.when(is_blank(c), "unknown").otherwise(F.coalesce(F.try_element_at(meanings, low), F.try_element_at(meanings, inside), other, F.lit("unknown")))


def is_known_colour(c: Column) -> Column:
    return F.coalesce(F.array_contains(literal_list([w for w, _ in COLOUR_ENTRIES]), F.lower(trimmed(c))), F.lit(False))


def normalized_colour(c: Column) -> Column:
    """The colour a word names; other texts are trimmed, blank ones stay as they are."""
    return F.when(is_blank(c), c).otherwise(F.coalesce(F.try_element_at(literal_map(COLOUR_ENTRIES), F.lower(trimmed(c))), trimmed(c)))


def colour_words(c: Column) -> Column:
    """The colour itself, then every word that names it, without repeats. An unknown colour gives itself alone."""
    words = F.expr("map(" + ", ".join(f"'{k.lower()}', array({', '.join(repr(w) for w in v)})" for k, v in COLOURS.items()) + ")")
    return F.array_distinct(F.concat(F.array(c), F.coalesce(F.try_element_at(words, F.lower(c)), F.array().cast("array<string>"))))


def _compact(v: Column) -> Column:
    for a, b in ((" ", ""), ("gigabyte", "gb"), ("terabyte", "tb")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def _pair(key: Column | str, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))


def classified_attribute(key: Column, value: Column) -> Column:
    """``struct<key, value>``: the attribute a free key and value state, in canonical form.

    Sizes are told apart: a battery, memory, storage or screen size becomes one. A blank key or value leaves the key as it
    is and a null value becomes ``""``. Lengths count code points.
    """
    k, v = F.lower(trimmed(key)), F.lower(trimmed(value))
    as_is = _pair(k, trimmed(value))
    tight = _compact(v)
    digits = r"^\p{Nd}+$"

    memory = _pair(F.replace(k, F.lit("_size"), F.lit("")), F.upper(F.when(tight.rlike(digits), F.concat(tight, F.lit("gb"))).otherwise(tight)))
    material = _pair("material", F.concat(F.upper(F.substring(v, 1, 1)), v.substr(F.lit(2), F.length(v))))

    inch = F.replace(F.translate(v, ",", "."), F.lit(" "), F.lit(""))
    for unit in ("zoll$", "inches$", "inch$", "''"):
        inch = F.regexp_replace(inch, unit, '"')
    bare_number = inch.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$")
    screen = _pair("screen_size", F.when(bare_number, F.concat(inch, F.lit('"'))).otherwise(inch))

    size = _pair("size", trimmed(value))
    frame = (tight.endswith("cm") & (F.length(F.regexp_replace(v, r"[^\p{Nd}.]", "")) == 2)) | F.upper(tight).isin("XS", "S", "M", "L", "XL", "XXL")
    battery = _pair("battery", F.replace(F.upper(F.replace(tight, F.lit("akku"), F.lit(""))), F.lit("MAH"), F.lit("mAh")))
    num = F.regexp_extract(tight, "^[0-9]+", 0).try_cast("int")
    tera = tight.endswith("tb")
    in_units = num.isNotNull() & (tight.endswith("gb") | tera | (tight.rlike(digits) & (F.length(tight) <= 4)))
    ram = _pair("ram", F.concat(num, F.lit("GB")))
    unit = F.when(tera | num.isin(1000, 1024), "TB").otherwise("GB")
    storage = _pair("storage", F.concat(F.when(num.isin(1000, 1024), 1).otherwise(num), unit))
    marked = F.regexp_replace(tight, "zoll|inches|inch|''", '"')
    as_screen = _pair("screen_size", F.concat(marked, F.when(~tight.contains('"') & ~tight.contains("zoll"), '"').otherwise("")))
    sized = (
        F.when(frame, size)
        .when(tight.endswith("mah") | tight.endswith("mahakku"), battery)
        .when(in_units & tight.endswith("gb") & ((num <= 16) | (num == 24)), ram)
        .when(in_units, storage)
        .when(tight.contains('"') | tight.contains("zoll") | tight.contains("inches"), as_screen)
        .otherwise(size)
    )
    return (
        F.when(is_blank(key) | is_blank(value), _pair(key, F.coalesce(value, F.lit(""))))
        .when(k == "color", _pair(k, normalized_colour(value)))
        .when(k.isin("storage", "storage_size", "ram", "ram_size"), memory)
        .when(k == "material", material)
        .when(k.isin("screen_size", "bildschirmgröße", "displaygröße", "bildschirmgroesse"), screen)
        .when(k.isin("size", "größe", "groeße"), sized)
        .otherwise(as_is)
    )


def mapped_once(df: DataFrame, column: str, to: Callable[[Column], Column], name: str) -> DataFrame:
    """``df`` with ``name``, the value of ``to`` for ``column``, worked out once for each different value.

    For columns of few different values and costly functions. Null is a value too. Rows keep all their columns but one
    that is called ``name``.
    """
    values = df.select(F.col(column).alias("_value")).distinct()
    found = values.select("_value", to(F.col("_value")).alias("_found"))
    joined = df.drop(name).join(found, F.col(column).eqNullSafe(F.col("_value")), "left")
    return joined.withColumnRenamed("_found", name).drop("_value")
