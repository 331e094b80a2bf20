"""Listing search: a builder of predicates, and the latest matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkit.functions.vocabulary import PLATFORMS

EARTH_METRES = 6371008.77
#: Metres of the units a distance may be given in. Fixed values.
DISTANCE_UNITS = {"km": 1000.0, "m": 1.0, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "nmi": 1852.0, "cm": 0.01, "mm": 0.001, "in": 0.0254}
WORDS = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits; null gives null."""
    return F.filter(F.split(F.lower(c), WORDS), lambda x: x != "")


def matches_all(c: Column, query: str) -> Column:
    """Whether every word of ``query`` is a word of the text. A query without words matches everything."""
    asked = F.filter(F.split(F.lower(F.lit(query)), WORDS), lambda x: x != "")
    return F.forall(asked, lambda w: F.coalesce(F.array_contains(tokens(c), w), F.lit(False)))


def price_between(c: Column, min_price: float | None, max_price: float | None) -> Column:
    """From ``min_price`` or 0 to ``max_price``, both included. Without ``max_price`` there is no bound at all."""
    return F.lit(True) if max_price is None else c.between(min_price or 0.0, max_price)


def of_platforms(c: Column, names: Sequence[str]) -> Column:
    """Whether a stored platform number is that of one of the names; no names mean all."""
    return c.isin([PLATFORMS.index(n) for n in names if n in PLATFORMS]) if names else F.lit(True)


def metres(distance: str) -> float:
    """A distance such as ``10km`` in metres; a bare number is metres."""
    text = distance.strip().lower()
    for unit in sorted(DISTANCE_UNITS, key=len, reverse=True):
        if text.endswith(unit):
            return float(text[: -len(unit)]) * DISTANCE_UNITS[unit]
    return float(text)


def metres_between(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Distance along the great circle."""
    dlat, dlon = F.radians(lat - to_lat) / 2, F.radians(lon - to_lon) / 2
    a = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.pow(F.sin(dlon), F.lit(2))
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within(lat: Column, lon: Column, to_lat: float | None, to_lon: float | None, distance: str | None) -> Column:
    """Whether a place lies within a distance; without both coordinates there is no bound. A null place lies nowhere.

    A band of latitudes is asked first: it reaches the scan and leaves few rows for the exact distance.
    """
    if to_lat is None or to_lon is None:
        return F.lit(True)
    if distance is None:
        raise ValueError("coordinates need a distance")
    far = metres(distance)
    lat, lon = lat.cast("double"), lon.cast("double")
    band = far / EARTH_METRES * 57.29577951308232 * 1.001 + 1e-6
    return lat.between(to_lat - band, to_lat + band) & F.coalesce(metres_between(lat, lon, to_lat, to_lon) <= far, F.lit(False))


def search_listings(
    listings: DataFrame, query: str = "", min_price: float | None = None, max_price: float | None = None, latitude: float | None = None, longitude: float | None = None,
    distance: str | None = None, limit: int = 10, platforms: Sequence[str] = (),
) -> DataFrame:
    """The latest listings that fit every condition given, ties by id."""
    fits = price_between(F.col("price"), min_price, max_price) & of_platforms(F.col("platform"), platforms) & within(F.col("latitude"), F.col("longitude"), latitude, longitude, distance)
    return listings.filter(fits & matches_all(F.col("title"), query)).orderBy(F.desc("found_at"), "id").limit(limit)


def has_attribute(attributes: Column, key: str, value: str) -> Column:
    """Whether a list of attribute structs holds the key with that very value."""
    return F.coalesce(F.exists(attributes, lambda a: (a["key"] == key) & (a["value"] == value)), F.lit(False))


def nearest_vectors(vectors: DataFrame, vector: Sequence[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` rows of greatest cosine similarity to a vector, ties by key. Null, empty and zero vectors, and those of another length, are left out."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    own = F.transform(F.col(column), lambda x: x.cast("double"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    norm = lambda c: F.sqrt(add(F.transform(c, lambda x: x * x)))
    both = norm(own) * norm(q)
    like = F.when(both > 0, add(F.zip_with(own, q, lambda a, b: a * b)) / both)
    fits = vectors.filter(F.size(column) == len(vector))
    return fits.select(key, like.alias("similarity")).filter("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


__all__ = ["has_attribute", "matches_all", "metres", "metres_between", "nearest_vectors", "of_platforms", "price_between", "search_listings", "tokens", "within"]
