"""Listing addresses, marketplaces, hosts and enumerations, as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from stallkit.functions.text import is_blank, literal_list, literal_map, trimmed
from stallkit.functions.vocabulary import LOCALE_DOMAINS, MARKETPLACE_DOMAINS, PLATFORMS, PRICE_FLAGS

#: Where listings of marketplaces without addresses of their own are shown; a deployment gives its own.
OTHER_PAGE = "https://example.org/auctions"


def locale_domain(locale: Column) -> Column:
    """The domain ending of a locale, ``com`` for others and null. Case counts."""
    return F.coalesce(F.try_element_at(literal_map(list(LOCALE_DOMAINS.items())), locale), F.lit("com"))


def platform_name(number: Column) -> Column:
    """The marketplace of a stored number; null for null, unknown and negative numbers."""
    return F.get(literal_list(PLATFORMS), number)


def platform_number(name: Column) -> Column:
    """The stored number of a marketplace's name; null if there is none."""
    at = F.array_position(literal_list(PLATFORMS), name)
    return F.when(at > 0, (at - 1).cast("int"))


def price_flags(mask: Column) -> Column:
    """Names of the bits set in a price kind, in order; none for 0, null for null."""
    return F.when(mask.isNotNull(), F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(PRICE_FLAGS)])))


def escaped(c: Column) -> Column:
    """Percent-escapes for everything but the unreserved signs of RFC 3986."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def listing_url(locale: Column, platform: Column, id_: Column, other_page: str = OTHER_PAGE) -> Column:
    """The address of a listing by the number of its marketplace. A null id gives null; an unknown number ``other_page``."""
    name = platform_name(platform)
    slashed = F.concat(F.lit("https://www.marktplaats.nl"), id_)
    return (
        F.when(name == "Ebay", F.concat(F.lit("https://ebay."), locale_domain(locale), F.lit("/itm/"), id_))
        .when(name == "Kleinanzeigen", F.concat(F.lit("https://www.kleinanzeigen.de/s-anzeige/copy/"), id_, F.lit("-1-1")))
        .when(name == "Craigslist", F.concat(F.lit("https://"), id_))
        .when(name == "Facebook", F.concat(F.lit("https://www.facebook.com/marketplace/item/"), id_))
        .when(name == "Willhaben", F.concat(F.lit("https://www.willhaben.at/iad/"), F.regexp_replace(id_, "^/+", "")))
        .when(name == "Gumtree", F.concat(F.lit("https://www.gumtree.com/p/redirect/redirect/"), id_))
        .when(name == "Shpock", F.concat(F.lit("https://www.shpock.com/"), F.coalesce(locale, F.lit("")), F.lit("/i/"), id_))
        .when(name == "Marktplaats", F.when(id_.contains("/"), slashed).otherwise(F.concat(F.lit("https://www.marktplaats.nl/v/redirect/redirect/"), id_, F.lit("-test"))))
        .otherwise(F.concat(F.lit(f"{other_page}?platform="), F.lower(F.coalesce(name, platform.cast("string"), F.lit("unknown"))), F.lit("&id="), escaped(id_)))
    )


def is_web_url(c: Column) -> Column:
    """Whether a text is an absolute http or https address with a host. Whether the host is known does not matter."""
    at = F.when(~is_blank(c), trimmed(c))
    scheme = F.lower(F.try_parse_url(at, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & F.try_parse_url(at, F.lit("HOST")).isNotNull(), F.lit(False))


def url_host(c: Column) -> Column:
    """Host of an address in lower case, null if it has none."""
    return F.lower(F.try_parse_url(trimmed(c), F.lit("HOST")))


def host_matches(host: Column, root: Column | str) -> Column:
    """Whether a host is ``root`` or lies under it; case and dots at the end don't count."""
    h = F.rtrim(F.lower(host), F.lit("."))
    r = F.rtrim(F.lower(F.lit(root) if isinstance(root, str) else root), F.lit("."))
    return F.coalesce((h == r) | h.endswith(F.concat(F.lit("."), r)), F.lit(False))


def marketplace(host: Column) -> Column:
    """The marketplace a host belongs to, or ``External``."""
    out: Column | None = None
    for name, roots in MARKETPLACE_DOMAINS.items():
        any_root = F.exists(literal_list(roots), lambda r: host_matches(host, r))
        out = F.when(any_root, name) if out is None else out.when(any_root, name)
    return out.otherwise("External")


def is_supported_host(host: Column) -> Column:
    return F.exists(literal_list([d for roots in MARKETPLACE_DOMAINS.values() for d in roots]), lambda r: host_matches(host, r))


#: Addresses of machines of one network: loopback, private, link-local, site-local. Ranges of RFC 1918, 3927, 3879, 4193.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V4_PRIVATE = r"^(?:10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\."
_V6 = r"(?i)^(?=.*:.*:)[0-9a-f:.]+(?:%\w+)?$"
_V6_PRIVATE = r"(?i)^fe[89a-f][0-9a-f]:|^f[cd][0-9a-f]{2}:|^[0:]*:0{0,3}1$"


def is_private_address(c: Column) -> Column:
    """Whether a written IP address is of a private range. What is no address counts as private; null stays null."""
    return F.when(c.rlike(_V4), c.rlike(_V4_PRIVATE)).when(c.rlike(_V6), c.rlike(_V6_PRIVATE)).when(c.isNotNull(), F.lit(True))


def resolves_public(addresses: Column) -> Column:
    """Whether there is an address and none is private. Looking hosts up is left to whoever fills the array."""
    return F.coalesce((F.size(addresses) > 0) & F.forall(addresses, lambda a: F.coalesce(~is_private_address(a), F.lit(False))), F.lit(False))


def _join(page: str | None, reference: str | None) -> str:
    try:
        return urljoin(page or "", reference) if reference and reference.strip() else ""
    except ValueError:
        return ""


@F.pandas_udf(StringType())
def resolved_url(page: pd.Series, reference: pd.Series) -> pd.Series:
    """The absolute address of a reference on a page; blank references and failures give ``""``."""
    return pd.Series([_join(p, r) for p, r in zip(page, reference, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def resolved_urls(page: pd.Series, references: pd.Series) -> pd.Series:
    """The absolute addresses of several references on a page; null gives none."""
    return pd.Series([[_join(p, r) for r in rs] if rs is not None else [] for p, rs in zip(page, references, strict=True)], dtype=object)
