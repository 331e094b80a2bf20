"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.functions import attributes as A
from stallkit.functions import links as L
from stallkit.functions import price_text as P
from stallkit.functions import text as T
from stallkit.functions.vocabulary import COLOUR_ENTRIES, COLOURS, CONDITION_ENTRIES, CONDITION_SIGNS, LOCALE_DOMAINS, MARKETPLACE_DOMAINS, PLATFORMS, PRICE_FLAGS, sql_list, sql_map
from stallkit.plans.registry import query
from stallkit.sources.tables import table

WS = T.WS


def trim_sql(c: str) -> str:
    """SQL of a text without white space at the ends."""
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def text_sql(c: str) -> str:
    """SQL of normalised text without entities."""
    return f"coalesce(regexp_replace({trim_sql(c)}, '{WS}+', ' ', 'g'), '')"


def _sign(v: str) -> str:
    return f"len(list_filter({sql_list(CONDITION_SIGNS)}, lambda s: contains({v}, s))) > 0"


def _listings(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    return table(spark, folder, "listings").select("id", "found_at", *columns)


def _entries(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "ordinal int, word string, meaning string")


def _values(entries: list[tuple[str, str]]) -> str:
    m = sql_map(entries)
    return f"SELECT (i - 1)::INT AS ordinal, map_keys(m)[i] AS word, map_values(m)[i] AS meaning FROM (SELECT {m} AS m), range(1, {len(entries) + 1}) t(i)"


@query(f"""
    SELECT product_seo_id, listing_id, condition, CASE WHEN condition IS NULL OR v = '' THEN 'unknown' ELSE coalesce(m[v],
        m[list_filter(map_keys(m), lambda k: length(k) >= 3 AND contains(v, k))[1]],
        CASE WHEN length(v) <= 30 AND {_sign("v")} THEN v END, 'unknown') END AS normalized
    FROM (SELECT product_seo_id, listing_id, condition, lower({trim_sql("condition")}) AS v FROM product_listings), (SELECT {sql_map(CONDITION_ENTRIES)} AS m)""")
def n1_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical condition of every product listing."""
    rows = table(spark, folder, "product_listings").select("product_seo_id", "listing_id", "condition")
    return A.mapped_once(rows, "condition", A.normalized_condition, "normalized")


@query(f"SELECT seo_id, condition, coalesce({_sign('lower(condition)')} AND condition IS NOT NULL, false) AS likely FROM products")
def n2_likely_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("seo_id", "condition", A.looks_like_condition(F.lower("condition")).alias("likely"))


@query(_values(CONDITION_ENTRIES))
def n3_condition_words(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, CONDITION_ENTRIES)


@query(_values(COLOUR_ENTRIES))
def n7_colour_words(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, COLOUR_ENTRIES)


def _attributes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select("id", "found_at", F.explode("attributes").alias("raw_key", "raw_value"))


_ATTRIBUTES = "SELECT id, found_at, unnest(map_keys(attributes)) AS raw_key, unnest(map_values(attributes)) AS raw_value FROM listings WHERE attributes IS NOT NULL"


@query(f"SELECT id, found_at, raw_value, coalesce(list_contains({sql_list([w for w, _ in COLOUR_ENTRIES])}, lower({trim_sql('raw_value')})), false) AS known FROM ({_ATTRIBUTES})")
def n4_known_colours(spark: SparkSession, folder: str) -> DataFrame:
    return _attributes(spark, folder).select("id", "found_at", "raw_value", A.is_known_colour(F.col("raw_value")).alias("known"))


@query(f"""SELECT id, found_at, raw_value, CASE WHEN {trim_sql("raw_value")} = '' THEN raw_value ELSE coalesce({sql_map(COLOUR_ENTRIES)}[lower({trim_sql("raw_value")})], {trim_sql("raw_value")}) END AS colour
    FROM ({_ATTRIBUTES}) WHERE lower(raw_key) IN ('color', 'farbe', 'couleur')""")
def n5_colours(spark: SparkSession, folder: str) -> DataFrame:
    """The colour every listing's colour attribute names."""
    rows = _attributes(spark, folder).filter(F.lower("raw_key").isin("color", "farbe", "couleur"))
    return rows.select("id", "found_at", "raw_value", A.normalized_colour(F.col("raw_value")).alias("colour"))


_COLOUR_LISTS = "MAP {" + ", ".join(f"'{k.lower()}': {sql_list(v)}" for k, v in COLOURS.items()) + "}"


@query(f"""SELECT seo_id, colour, array_to_string(list_concat([colour], list_filter(coalesce({_COLOUR_LISTS}[lower(colour)], []), lambda w: w <> colour)), '|') AS words
    FROM (SELECT seo_id, attributes['color'] AS colour FROM products) WHERE colour IS NOT NULL""")
def n6_colour_words_of_products(spark: SparkSession, folder: str) -> DataFrame:
    """Every word for the colour of every product that has one."""
    rows = table(spark, folder, "products").select("seo_id", F.try_element_at("attributes", F.lit("color")).alias("colour")).filter("colour is not null")
    return rows.select("seo_id", "colour", F.array_join(A.colour_words(F.col("colour")), "|").alias("words"))


def _compact_sql(v: str) -> str:
    return f"replace(replace(replace({v}, ' ', ''), 'gigabyte', 'gb'), 'terabyte', 'tb')"


_CLASSIFIED = f"""
    WITH raw AS ({_ATTRIBUTES}), entered AS (SELECT * FROM raw UNION ALL SELECT id, found_at, 'size', raw_value FROM raw UNION ALL SELECT id, found_at, 'screen_size', raw_value FROM raw),
    v AS (SELECT *, lower({trim_sql("raw_key")}) AS k, lower({trim_sql("raw_value")}) AS v, {trim_sql("raw_value")} AS bare FROM entered),
    t AS (SELECT *, {_compact_sql("v")} AS t, regexp_replace(regexp_replace(regexp_replace(replace(replace(v, ',', '.'), ' ', ''), 'zoll$', '"'), 'inche?s?$', '"'), '''''', '"', 'g') AS inch,
        TRY_CAST(nullif(regexp_extract({_compact_sql("v")}, '^[0-9]+'), '') AS INT) AS num FROM v),
    c AS (SELECT *, CASE WHEN num IS NOT NULL AND (t LIKE '%gb' OR t LIKE '%tb' OR (regexp_full_match(t, '[0-9]+') AND length(t) <= 4)) THEN true ELSE false END AS in_units,
        CASE WHEN raw_key IS NULL OR k = '' OR raw_value IS NULL OR v = '' THEN 'blank' WHEN k = 'color' THEN 'color' WHEN k IN ('storage', 'storage_size', 'ram', 'ram_size') THEN 'memory'
        WHEN k = 'material' THEN 'material' WHEN k IN ('screen_size', 'bildschirmgröße', 'displaygröße', 'bildschirmgroesse') THEN 'screen' WHEN k IN ('size', 'größe', 'groeße') THEN 'size' ELSE 'other' END AS branch FROM t),
    d AS (SELECT *, CASE WHEN branch <> 'size' THEN branch WHEN (t LIKE '%cm' AND length(regexp_replace(v, '[^0-9.]', '', 'g')) = 2) OR upper(t) IN ('XS', 'S', 'M', 'L', 'XL', 'XXL') THEN 'size' WHEN t LIKE '%mah' OR t LIKE '%mahakku' THEN 'battery'
        WHEN in_units AND t LIKE '%gb' AND (num <= 16 OR num = 24) THEN 'ram' WHEN in_units THEN 'storage' WHEN contains(t, '"') OR contains(t, 'zoll') OR contains(t, 'inches') THEN 'inches' ELSE 'size' END AS kind FROM c)
    SELECT id, found_at, raw_key, raw_value,
        CASE kind WHEN 'blank' THEN raw_key WHEN 'memory' THEN replace(k, '_size', '') WHEN 'screen' THEN 'screen_size' WHEN 'inches' THEN 'screen_size' WHEN 'size' THEN 'size' WHEN 'battery' THEN 'battery' WHEN 'ram' THEN 'ram'
            WHEN 'storage' THEN 'storage' ELSE k END AS key,
        CASE kind WHEN 'blank' THEN coalesce(raw_value, '') WHEN 'color' THEN coalesce({sql_map(COLOUR_ENTRIES)}[v], bare) WHEN 'memory' THEN upper(t || CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'gb' ELSE '' END)
            WHEN 'material' THEN upper(v[1]) || v[2:] WHEN 'screen' THEN inch || CASE WHEN regexp_full_match(inch, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') THEN '"' ELSE '' END
            WHEN 'battery' THEN replace(upper(replace(t, 'akku', '')), 'MAH', 'mAh') WHEN 'ram' THEN num || 'GB'
            WHEN 'storage' THEN (CASE WHEN num IN (1000, 1024) THEN 1 ELSE num END) || (CASE WHEN num IN (1000, 1024) OR t LIKE '%tb' THEN 'TB' ELSE 'GB' END)
            WHEN 'inches' THEN regexp_replace(t, 'zoll|inches|inch|''''', '"', 'g') || CASE WHEN NOT contains(t, '"') AND NOT contains(t, 'zoll') THEN '"' ELSE '' END
            ELSE bare END AS value FROM d"""


@query(_CLASSIFIED)
def n8_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical key and value of every listing's attributes, as entered and as a size and a screen size."""
    raw = _attributes(spark, folder)
    both = raw.withColumn("raw_key", F.explode(F.array("raw_key", F.lit("size"), F.lit("screen_size"))))
    return both.select("*", A.classified_attribute(F.col("raw_key"), F.col("raw_value")).alias("a")).select("id", "found_at", "raw_key", "raw_value", "a.key", "a.value")


@query(f"SELECT id, found_at, {text_sql('description')} AS text FROM listings")
def t1_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing's description on one line."""
    return _listings(spark, folder, T.normalized_text(F.col("description")).alias("text"))


@query("SELECT id, found_at, coalesce(CASE WHEN trim(description_short) <> '' THEN description_short END, CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(title) <> '' THEN title END, '') AS text FROM listings")
def t2_first_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, T.first_non_empty(F.col("description_short"), F.col("description"), F.col("title")).alias("text"))


_AMOUNT_SQL = r"""CASE WHEN instr(reverse(b), ',') > 0 AND (instr(reverse(b), '.') = 0 OR instr(reverse(b), ',') < instr(reverse(b), '.')) THEN replace(replace(b, '.', ''), ',', '.')
    WHEN instr(reverse(b), '.') > 0 THEN CASE WHEN instr(reverse(b), '.') = 4 THEN replace(replace(b, ',', ''), '.', '') ELSE replace(b, ',', '') END ELSE b END"""
_CODE_SQL = "CASE upper({0}) WHEN '' THEN 'EUR' WHEN '€' THEN 'EUR' WHEN 'EUR' THEN 'EUR' WHEN '$' THEN 'USD' WHEN 'US$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN 'GBP' THEN 'GBP' ELSE upper({0}) END"


def price_sql(column: str, optional: bool, source: str = "listings") -> str:
    """SQL of the price in a text column of rows with id and found_at."""
    group = lambda i: f"list_transform(regexp_extract_all({column}, '(?i){P.STRETCH}', {i}), lambda x: coalesce(x, ''))"
    return f"""
    WITH s AS (SELECT id, found_at, unnest({group(1)}) AS a, replace(replace(unnest({group(2)}), chr(160), ''), ' ', '') AS b, unnest({group(3)}) AS c, generate_subscripts({group(2)}, 1) AS i, row_number() OVER () AS r FROM
            {source}),
        k AS (SELECT id, found_at, i, CASE WHEN a <> '' THEN a ELSE c END AS sign, CASE WHEN regexp_full_match({_AMOUNT_SQL}, '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN TRY_CAST({_AMOUNT_SQL} AS DOUBLE) END AS amount FROM s),
        best AS (SELECT id, found_at, arg_min(amount, (CASE WHEN sign <> '' THEN 0 ELSE 1000000 END) + i) AS amount, arg_min(sign, (CASE WHEN sign <> '' THEN 0 ELSE 1000000 END) + i) AS sign FROM k
            WHERE amount > 0 AND amount <= {P.MOST} AND (sign <> '' OR {optional}) GROUP BY ALL)
    SELECT l.id, l.found_at, best.amount, CASE WHEN best.amount IS NOT NULL THEN {_CODE_SQL.format("best.sign")} END AS currency FROM {source} l LEFT JOIN best ON best.id = l.id AND best.found_at = l.found_at"""


@query(price_sql("title", False))
def t3_title_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The first price with a currency in every listing's title."""
    return _listings(spark, folder, P.price_in(F.col("title")).alias("p")).select("id", "found_at", "p.amount", "p.currency")


@query(price_sql("description", True))
def t3_description_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The first price in every listing's description, the currency being optional."""
    return _listings(spark, folder, P.price_in(F.col("description"), True).alias("p")).select("id", "found_at", "p.amount", "p.currency")


@query(rf"""SELECT id, found_at, raw, CASE WHEN regexp_full_match(v, '[0-9]+\.?[0-9]*|\.[0-9]+') THEN TRY_CAST(v AS DOUBLE) END AS amount FROM (
        SELECT id, found_at, raw, {_AMOUNT_SQL} AS v FROM (SELECT id, found_at, raw, replace(replace(raw, chr(160), ''), ' ', '') AS b FROM (
            SELECT id, found_at, nullif(regexp_extract(description, '\d[\d., ]*\d'), '') AS raw FROM listings)))""")
def t4_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """The number that the first written amount of every description means."""
    rows = _listings(spark, folder, F.nullif(F.regexp_extract("description", r"\d[\d., ]*\d", 0), F.lit("")).alias("raw"))
    return rows.select("*", P.parsed_amount(F.col("raw")).alias("amount"))


@query("""
    SELECT id, found_at, currency, CASE WHEN currency IS NULL OR trim(currency) = '' OR upper(currency) IN ('€', 'EUR') THEN 'EUR' WHEN upper(currency) IN ('$', 'US$') THEN 'USD' WHEN upper(currency) IN ('£', 'GBP') THEN 'GBP'
        ELSE upper(currency) END AS code FROM listings""")
def t5_currency_codes(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, "currency", P.currency_code(F.col("currency")).alias("code"))


@query("SELECT id, found_at, coalesce(regexp_matches(description, '(?i)€|\\$|£|EUR|CHF|GBP'), false) AS named FROM listings")
def t6_named_currencies(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, P.names_currency(F.col("description")).alias("named"))


_SITES = r"(?i)\b(eBay\.?de|eBay|Cardmarket|Pokémon TCG|Pokemon TCG)\b"


@query(f"""
    SELECT id, found_at, CASE WHEN title IS NULL OR {trim_sql("title")} = '' THEN '' ELSE trim(left(q, {T.QUERY_LENGTH})) END AS search_query FROM (
        SELECT id, found_at, title, trim({text_sql(f"regexp_replace(regexp_replace(part, '{_SITES}', '', 'g'), '(?i){T.PRICE_NOISE}', '', 'g')")}, '-|:,. ') AS q FROM (
            SELECT id, found_at, title, coalesce(list_filter(list_transform(string_split(title, '|'), lambda x: {trim_sql("x")}), lambda x: x <> '')[1], title) AS part FROM listings))""")
def t7_search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """What to search for to find every listing's product."""
    return _listings(spark, folder, T.search_query(F.col("title")).alias("search_query"))


@query(f"SELECT id, found_at, regexp_replace(title, '{_SITES}', '', 'g') AS text FROM listings")
def t8_titles_without_sites(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, T.without_site_noise(F.col("title")).alias("text"))


@query(f"SELECT id, found_at, regexp_replace(description, '(?i){T.PRICE_NOISE}', '', 'g') AS text FROM listings")
def t9_texts_without_prices(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, T.without_price_noise(F.col("description")).alias("text"))


@query("SELECT id, found_at, coalesce(image_urls[1], '') AS image, 'https://shop.example/a/' || id AS page FROM listings")
def t10_resolved_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses relative to a page, and absolute ones."""
    page = F.lit("https://shop.example/a/b")
    return _listings(spark, folder, L.resolved_url(page, F.get("image_urls", F.lit(0))).alias("image"), L.resolved_url(page, F.col("id")).alias("page"))


@query("SELECT id, found_at, regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g') AS css FROM listings")
def t11_css_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, T.css_identifier(F.col("title")).alias("css"))


def _locale() -> Column:
    return F.concat(F.lower("country"), F.lit("-"), F.upper("country"))


_LOCALE_SQL = "lower(country) || '-' || upper(country)"
_DOMAIN_SQL = f"coalesce({sql_map(list(LOCALE_DOMAINS.items()))}[{_LOCALE_SQL}], 'com')"


@query(f"""
    SELECT id, found_at, platform, CASE platform WHEN 1 THEN 'https://ebay.' || {_DOMAIN_SQL} || '/itm/' || id WHEN 2 THEN 'https://www.kleinanzeigen.de/s-anzeige/copy/' || id || '-1-1' WHEN 17 THEN 'https://' || id
        WHEN 8 THEN 'https://www.facebook.com/marketplace/item/' || id WHEN 4 THEN 'https://www.willhaben.at/iad/' || ltrim(id, '/') WHEN 21 THEN 'https://www.gumtree.com/p/redirect/redirect/' || id
        WHEN 5 THEN 'https://www.shpock.com/' || coalesce({_LOCALE_SQL}, '') || '/i/' || id
        WHEN 3 THEN CASE WHEN contains(id, '/') THEN 'https://www.marktplaats.nl' || id ELSE 'https://www.marktplaats.nl/v/redirect/redirect/' || id || '-test' END
        ELSE '{L.OTHER_PAGE}?platform=' || lower(coalesce({sql_list(PLATFORMS)}[platform + 1], platform::VARCHAR, 'unknown')) || '&id=' || url_encode(id) END AS url FROM listings""")
def u1_listing_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The address of every listing."""
    rows = _listings(spark, folder, "platform", "country")
    return rows.select("id", "found_at", "platform", L.listing_url(_locale(), F.col("platform"), F.col("id")).alias("url"))


@query(f"SELECT id, found_at, country, {_DOMAIN_SQL} AS domain FROM listings")
def u2_locale_domains(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, "country", L.locale_domain(_locale()).alias("domain"))


@query(f"SELECT id, found_at, platform, {sql_list(PLATFORMS)}[platform + 1] AS name, platform AS number FROM listings")
def u5_platforms(spark: SparkSession, folder: str) -> DataFrame:
    """The name of every listing's marketplace, and its number back from the name."""
    rows = _listings(spark, folder, "platform", L.platform_name(F.col("platform")).alias("name"))
    return rows.select("*", L.platform_number(F.col("name")).alias("number"))


@query("SELECT id, found_at, price_kind, " + " || ".join(f"CASE WHEN price_kind & {1 << i} <> 0 THEN '{n},' ELSE '' END" for i, n in enumerate(PRICE_FLAGS)) + " AS flags FROM listings")
def u6_price_flags(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.array_join(F.transform(L.price_flags(F.col("price_kind")), lambda x: F.concat(x, F.lit(","))), "")
    return _listings(spark, folder, "price_kind", joined.alias("flags"))


@query("SELECT product_seo_id, listing_id, url, coalesce(regexp_matches(trim(url), '(?i)^https?://[^/?#]+'), false) AS web FROM product_listings")
def u7_web_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "product_listings").select("product_seo_id", "listing_id", "url", L.is_web_url(F.col("url")).alias("web"))


def _host() -> Column:
    return F.concat(F.lit("Shop."), F.lower(L.platform_name(F.col("platform"))), F.when(F.col("platform") % 2 == 0, ".de").otherwise(".COM.")).alias("host")


_HOSTS_SQL = f"SELECT id, found_at, 'Shop.' || lower({sql_list(PLATFORMS)}[platform + 1]) || CASE WHEN platform % 2 = 0 THEN '.de' ELSE '.COM.' END AS host FROM listings"


def _host_sql(roots: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"rtrim(lower(host), '.') = '{r}' OR rtrim(lower(host), '.') LIKE '%.{r}'" for r in roots) + ", false)"


@query("SELECT id, found_at, host, CASE " + " ".join(f"WHEN {_host_sql(roots)} THEN '{name}'" for name, roots in MARKETPLACE_DOMAINS.items()) + f" ELSE 'External' END AS marketplace FROM ({_HOSTS_SQL})")
def u8_marketplaces(spark: SparkSession, folder: str) -> DataFrame:
    """The marketplace of a host made of every listing's platform."""
    return _listings(spark, folder, _host()).select("*", L.marketplace(F.col("host")).alias("marketplace"))


@query(f"SELECT id, found_at, host, {_host_sql([d for r in MARKETPLACE_DOMAINS.values() for d in r])} AS supported FROM ({_HOSTS_SQL})")
def u9_supported_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, _host()).select("*", L.is_supported_host(F.col("host")).alias("supported"))


@query(f"SELECT id, found_at, host, {_host_sql(['kleinanzeigen.de'])} AS matches FROM ({_HOSTS_SQL})")
def u10_host_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _listings(spark, folder, _host()).select("*", L.host_matches(F.col("host"), "kleinanzeigen.de").alias("matches"))


_ADDRESS = "l_partkey % 256 || '.' || l_suppkey % 256 || '.' || l_orderkey % 256 || '.' || l_linenumber"


@query(f"""
    SELECT address, count(*) AS n, bool_or(a = 10 OR a = 127 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) AS private FROM (
        SELECT {_ADDRESS} AS address, l_partkey % 256 AS a, l_suppkey % 256 AS b FROM lineitem) GROUP BY address""")
def u11_private_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.expr(_ADDRESS).alias("address"))
    return rows.groupBy("address").agg(F.count("*").alias("n")).select("address", "n", L.is_private_address(F.col("address")).alias("private"))


@query(f"""
    SELECT l_orderkey, count(*) AS n, bool_and(NOT (a = 10 OR a = 127 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168))) AS reachable FROM (
        SELECT l_orderkey, l_partkey % 256 AS a, l_suppkey % 256 AS b FROM lineitem) GROUP BY l_orderkey""")
def u12_public_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all addresses of an order's lines are public."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.expr(_ADDRESS).alias("address"))
    hosts = rows.groupBy("l_orderkey").agg(F.collect_list("address").alias("a"))
    return hosts.select("l_orderkey", F.size("a").cast("bigint").alias("n"), L.resolves_public(F.col("a")).alias("reachable"))
