"""Column functions on single values."""

from pyspark.sql import functions as F

from stallkit.functions import attributes as A
from stallkit.functions import links as L
from stallkit.functions import price_text as P
from stallkit.functions import text as T


def values(spark, fn, inputs, n=1):
    names = [f"c{i}" for i in range(n)]
    rows = [(i, *(x if n > 1 else (x,))) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in names))
    return [r.out for r in df.select("i", fn(*[F.col(c) for c in names]).alias("out")).orderBy("i").collect()]


def test_conditions(spark):
    want = {
        None: "unknown", "  ": "unknown", "": "unknown", " Neu ": "new", "wie neu": "used", "fast wie neu": "new", "1x vorhanden, gebraucht": "used", "laptop": "used", "carbon": "used",
        "nicht funktionsfähig": "broken", "leider nicht funktionsfähig": "used", "gereviseerd": "refurbished", "refurbished": "used", "ny": "new", "nyc": "unknown", "ok": "used",
        "ok!": "ok!", "psa 10": "psa 10", "fair": "fair", "zustand siehe bild": "zustand siehe bild", "zustand siehe bild und beschreibung": "unknown", "25 eur": "unknown",
        "nur abholung": "unknown", "frisch gewaschen": "unknown", " NEU ": "new", "x" * 50_000: "unknown",
    }
    assert values(spark, A.normalized_condition, want) == list(want.values())
    assert values(spark, A.looks_like_condition, ["psa 9", "laptop", None, ""]) == [True, False, False, False]


def test_colours(spark):
    assert values(spark, A.normalized_colour, [" SCHWARZ ", "petrol ", None, " ", "Schwarz/Weiß"]) == ["Black", "petrol", None, " ", "Black and White"]
    assert values(spark, A.is_known_colour, ["or", "petrol", None, ""]) == [True, False, False, False]
    titanium, petrol, nothing = values(spark, A.colour_words, ["titanium", "petrol", None])
    assert titanium == ["titanium", "titan", "titane", "titanio"] and petrol == ["petrol"] and nothing == [None]


def test_attributes(spark):
    want = [
        (" ", "x", " ", "x"), ("K", None, "K", ""), ("color", " SCHWARZ ", "color", "Black"), ("Color", "petrol ", "color", "petrol"), ("storage", "64", "storage", "64GB"),
        ("RAM_SIZE", "16 Gigabyte", "ram", "16GB"), ("Material", "LEDER", "material", "Leder"), ("displaygröße", "6,1 Zoll", "screen_size", '6.1"'), ("Screen_Size", "6.1", "screen_size", '6.1"'),
        ("screen_size", "6.1''", "screen_size", '6.1"'), ("size", "56cm", "size", "56cm"), ("size", "xl", "size", "xl"), ("size", "5000 mAh Akku", "battery", "5000mAh"), ("size", "8 GB", "ram", "8GB"),
        ("size", "24gb", "ram", "24GB"), ("size", "8", "storage", "8GB"), ("size", "32 GB", "storage", "32GB"), ("size", "1000 GB", "storage", "1TB"), ("size", "1024", "storage", "1TB"),
        ("size", "1024tb", "storage", "1TB"), ("size", "2000gb", "storage", "2000GB"), ("size", "2 TB", "storage", "2TB"), ("size", "42000", "size", "42000"), ("size", "6.1 inches", "screen_size", '6.1""'),
        ("size", "6,1 Zoll", "screen_size", '6,1"'), ("Brand", " Acme ", "brand", "Acme"), (None, "x", None, "x"), ("größe", "gb", "size", "gb"), ("size", "99999999999gb", "size", "99999999999gb"),
    ]
    got = values(spark, A.classified_attribute, [(k, v) for k, v, *_ in want], 2)
    assert [(g.key, g.value) for g in got] == [(k, v) for *_, k, v in want]


def test_prices(spark):
    want = {
        ("EUR 24", False): (24, "EUR"), ("1.234,56 €", False): (1234.56, "EUR"), ("1 234,50 EUR", False): (1234.5, "EUR"), ("1.234 €", False): (1234, "EUR"), ("1234.56 €", False): (4.56, "EUR"),
        ("€ 1234.56", False): (123, "EUR"), ("$1,234.56", False): (1.23, "USD"), ("US$ 10", False): (10, "USD"), ("gbp 3,5", False): (3.5, "GBP"), ("CHF 5.5 oder 7", False): (5.5, "CHF"),
        ("1.5 kg, 20 €", False): (20, "EUR"), ("iPhone 12 500 €", False): (12500, "EUR"), ("12345", True): (123, "EUR"), ("12345", False): None, ("150000 €", True): (150, "EUR"), ("150000 €", False): None,
        ("1.234.567,89 €", False): None, ("1.234.56 €", False): None, ("0 €", True): None, ("", True): None, (None, True): None,
    }
    df = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(want)], "i int, t string, a boolean")
    got = [r.p for r in df.select("i", P.price_in(F.col("t"), F.col("a")).alias("p")).orderBy("i").collect()]
    assert [g and (g.amount, g.currency) for g in got] == list(want.values())


def test_text(spark):
    assert values(spark, T.normalized_text, ["a &amp;amp; b \n c ", " ", None, "x&nbsp;y"]) == ["a & b c", "", "", "x y"]
    assert values(spark, T.search_query, ["Sony Kamera | eBay.de", " | Foto 20 € - ", None, "| |", "EUR 1234", "a" * 200, "Pokémon TCG Karte €5 |x"]) == ["Sony Kamera", "Foto", "", "", "4", "a" * 140, "Karte"]
    assert values(spark, lambda a, b: T.first_non_empty(a, b), [(" ", "b "), (None, None), ("a", "b")], 2) == ["b ", "", "a"]
    assert values(spark, T.css_identifier, ["a b:é-_9", None]) == ["a_b__-_9", None]
    assert values(spark, P.currency_code, ["€", "us$", "gbp", "chf", "pln", " ", None]) == ["EUR", "USD", "GBP", "CHF", "PLN", "EUR", "EUR"]
    assert values(spark, P.names_currency, ["5 eur", "5", None, "$"]) == [True, False, False, True]


def test_links(spark):
    df = spark.createDataFrame([("de-AT", 1, "1"), ("xx", 1, "1"), ("de-DE", 4, "//a/b"), ("nl-NL", 3, "/v/x"), ("nl-NL", 3, "m1"), ("de-DE", 7, "a b/é"), (None, 5, "s"), ("de-DE", 99, "q"), ("de-DE", 1, None)], "l string, p int, i string")
    got = [r.u for r in df.coalesce(1).select(L.listing_url(F.col("l"), F.col("p"), F.col("i")).alias("u")).collect()]
    assert got == [
        "https://ebay.at/itm/1", "https://ebay.com/itm/1", "https://www.willhaben.at/iad/a/b", "https://www.marktplaats.nl/v/x", "https://www.marktplaats.nl/v/redirect/redirect/m1-test",
        "https://example.org/auctions?platform=vinted&id=a%20b%2F%C3%A9", "https://www.shpock.com//i/s", "https://example.org/auctions?platform=99&id=q", None,
    ]
    assert values(spark, L.marketplace, ["www.ebay.de", "EBAY.DE.", "notebay.de", "ebay.se", "m.cardmarket.com", "vinted.fr", "shpock.com", None]) == ["Ebay", "Ebay", "External", "External", "Cardmarket", "Vinted", "Shpock", "External"]
    assert values(spark, L.is_web_url, [" https://a.b/c ", "ftp://a.b", "/x", None, "", "HTTP://X.y"]) == [True, False, False, False, False, True]
    addresses = ["10.0.0.1", "127.1.2.3", "169.254.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "::1", "0:0:0:0:0:0:0:1", "fe80::1", "fec0::1", "fc00::1", "fd12::1", "2001:db8::1", "fe8::1", "x", None]
    assert values(spark, L.is_private_address, addresses) == [True, True, True, True, False, True, False, True, True, True, True, True, True, False, False, True, None]
    flags = spark.createDataFrame([(0,), (5,), (15,), (None,)], "m int").coalesce(1).select(L.price_flags(F.col("m")).alias("f"), L.platform_name(F.col("m")).alias("n")).collect()
    assert [r.f for r in flags] == [[], ["BuyItemNow", "Negotiatable"], ["BuyItemNow", "Auction", "Negotiatable", "IncludesTax"], None]
    assert [r.n for r in flags] == ["Unknown", "Shpock", "AutoDe", None]
    assert values(spark, L.platform_number, ["Ebay", "ebay", None]) == [1, None, None]
    assert values(spark, L.resolved_url, [("https://a.b/c/d", "e"), ("https://a.b/c/d", "/e"), ("https://a.b", " "), (None, None)], 2) == ["https://a.b/c/e", "https://a.b/e", "", ""]
    lists = spark.createDataFrame([(["8.8.8.8"],), (["8.8.8.8", "10.0.0.1"],), ([],), (None,), ([None],)], "a array<string>").coalesce(1)
    assert [r.ok for r in lists.select(L.resolves_public(F.col("a")).alias("ok")).collect()] == [True, False, False, False, False]
