"""Word lists and lookup tables of the marketplace domain. All are fixed values that results must agree with."""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split("|")]


#: Conditions as entered and what they mean. Fixed values; the order is that in which containment is tried.
CONDITIONS: list[tuple[str, list[str]]] = [
    ("new", _words("""neu | new | neuf | nuevo | nuovo | nieuw | ny | nový | nowy | novo | nie benutzt | unbenutzt | originalverpackt | ovp | sealed |
        neuwertig | nagelneu | brandneu | brand new | mint | near mint | mint condition""")),
    ("used", _words("""wie neu | like new | comme neuf | como nuevo | come nuovo | als nieuw | som ny | jako nový | like_new | gut | good | bon | bueno | buono |
        goed | bra | dobrý | akzeptabel | acceptable | aceptable | accettabile | acceptabel | redelijk | gebraucht | used | occasion | usado | usato |
        gebruikt | begagnad | použitý | sehr gut | very good | très bon | sehr gut erhalten | gut erhalten | sehr guter zustand | guter zustand |
        top zustand | top | super zustand | einwandfrei | gepflegt | gepflegter | voll funktionsfähig | funktionsfähig | funktioniert | working |
        functional | alles funktioniert | voll funktionsfähiger | funktionsfaehig | funktionstüchtig | voll funktionstüchtig | kaum getragen |
        wenig benutzt | excellent | refurbished | generalüberholt | generalüberholtes | vollständig | komplett | trocken | aus erster hand |
        second hand | benutzt | gebrauchsspuren | selten getragen | kaum genutzt | kaum gebraucht""")),
    ("new", ["ungetragen"]),
    ("used", _words("ok | okay | ganz okay | okka | oke")),
    ("refurbished", ["gereviseerd"]),
    ("used", _words("""gut erhaltene | sehr gut erhaltene | wenig getragen | kaum benutzt | sehr wenig getragen | sehr wenig benutzt | gut erhaltener |
        keine löcher, wenig rost""")),
    ("broken", _words("""defekt | broken | défectueux | defectuoso | difettoso | defect | trasig | kapot | for parts | for_parts | bastler | bastler/export |
        beschädigt | damaged | mit mängeln | kratzer | kaputt | unfallfahrzeug | beschädigt, unfallfahrzeug | nicht fahrtüchtig |
        nicht funktionsfähig""")),
    ("used", _words("einsatzbereit | secondhand | second-hand")),
    ("new", _words("neu und unbenutzt | neu und originalverpackt")),
    ("used", _words("""sehr gut erhaltenes | top- und frischem zustand | unfallfrei | keine mängel | voll funktionsfähig, keine mängel |
        unfallfrei und hat keinerlei mängel | least used | wenig gefahren | wenig gelaufen | kaum gelaufen""")),
]
CONDITION_ENTRIES: list[tuple[str, str]] = [(word, meaning) for meaning, words in CONDITIONS for word in words]

#: Parts of words that make a text look like a condition. Fixed values.
CONDITION_SIGNS = _words("""new | neu | neuf | nuevo | nuovo | nieuw | used | gebraucht | occasion | usado | usato | gebruikt | broken | defekt | kaputt | kapot |
    trasig | good | gut | bon | bueno | buono | goed | fair | ok | okay | akzeptabel | like new | wie neu | mint | excellent | sehr gut | psa | bgs | cgc |
    ace | sgc | graded | gem mint | refurbished | generalüberholt | gereviseerd | funktionsfähig | funktioniert | working | functional |
    funktionstüchtig | funktionsfaehig | einsatzbereit | secondhand | second-hand | unbenutzt | ungetragen | fahrtüchtig | mängel | zustand | erhalten |
    gepflegt""")  # fmt: skip

#: Colours and the words for them. Fixed values.
COLOURS: dict[str, list[str]] = {
    "Black": _words("schwarz | black | noir | negro | nero | zwart | svart | černá"),
    "White": _words("weiß | weiss | white | blanc | blanco | bianco | wit | vit | bílá"),
    "Red": _words("rot | red | rouge | rojo | rosso | rood | röd | červená"),
    "Blue": _words("blau | blue | bleu | azul | blu | blauw | blå | modrá"),
    "Green": _words("grün | green | vert | verde | groen | grön | zelená"),
    "Yellow": _words("gelb | yellow | jaune | amarillo | giallo | geel | gul | žlutá"),
    "Orange": _words("orange | naranja | arancione | oranje | oranžová"),
    "Purple": _words("lila | purple | violet | morado | viola | paars | lila/purpur | fialová"),
    "Pink": _words("rosa | pink | rose | roze | růžová"),
    "Brown": _words("braun | brown | marron | marrón | marrone | bruin | brun | hnědá"),
    "Grey": _words("grau | grey | gray | gris | grigio | grijs | grå | šedá"),
    "Silver": _words("silber | silver | argent | plata | argento | zilver | stříbrná"),
    "Gold": _words("gold | or | oro | goud | guld | zlatá"),
    "Bronze": _words("bronze | bronce | bronzo | brons | bronzová"),
    "Copper": _words("kupfer | copper | cuivre | cobre | rame | koper | koppar | měď"),
    "Titanium": _words("titan | titanium | titane | titanio"),
    "Clear": _words("transparent | clear | transparente | trasparente | genomskinlig | průhledná"),
    "Black and White": _words("schwarzweiss | schwarz-weiß | schwarz-weisse | schwarz/weiß | schwarz weiß | black and white | black/white"),
    "Multicolor": _words("mehrfarbig | multicolor | multicolore | multicolor/mehrfarbig | flerfärgad | vícebarevná"),
    "Unknown": _words("unknown | unbekannt | not specified | keine angabe | n/a"),
}
COLOUR_ENTRIES: list[tuple[str, str]] = [(word, colour) for colour, words in COLOURS.items() for word in words]

#: Marketplaces in the order of their stored numbers, from 0. Fixed values.
PLATFORMS = _words("""Unknown | Ebay | Kleinanzeigen | Marktplaats | Willhaben | Shpock | MarktDe | Vinted | Facebook | Poshmark | Mercari | Depop | Mobile |
    AutoScout24 | WirKaufenDeinAuto | AutoDe | Gebrauchtwagen12 | Craigslist | OfferUp | OLX | Quoka | Gumtree | Kijiji | Carousell | Carvana |
    Autotrader | CarsGuide | Nextdoor | Lebecoin | Wallapop""")  # fmt: skip

#: Ways to sell, in the order of their bits. Fixed values.
PRICE_FLAGS = ["BuyItemNow", "Auction", "Negotiatable", "IncludesTax"]

#: Domain endings of locales. Fixed values.
LOCALE_DOMAINS = {
    "de-DE": "de", "de-AT": "at", "de-CH": "ch", "nl-NL": "nl", "nl-BE": "be", "pl-PL": "pl", "it-IT": "it", "pt-PT": "pt", "pt-BR": "br",
    "da-DK": "dk", "sv-SE": "se", "no-NO": "no", "fi-FI": "fi", "en-GB": "co.uk", "en-US": "com", "fr-FR": "fr", "es-ES": "es",
}

#: Domains of each marketplace whose pages are known. Fixed values; the order is that in which hosts are tried.
MARKETPLACE_DOMAINS: dict[str, list[str]] = {
    "Cardmarket": ["cardmarket.com"],
    "Ebay": [f"ebay.{d}" for d in ("de", "com", "at", "ch", "co.uk", "fr", "it", "es", "nl", "be", "pl", "ie", "ca", "com.au")],
    "Kleinanzeigen": ["kleinanzeigen.de"],
    "Vinted": [f"vinted.{d}" for d in ("de", "com", "fr", "it")],
    "Willhaben": ["willhaben.at"],
    "Marktplaats": ["marktplaats.nl"],
    "Shpock": ["shpock.com"],
}
#: Hosts whose categories are mapped. Fixed values.
CATEGORY_HOSTS = ["kleinanzeigen.de", "willhaben.at", "marktplaats.nl", "leboncoin.fr"]


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    """A list literal for the checking SQL."""
    return "[" + ", ".join(map(sql_text, words)) + "]"


def sql_map(entries: list[tuple[str, str]]) -> str:
    """A map literal for the checking SQL."""
    return "MAP {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in entries) + "}"
