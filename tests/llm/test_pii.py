"""Personal information in listings."""

from stallkit.llm import queries
from stallkit.llm.pii import find, luhn, mod97_account, mod97_french, redact, redact_columns, tax_id, travel_document
from stallkit.session import local_session

KNOWN = frozenset({"Ilka", "Kordelstätter"})


def test_names_without_a_cue():
    for text, out in {
        "Das Rad gehörte Ilka und steht im Keller.": "Das Rad gehörte [NAME] und steht im Keller.",
        "Kordelstätter hat es gekauft.": "[NAME] hat es gekauft.",
        "Gestern war Ilka Kordelstätter da.": "Gestern war [NAME] da.",
        "Verkaufe Modell Ilka in rot.": "Verkaufe Modell Ilka in rot.",
        "LG Ulla Abholung: Hafenweg 3": "LG [NAME] Abholung: [ADDRESS]",
    }.items():
        assert redact(text, find(text, known=KNOWN)) == out


def test_numbers_and_their_checks():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97_account("DE89 3704 0044 0532 0130 00") and not mod97_account("DE88 3704 0044 0532 0130 00")
    assert mod97_french("255081416802538") and not mod97_french("255081416802539")
    assert tax_id("86095742719") and not tax_id("86095742718") and not tax_id("1")
    assert travel_document("L898902C36") and not travel_document("L898902C35")
    for text, out in {
        "IBAN DE89 3704 0044 0532 0130 00 bitte": "IBAN [ACCOUNT] bitte",
        "Karte 4539 5787 6362 1486": "Karte [ACCOUNT]",
        "Call Anna Schmidt on 0151 23456789": "Call [NAME] on [PHONE]",
        "Steuer-ID 86 095 742 719, danke": "Steuer-ID [ID_NUMBER], danke",
        "EAN 4006381333931, Artikelnummer 701-582": "EAN 4006381333931, Artikelnummer 701-582",
        "Mail: a.b (at) example.org oder a.b@example.org": "Mail: [EMAIL] oder [EMAIL]",
        "12 rue de la Paix, 75002 Paris": "[ADDRESS]",
        "Maße etwa 21 x 35 x 87 cm.": "Maße etwa 21 x 35 x 87 cm.",
    }.items():
        assert redact(text, find(text)) == out


def test_odd_rows():
    spark = local_session(cores="2", shuffle_partitions=2)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "wort " * 60_000 + "a.b@example.org", "z")], "id int, t string, t_kinds string").coalesce(1)
    out = redact_columns(df, ["t"], (), ["id", "t_kinds"]).collect()
    assert [(r.id, r.t_kinds) for r in out] == [(1, []), (2, []), (3, ["email"])] and out[0].t_redacted is None and out[1].t_redacted == "" and out[2].t_redacted.endswith("[EMAIL]")
    assert redact_columns(df.limit(0), ["t"]).collect() == []


def test_queries(tmp_path):
    spark = local_session(cores="2", shuffle_partitions=2)
    rows = [("a", "Mail an a.b@example.org. Ilka hat es kaum benutzt.", "Shop 4471"), ("a", "Mail an a.b@example.org. Ilka hat es kaum benutzt.", "Shop 4471"), ("b", None, "Ilka Fennhagen"), ("c", "", "Ilka Kordelkamp, +49 170 1234567")]
    spark.createDataFrame(rows, "id string, description string, contact string").write.parquet(f"{tmp_path}/listings.parquet")
    found = sorted(map(tuple, queries.QUERIES["p6_found"](spark, str(tmp_path)).collect()))
    assert found == [("a", "description", "email"), ("a", "description", "name"), ("b", "contact", "name"), ("c", "contact", "name"), ("c", "contact", "phone")]
    texts = {r.id: (r.description, r.contact) for r in queries.QUERIES["p6_redacted"](spark, str(tmp_path)).collect()}
    assert texts == {"a": ("Mail an [EMAIL]. [NAME] hat es kaum benutzt.", "Shop 4471"), "b": (None, "[NAME]"), "c": ("", "[NAME], [PHONE]")}
