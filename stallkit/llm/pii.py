"""Personal information in free text: spans, scores and typed placeholders.

Regular expressions propose spans of a kind, each with a score of its own; texts without a run of digits are not searched
for numbers. Validators (Luhn for cards, mod-97 for accounts and the French key, the mod-11
check of tax numbers, the 7-3-1 check of travel documents) add to the score of spans whose digits fit, words around the
span add or take away. Spans that reach ``ACCEPT`` count; of overlapping ones the highest score wins, then the longest. Texts are
brought to one consistent form first, so odd characters hide nothing; the redacted text is in that form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkit.llm.unicode_fold import fold_array

ACCEPT = 0.5
BEFORE, AFTER = 36, 16


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Check digit of card numbers and Canadian or Swedish identity numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97_french(digits: str) -> bool:
    """Key of a French social security number of 15 digits."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def mod97_account(text: str) -> bool:
    """Check digits of an international account number."""
    t = text.replace(" ", "").upper()
    return 15 <= len(t) <= 34 and t.isalnum() and t.isascii() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def tax_id(digits: str) -> bool:
    """Check digit of a German tax number of 11 digits (ISO 7064 mod 11, 10)."""
    if len(digits) != 11:
        return False
    p = 10
    for c in digits[:10]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[10])


def travel_document(text: str) -> bool:
    """Check digit at the end of a document number of ten characters (weights 7, 3, 1)."""
    t = text.replace(" ", "")
    return len(t) == 10 and t[-1].isdigit() and sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(t[:9])) % 10 == int(t[-1])


_I = regex.IGNORECASE
_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|ät|@)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|\.)\s?[\])}]\s?|\s(?:dot|punkt|point)\s)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_LOCAL = r"[\p{L}\p{N}][\p{L}\p{N}._+%-]*"
EMAIL = regex.compile(rf"(?:mailto:)?{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", _I)
EMAIL_IN_WORDS = regex.compile(rf"{_LOCAL}\s(?:at|ät)\s{_LABEL}(?:{_DOT}{_LABEL})+", _I)

#: Signs without which there is no address of mail.
BRACKET_AT = regex.compile(r"[\[({]\s?(?:at|ät|@)", _I)

_SEP = r"[ .\-/]"
#: Seven digits close together, or letters and digits of a document: without them there is no number to hide.
NUMBERS = regex.compile(r"\d(?:[ .\-/()]{0,3}\d){6}|\d(?:[ \-/]?[A-Z0-9]){5}|[A-Z](?:[ \-/]?[A-Z0-9]){5}")
ACCOUNT = regex.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
CARD = regex.compile(r"(?<![\w.,-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)")
CARD_CUE = regex.compile(r"(?:karten?(?:nummer|nr)?|kreditkarte|card(?: (?:number|no))?|visa|mastercard|carte(?: bancaire)?|cb)\W{0,4}$", _I)
PHONES = [
    (regex.compile(rf"(?<![\w+@])(?:\+|00)[1-9]\d{{0,2}}{_SEP}?(?:\(0\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{2,8}}){{1,5}}(?!\w)"), 0.7, (10, 15)),
    (regex.compile(rf"(?<![\w+@.,/-])\(?0[1-9]\d{{0,4}}\)?{_SEP}?\d{{2,8}}(?:{_SEP}?\d{{2,8}}){{0,4}}(?!\w)"), 0.6, (9, 12)),
    (regex.compile(r"(?<![\w+@.,/-])(?:1[ .\-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])\d{3}[ .\-]\d{4}(?!\w)"), 0.6, (10, 11)),
]
#: Words before a number that say it is another kind of number.
NO_PHONE = regex.compile(r"(?:ean|gtin|isbn|artikel\w*|art\.|serien\w*|seriennr|charge|lot|item no|référence|réf|ref|serial|numéro de série|modell?|garantie|kundennummer|bestell\w*)\.?\s*(?:nr|no|n°)?[.:]?\s*\S{0,6}$", _I)
PHONE_CUE = regex.compile(r"(?:tel|tél|telefon|phone|ph|call|anrufen|mobil|handy|whatsapp|sms|appelez|unter|text me)\W{0,4}(?:\w+\W{0,3}){0,2}$", _I)

#: Names of identity documents, tax and social security numbers in German, English and French. Fixed values.
ID_NAMES = (
    r"personalausweis\w*|ausweis(?:nummer|nr)?|perso|reisepass(?:nummer)?|pass(?:nummer|nr)|passport|passeport|carte\s+(?:nationale\s+)?d['’]identité|cni|"
    r"id[ -]?card|identity\s+card|id\s+number|national\s+insurance|nino|ssn|social\s+security|sécurité\s+sociale|sécu|nir|"
    r"steuer-?\s?id|steuer(?:identifikations)?-?nummer|idnr|tax\s+(?:id|number)|tin|numéro\s+fiscal|spi|"
    r"sozialversicherungs-?(?:nummer|nr)|rentenversicherungs-?(?:nummer|nr)|sv-?nummer|svnr"
)
_GAP = r"(?:[\s:.,()#=-]|\bist\b|\bis\b|\best\b|\blautet\b|\bnr\b|\bno\b|\bn°|\bnummer\b|\bnumber\b|\bnumero\b|\bnuméro\b)*"
ID_NAMED = regex.compile(rf"(?<![\p{{L}}])(?i:{ID_NAMES})(?![\p{{L}}])(?i:{_GAP})(?P<v>(?=[A-Z0-9 /-]*\d)[A-Z0-9]{{1,14}}(?:[ /-][A-Z0-9]{{1,9}}){{0,6}})(?![\p{{L}}\p{{N}}])")
ID_SHAPES = [
    (regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 0.5, None),
    (regex.compile(r"(?<![\w-])[A-CEGHJ-PQR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"), 0.55, None),
    (regex.compile(r"(?<![\w.,-])[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?(?!\w)"), 0.3, mod97_french),
    (regex.compile(r"(?<![\w.,-])\d{2} ?\d{3} ?\d{3} ?\d{3}(?!\w)"), 0.1, tax_id),
    (regex.compile(r"(?<![\w.,-])[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}\d(?!\w)"), 0.2, travel_document),
]
ID_CUE = regex.compile(rf"(?<![\p{{L}}])(?:{ID_NAMES})(?![\p{{L}}]){_GAP}$", _I)

_GERMAN = r"stra(?:ß|ss)e|str\.|weg|gasse|allee|ring|markt|ufer|pfad|platz|damm|steig|graben|wall|stieg|zeile|promenade|chaussee|winkel|kamp|anger|twiete|steg|hof|berg|garten"
_GERMAN_WORD = r"Stra(?:ß|ss)e|Str\.|Weg|Gasse|Allee|Ring|Markt|Ufer|Pfad|Platz|Damm|Steig|Graben|Wall|Stieg|Promenade|Chaussee|Anger"
_HOUSE = r"\d{1,4}(?:\s?[a-hA-H](?!\w)|\s?-\s?\d{1,4})?(?!\d|[.,]\d|\s?(?:x|€|euro|eur|uhr|cm|mm|kg|g|gb|km|stück|wochen|monate)\b)"
_TOWN = r"(?:,?\s(?:in\s)?(?:\d{4,5}\s)?(?!(?:In|Mit|Bei|Und)\b)\p{Lu}\p{L}+(?:\s[A-Z]{1,2}\d{1,2}\s\d[A-Z]{2})?)?"
_TOWN_STRICT = r"(?:,\s\d{4,5}\s\p{Lu}\p{L}+|\sin\s\p{Lu}\p{L}+)?"
ADDRESSES = [
    (regex.compile(rf"(?<!\p{{L}})\p{{Lu}}[\p{{L}}-]{{2,}}(?:{_GERMAN})\s{_HOUSE}{_TOWN_STRICT}"), 0.7),
    (regex.compile(rf"(?<!\p{{L}})\p{{Lu}}\p{{L}}*-(?:{_GERMAN_WORD})\s{_HOUSE}{_TOWN_STRICT}"), 0.7),
    (regex.compile(rf"(?<!\p{{L}})\p{{Lu}}\p{{L}}+\s(?:{_GERMAN_WORD})\s{_HOUSE}{_TOWN_STRICT}"), 0.65),
    (regex.compile(rf"(?<!\p{{L}})(?:An der|An den|An dem|Am|Auf der|Auf dem|Auf den|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Hinter dem|Vor dem|Beim)\s(?!(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Jahr|Preis|Karton|Set)\b)(?:\p{{Lu}}[\p{{L}}-]+\s){{1,3}}(?!\d{{4}}){_HOUSE}{_TOWN_STRICT}"), 0.55),
    (regex.compile(r"(?<![\w.,])\d{1,4}(?:\s?(?:bis|ter|quater|[a-d]))?,?\s(?i:rue|avenue|av\.|boulevard|bd|impasse|chemin|allée|place|quai|route|cours|passage|sentier|square|ruelle|faubourg)(?:\s(?i:de la|de l['’]|du|des|de|d['’]))?\s?\p{Lu}[\p{L}'’-]*(?:\s\p{Lu}[\p{L}'’-]*){0,3}(?:,\s\d{5}\s\p{Lu}[\p{L}-]+)?"), 0.75),
    (regex.compile(r"(?<![\w.,])(?:(?:Flat|Apt\.?|Unit|Suite)\s\d{1,4},\s)?\d{1,5}[a-d]?\s(?:\p{Lu}[\p{L}'’-]+\s){1,3}(?:Street|St\.?|Lane|Ln\.?|Close|Drive|Dr\.?|Road|Rd\.?|Avenue|Ave\.?|Court|Ct\.?|Way|Place|Terrace|Crescent|Gardens|Square|Hill|Row|Mews|Grove|Walk|Boulevard|Blvd\.?)(?!\p{L})(?:,\s\p{Lu}[\p{L}-]+)?(?:\s[A-Z]{1,2}\d{1,2}\s\d[A-Z]{2})?"), 0.75),
]

_TITLE = r"(?:(?:Herrn?|Frau|Fam\.|Familie|Mr\.?|Mrs\.?|Ms\.?|Miss|M\.|Mme|Mlle|Monsieur|Madame|Dr\.?|Prof\.?)\s)"
_PART = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
_FULL = rf"(?P<v>{_TITLE}?{_PART}(?:[ ](?:von|van|de|le|la)[ ]{_PART}|[ ]{_PART}){{0,2}})"
_SINGLE = rf"(?P<v>{_TITLE}?{_PART}(?:[ ]{_PART})?)"
NAMES = [
    (regex.compile(rf"(?<!\p{{L}})(?i:(?:ansprechpartner(?:in)?|kontakt(?:person)?|verkäufer(?:in)?|anbieter(?:in)?|vendeu(?:r|se)|seller|owner|contact(?: person)?|name|nom)(?:\s(?:is|ist|est))?|my name is|je m['’]appelle|ich heiße)\s?:?\s{_SINGLE}"), 0.6),
    (regex.compile(rf"(?<!\p{{L}})(?i:(?:viele|liebe|beste|schöne|freundliche[nr]?|herzliche)\s+grü(?:ß|ss)e|mit freundlichen grüßen|grü(?:ß|ss)e|gru(?:ß|ss)|lg|vg|mfg|cordialement|bien à vous|salutations|amicalement|(?:kind |best |warm )?regards|cheers|sincerely|best wishes|thanks|merci|danke)(?:\s(?i:von|from|de))?[\s,!–-]*\s{_SINGLE}"), 0.6),
    (regex.compile(rf"(?<!\p{{L}})(?i:nach|bei|an)\s{_SINGLE}(?=\s(?i:fragen|melden|wenden))"), 0.6),
    (regex.compile(rf"(?<!\p{{L}})(?i:ask for|speak to|talk to|demander|demandez|contacter|contactez|s['’]adresser à|fragen nach|fragt nach|melden bei)\s{_SINGLE}"), 0.6),
    (regex.compile(rf"(?<!\p{{L}})(?i:call|text|ring|write to|ruf|rufen sie|schreib|appelez|appeler)\s{_SINGLE}(?=\s(?i:on|at|via|under|unter|an|au)(?!\p{{L}}))"), 0.6),
    (regex.compile(rf"(?<!\p{{L}})(?P<v>{_TITLE}{_PART}(?:\s{_PART})?)"), 0.45),
]
#: Of each pattern above, bits of words in lower case of which every match has one: looked for first, since that is quick.
NAME_CUES = [
    ("ansprechpartner", "kontakt", "verkäufer", "anbieter", "vendeu", "seller", "owner", "contact", "name", "nom", "appelle", "heiße"),
    ("grü", "gru", "lg", "vg", "mfg", "cordialement", "bien à vous", "salutations", "amicalement", "regards", "cheers", "sincerely", "wishes", "thanks", "merci", "danke"),
    ("fragen", "melden", "wenden"),
    ("ask for", "speak to", "talk to", "demande", "contacte", "adresser", "fragen nach", "fragt nach", "melden bei"),
    ("call", "text", "ring", "write", "ruf", "schreib", "appele"),
    ("",),
]
#: Capitalised words that begin a sentence or name a thing, not a person. Fixed values.
NOT_NAMES = frozenset("chat mail email telefon tel handy whatsapp sms anzeige plattform nachricht bitte preis versand abholung privat shop laden neu gerät anruf email e-mail message portal rückfragen fragen interesse bedarf vereinbarung absprache".split())
NAME_RUN = regex.compile(rf"(?<![\p{{L}}@._-]){_PART}(?:[ ]{_PART}){{0,3}}(?![\p{{L}}@_])")
#: Words before a name that say it is a thing's.
PRODUCT_CUE = regex.compile(r"(?:marke|hersteller|modell?|modèle|marque|brand|serie|série|series|typ|type)\W{1,3}(?:\w+\W)?$", _I)
#: A whole contact entry, or its part before a number, that is a person.
CONTACT_NAME = regex.compile(rf"^\s*{_FULL}\s*(?:$|[,;/|:–-]\s*(?=[+(\d]|{_LOCAL}\s?@))")


def _near(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - BEFORE) : a], text[b : b + AFTER]


def _emails(t: str) -> Iterator[Span]:
    if "@" in t or BRACKET_AT.search(t):
        for m in EMAIL.finditer(t):
            yield Span("email", m.start(), m.end(), 0.9)
    low = t.lower()
    if " at " in low or " ät " in low:
        for m in EMAIL_IN_WORDS.finditer(t):
            local = regex.split(r"\s", m.group(), maxsplit=1)[0]
            yield Span("email", m.start(), m.end(), 0.35 + 0.3 * bool(regex.search(r"[._+\d-]", local)))


def _accounts(t: str) -> Iterator[Span]:
    for m in ACCOUNT.finditer(t):
        if mod97_account(m.group()):
            yield Span("account", m.start(), m.end(), 1.2)
    for m in CARD.finditer(t):
        before, _ = _near(t, *m.span())
        digits = regex.sub(r"\D", "", m.group())
        yield Span("account", m.start(), m.end(), 0.2 + 0.3 * (luhn(digits) and digits[0] in "3456") + 0.4 * bool(CARD_CUE.search(before)) - 0.5 * bool(NO_PHONE.search(before)))


def _phones(t: str) -> Iterator[Span]:
    for pattern, score, (least, most) in PHONES:
        for m in pattern.finditer(t):
            a, b = m.span()
            text = m.group()
            while len(regex.sub(r"\D", "", text.replace("(0)", ""))) > most and (cut := regex.search(rf"{_SEP}\d+$", text)):
                text = text[: cut.start()]
            b = a + len(text)
            n = len(regex.sub(r"\D", "", text))
            if not least <= n <= most + 1:
                continue
            before, _ = _near(t, a, b)
            yield Span("phone", a, b, score - 0.5 * bool(NO_PHONE.search(before)) + 0.2 * bool(PHONE_CUE.search(before)))


def _ids(t: str) -> Iterator[Span]:
    for m in ID_NAMED.finditer(t):
        value = m.group("v")
        digits = regex.sub(r"\D", "", value)
        if len(value.replace(" ", "")) < 6:
            continue
        fits = tax_id(digits) or mod97_french(digits) or travel_document(value) or (len(digits) > 8 and luhn(digits))
        yield Span("id_number", m.start("v"), m.end("v"), 0.9 + 0.1 * fits)
    for pattern, score, check in ID_SHAPES:
        for m in pattern.finditer(t):
            before, _ = _near(t, *m.span())
            fits = check is not None and check(regex.sub(r"[^0-9A-Z]", "", m.group()) if check is travel_document else regex.sub(r"\D", "", m.group()))
            yield Span("id_number", m.start(), m.end(), score + 0.3 * fits + 0.45 * bool(ID_CUE.search(before)) - 0.5 * bool(NO_PHONE.search(before)))


def _addresses(t: str) -> Iterator[Span]:
    for pattern, score in ADDRESSES:
        for m in pattern.finditer(t):
            yield Span("address", m.start(), m.end(), score)


def _names(t: str, contact: bool, known: frozenset[str]) -> Iterator[Span]:
    low = t.lower()
    for (pattern, score), cues in zip(NAMES, NAME_CUES, strict=True):
        for m in pattern.finditer(t) if any(c in low for c in cues) else ():
            a, words = m.start("v"), m.group("v").split(" ")
            if words[0].lower() in NOT_NAMES:
                continue
            while words[-1].lower() in NOT_NAMES:
                words.pop()
            yield Span("name", a, a + len(" ".join(words)), score + 0.1 * (len(words) > 1))
    # Without a cue, words known as parts of names are proposed; a product word before them takes away, a second one adds.
    for m in NAME_RUN.finditer(t) if known else ():
        words = m.group().split(" ")
        hits = [i for i, w in enumerate(words) if w in known]
        if hits:
            a = m.start() + sum(len(w) + 1 for w in words[: hits[0]])
            run = " ".join(words[hits[0] : hits[-1] + 1])
            before, _ = _near(t, a, a + len(run))
            yield Span("name", a, a + len(run), 0.5 + 0.05 * (len(hits) > 1) - 0.3 * bool(PRODUCT_CUE.search(before)))
    if contact and (m := CONTACT_NAME.match(t)):
        words = m.group("v").split()
        if not any(w.lower().strip(".,") in NOT_NAMES for w in words):
            # One capitalised word alone may be anything; two are a person, and so is one before a number.
            yield Span("name", m.start("v"), m.end("v"), 0.4 + 0.2 * (len(words) > 1 or m.end() < len(t)))


def find(text: str, contact: bool = False, known: frozenset[str] = frozenset()) -> list[Span]:
    """Accepted spans of a text in consistent form, in order. ``contact`` marks a field that is meant to hold contacts.

    ``known`` are words that are parts of names wherever they stand.
    """
    spans = [*_emails(text), *_names(text, contact, known)]
    if NUMBERS.search(text):
        spans += [*_phones(text), *_ids(text), *_accounts(text)]
    if regex.search(r"\d", text):
        spans += _addresses(text)
    out: list[Span] = []
    for s in sorted((s for s in spans if s.score >= ACCEPT), key=lambda s: (-s.score, s.start - s.end, s.start)):
        if all(s.end <= o.start or s.start >= o.end for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s.start)


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets."""
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*parts, text[at:]])


#: Words that are parts of names; all of them go to every executor, and more than this are refused.
MAX_NAME_WORDS = 2_000_000


def name_words(df: DataFrame, column: str, least: int = 2) -> frozenset[str]:
    """Parts of the names that stand as first and last name in ``least`` contact entries of ``column`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = fold_array(batch.column(0))[0].to_pylist()
            runs = [t[s.start : s.end].split(" ") for t in texts if t for s in _names(t, True, frozenset()) if s.score >= ACCEPT]
            yield pa.record_batch([pa.array([w for r in runs if len(r) == 2 for w in r if regex.fullmatch(_PART, w)], pa.string())], names=["word"])

    words = df.select(F.col(column).cast("string").alias("text")).where("text is not null").mapInArrow(run, "word string")
    found = words.groupBy("word").count().where(F.col("count") >= least).limit(MAX_NAME_WORDS + 1).collect()
    if len(found) > MAX_NAME_WORDS:
        raise ValueError(f"more than {MAX_NAME_WORDS} words are parts of names")
    return frozenset(r.word for r in found)


def redact_columns(df: DataFrame, columns: Sequence[str], contacts: Sequence[str] = (), keep: Sequence[str] = (), known: frozenset[str] = frozenset()) -> DataFrame:
    """``keep`` columns with ``<column>_redacted`` and ``<column>_kinds`` (distinct kinds found, sorted) of each column.

    Null gives null and no kinds; empty text stays. Texts are read whole. A kept column that bears a result's name is
    left out. ``contacts`` names those of ``columns`` that hold contact entries, ``known`` words that are parts of names.
    """
    made = {f"{c}{s}" for c in columns for s in ("_redacted", "_kinds")}
    kept = [k for k in keep if k not in made]
    rows = df.select(*[F.col(k) for k in kept], *[F.col(c).cast("string").alias(f"_text{i}") for i, c in enumerate(columns)])
    fields = [f for c in columns for f in (T.StructField(f"{c}_redacted", T.StringType()), T.StructField(f"{c}_kinds", T.ArrayType(T.StringType())))]

    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for whole in batches:
            # Pieces of 512 rows keep the code-point arrays small.
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = list(batch.columns[: len(kept)])
                for i, c in enumerate(columns):
                    texts = fold_array(batch.column(len(kept) + i))[0].to_pylist()
                    spans = [find(t, c in contacts, names) if t else [] for t in texts]
                    out.append(pa.array([None if t is None else redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()))
                    out.append(pa.array([sorted({x.kind for x in s}) for s in spans], pa.list_(pa.string())))
                yield pa.record_batch(out, names=[*kept, *[f.name for f in fields]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], *fields]))


__all__ = ["Span", "find", "luhn", "mod97_account", "mod97_french", "name_words", "redact", "redact_columns", "tax_id", "travel_document"]
