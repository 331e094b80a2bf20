"""Listings that offer the same product, by terms and pairs that reinforce each other.

One pass over titles and attributes, brought to one consistent form first, takes out model codes, words, measures in base
units and colours. Those are a listing's terms; a product variant has the same kinds of terms. Listings with equal terms
are one signature. A signature and a variant that share a code or a line name are a pair; misspelled line names are found
by the forms that up to two left-out letters give, so no word is held against every name.

Terms and pairs are then updated in turn until the terms' weights settle: a pair scores the share of its signature's term
weights that its variant has too, and a term weighs the mean score of the pairs whose signature has it, counting pairs
whose variant lacks it as 0. Terms that go with the right variants gain, words that fit many models lose. The variant of
the best score above ``ACCEPT`` is a signature's; if several are as good their model must be one. Listings of one model,
measure and colour are a class; a trait that a listing states is its own, others follow from its best variants. Parts and
accessories are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkit.llm.unicode_fold import fold_array
from stallkit.session import Workspace

#: Least score of a pair, and what the weights may still move by when they have settled.
ACCEPT, SETTLED = 0.5, 1e-3
#: Scores that differ by less are equal.
EQUAL = 1e-9
#: Far more rounds than any input seen needs; whoever reaches it is told.
MOST_ROUNDS = 60
#: Words shorter than this are not taken for misspelled names, and more edits than this are not taken for a slip.
NEAR_LETTERS, NEAR_EDITS = 6, 3

#: Units and their size in the base unit of their dimension: GB, g, mm, W, ml. Fixed values.
UNITS = {
    "mb": ("gb", 0.001), "mo": ("gb", 0.001), "gb": ("gb", 1), "go": ("gb", 1), "gigabyte": ("gb", 1), "tb": ("gb", 1000), "to": ("gb", 1000), "terabyte": ("gb", 1000),
    "mg": ("g", 0.001), "g": ("g", 1), "gr": ("g", 1), "gramm": ("g", 1), "gram": ("g", 1), "gramme": ("g", 1), "kg": ("g", 1000), "kilo": ("g", 1000), "kilogramm": ("g", 1000), "kilogram": ("g", 1000), "kilogramme": ("g", 1000),
    "mm": ("mm", 1), "millimeter": ("mm", 1), "millimetre": ("mm", 1), "millimètre": ("mm", 1), "cm": ("mm", 10), "zentimeter": ("mm", 10), "centimeter": ("mm", 10), "centimetre": ("mm", 10), "centimètre": ("mm", 10), "m": ("mm", 1000), "meter": ("mm", 1000), "metre": ("mm", 1000), "mètre": ("mm", 1000),
    "zoll": ("mm", 25.4), "inch": ("mm", 25.4), "inche": ("mm", 25.4), "pouce": ("mm", 25.4), '"': ("mm", 25.4), "''": ("mm", 25.4), "”": ("mm", 25.4), "″": ("mm", 25.4),
    "w": ("w", 1), "watt": ("w", 1), "kw": ("w", 1000), "kilowatt": ("w", 1000),
    "ml": ("ml", 1), "milliliter": ("ml", 1), "millilitre": ("ml", 1), "cl": ("ml", 10), "l": ("ml", 1000), "liter": ("ml", 1000), "litre": ("ml", 1000),
}
#: Colour words and the colour they name. Fixed values.
COLOURS = {
    w: name
    for name, words in {
        "black": "black schwarz noir noire zwart negro", "white": "white weiß weiss blanc blanche wit blanco", "red": "red rot rouge rood rojo", "blue": "blue blau bleu bleue blauw azul",
        "green": "green grün gruen vert verte groen verde", "brown": "brown braun marron brun bruin", "silver": "silver silber silbern argenté argent argentée zilver plata", "orange": "orange oranje naranja",
        "grey": "grey gray grau gris grise grijs", "yellow": "yellow gelb jaune geel amarillo", "gold": "gold golden doré", "pink": "pink rosa rose roze", "purple": "purple lila violett violet",
    }.items()
    for w in words.split()
}
_I = regex.IGNORECASE
_UNIT = "|".join(regex.escape(u) for u in sorted(UNITS, key=len, reverse=True))
MEASURE = regex.compile(rf"(?<![\p{{L}}\d.,/-])(?P<n>\d+(?:[.,]\d+)?)[\s-]?(?P<u>g b|t b|m b|(?:{_UNIT})s?)(?![\p{{L}}\d])", _I)
CODE = regex.compile(r"(?<![\p{L}\d])([a-z]{2})[-/ ]?(\d{4})(?![\p{L}\d])", _I)
WORD = regex.compile(r"\p{L}{4,}")
#: Signs of a part or an accessory made for a product, or its empty box. Fixed values.
PART = regex.compile(
    r"(?<!\p{L})(?:passend (?:für|zu)|compatible (?:with|avec)|(?:fits|suitable for)|ersatz\p{L}+|spare (?:battery|part)s?|replacement|(?:batterie|pièce)s? de rechange|"
    r"(?:tasche|hülle|etui|ladegerät|netzteil|akku|zubehör|karton|ovp|verpackung|anleitung|kabel) (?:für|zu|von)|nur (?:der |die |das )?(?:karton|ovp|verpackung|anleitung)|leerer? (?:karton|ovp)|leerkarton|"
    r"(?:case|bag|cover|charger|battery|cable|box|manual|pouch|strap) (?:for|of)|(?:empty )?box only|empty box|(?:housse|étui|chargeur|batterie|câble|boîte|carton|sacoche|notice|coque) (?:pour|de|du)|"
    r"(?:boîte|carton|notice|emballage|housse) (?:seule?|vide)|(?:chargeur|batterie|housse|câble|coque) compatible)(?!\p{L})", _I)  # fmt: skip

FOUND = "id string, codes array<string>, words array<string>, gb array<bigint>, g array<bigint>, mm array<bigint>, w array<bigint>, ml array<bigint>, colours array<string>, part boolean"
DIMENSIONS = ("gb", "g", "mm", "w", "ml")


def measures(text: str) -> dict[str, set[int]]:
    """Whole base units of every measure in a text in consistent form, by dimension."""
    out: dict[str, set[int]] = {}
    for m in MEASURE.finditer(text):
        u = m.group("u").lower().replace(" ", "")
        dim, size = UNITS.get(u) or UNITS[u.rstrip("s")]
        out.setdefault(dim, set()).add(int(float(m.group("n").replace(",", ".")) * size + 0.5))
    return out


def colours(text: str) -> set[str]:
    return {COLOURS[w] for w in regex.findall(r"\p{L}+", text.lower()) if w in COLOURS}


def traits(title: str, attributes: list[str]) -> tuple:
    """Codes, words, measures, colours and the part sign. What attributes state goes before the title's."""
    lower = title.lower()
    stated = [a.lower() for a in attributes]
    every = "\n".join([lower, *stated])
    own, told = measures("\n".join(stated)), measures(lower)
    said = set().union(*[{COLOURS[a.strip()]} for a in stated if a.strip() in COLOURS]) if stated else set()
    codes = sorted({a + b for a, b in CODE.findall(every)})
    return codes, sorted(set(WORD.findall(every))), *[sorted(own.get(d) or told.get(d) or ()) for d in DIMENSIONS], sorted(said or colours(lower)), bool(PART.search(lower))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("id", pa.string()), ("codes", pa.list_(pa.string())), ("words", pa.list_(pa.string())), *[(d, pa.list_(pa.int64())) for d in DIMENSIONS], ("colours", pa.list_(pa.string())), ("part", pa.bool_())]
    )
    for batch in batches:
        titles = fold_array(batch.column(1))[0].to_pylist()
        # Attribute values are joined by a sign that folding keeps, so one pass folds them all.
        values = fold_array(batch.column(2))[0].to_pylist()
        rows = [traits(t or "", v.split("\x1f") if v else []) for t, v in zip(titles, values, strict=True)]
        columns = [batch.column(0).to_pylist(), *(zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1))]
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_traits(df: DataFrame) -> DataFrame:
    """Traits of rows with ``id``, ``title`` and ``attributes``."""
    values = F.concat_ws("\x1f", F.map_values("attributes"))
    return df.select("id", F.col("title"), F.coalesce(values, F.lit("")).alias("values")).mapInArrow(_read, FOUND)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with what is left of each without one or two letters."""
    for batch in batches:
        out = [(w, sorted({"".join(c for i, c in enumerate(w) if i not in gone) for k in range(3) for gone in combinations(range(len(w)), k)})) for w in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array([w for w, fs in out for _ in fs], pa.string()), pa.array([f for _, fs in out for f in fs], pa.string())], names=["word", "form"])


def shortened(words: DataFrame) -> DataFrame:
    """``word, form`` of a frame with one column of words."""
    return words.mapInArrow(_forms, "word string, form string")


def _terms_of(kinds: Column, measures_of: dict[str, Column], colours_of: Column) -> Column:
    def marked(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(f"{kind}:"), x.cast("string")))

    return F.array_distinct(F.concat(kinds, *[marked(d, m) for d, m in measures_of.items()], marked("colour", colours_of)))


def variants_of(products: DataFrame, ws: Workspace) -> DataFrame:
    """``v, code, line, brand, dim, measure, colour, terms`` of every product whose name ends in a line name and a model code."""
    parts = F.split(F.lower("name"), " ")
    slug = F.split("seo_id", "-")
    named = products.where(F.col("name").isNotNull() & F.col("seo_id").isNotNull() & (F.size(parts) > 2)).select(
        F.col("seo_id").alias("id"), F.lit("").alias("title"), "attributes", F.regexp_replace(parts[F.size(parts) - 1], "[^a-z0-9]", "").alias("code"), parts[F.size(parts) - 2].alias("line"), parts[0].alias("brand"),
        F.try_element_at(slug, F.lit(-2)).try_cast("bigint").alias("slug_measure"), F.element_at(slug, -1).alias("slug_colour"), F.try_element_at("category", F.lit(-1)).alias("kind"))
    stated = read_traits(named).select("id", *DIMENSIONS, "colours")
    dim = F.coalesce(*[F.when(F.size(d) == 1, F.lit(d)) for d in DIMENSIONS])
    value = F.coalesce(*[F.when(F.size(d) == 1, F.col(d)[0]) for d in DIMENSIONS])
    rows = named.drop("title", "attributes").join(stated, "id").select("id", "code", "line", "brand", "kind", "slug_measure", "slug_colour", dim.alias("dim"), value.alias("measure"), F.when(F.size("colours") == 1, F.col("colours")[0]).alias("colour"))
    rows = ws.cut(rows, "named")
    kind_dim = rows.where("dim is not null").groupBy("kind").agg(F.mode("dim").alias("kind_dim"))
    # Keys of products state lengths in the unit usual for their kind; those with attributes show which.
    ratio = rows.where("dim = 'mm' and slug_measure > 0").groupBy("kind").agg(F.median(F.col("measure") / F.col("slug_measure")).alias("r"))
    ratio = ratio.select("kind", F.array_min(F.array(*[F.struct(F.abs(F.log(F.col("r") / x)), F.lit(x)) for x in (1.0, 10.0, 25.4)]))["col2"].alias("per_unit"))
    known = rows.join(kind_dim, "kind", "left").join(ratio, "kind", "left")
    # All variants of a model are measured alike.
    code_dim = known.groupBy("code").agg(F.mode(F.coalesce("dim", "kind_dim")).alias("code_dim"))
    known = known.drop("dim").join(code_dim.withColumnRenamed("code_dim", "dim"), "code", "left")
    from_slug = F.floor(F.col("slug_measure") * F.coalesce("per_unit", F.lit(1.0)) + 0.5)
    known = known.withColumn("measure", F.coalesce("measure", from_slug)).withColumn("colour", F.coalesce("colour", "slug_colour"))
    names = F.array(F.concat(F.lit("code:"), "code"), F.concat(F.lit("line:"), "line"), F.concat(F.lit("brand:"), "brand"))
    traits_of = F.array_compact(F.array(F.concat("dim", F.lit(":"), F.col("measure").cast("string")), F.concat(F.lit("colour:"), "colour")))
    known = known.groupBy("id").agg(*[F.first(c).alias(c) for c in ("code", "line", "brand", "dim", "measure", "colour")])
    return known.select(F.col("id").alias("v"), "code", "line", "brand", "dim", "measure", "colour", F.array_distinct(F.concat(names, traits_of)).alias("terms"))


def signatures(read: DataFrame, variants: DataFrame) -> DataFrame:
    """``id, terms`` of every listing with a term that names a model: its codes, lines, brands, measures and colours."""
    words = read.select("id", F.explode("words").alias("word"))
    lines = variants.select(F.col("line").alias("word"), F.concat(F.lit("line:"), "line").alias("term")).distinct()
    brands = variants.select(F.col("brand").alias("word"), F.concat(F.lit("brand:"), "brand").alias("term")).distinct()
    coded = read.select("id", F.explode("codes").alias("code")).join(variants.select("code").distinct(), "code").select("id", F.concat(F.lit("code:"), "code").alias("term"))
    named = coded.unionByName(words.join(lines, "word").select("id", "term"))
    # Words of listings that name no model may be misspelled line names; each different word is looked at once.
    left = words.where(F.length("word") >= NEAR_LETTERS).join(named.select("id").distinct(), "id", "left_anti")
    forms = shortened(left.select("word").distinct())
    near = forms.join(shortened(lines.select("word")).select(F.col("word").alias("line"), "form"), "form").select("word", "line").distinct()
    near = near.withColumn("edits", F.levenshtein("word", "line")).where(F.col("edits") <= NEAR_EDITS)
    near = near.groupBy("word").agg(F.collect_list(F.struct("edits", "line")).alias("e")).withColumn("least", F.array_min(F.transform("e", lambda x: x["edits"])))
    near = near.select("word", F.explode(F.filter("e", lambda x: x["edits"] == F.col("least"))).alias("x")).select("word", F.concat(F.lit("line:"), "x.line").alias("term"))
    named = named.unionByName(left.join(near, "word").select("id", "term"))
    every = named.unionByName(words.join(brands, "word").select("id", "term"))
    terms = every.groupBy("id").agg(F.collect_set("term").alias("kinds")).where(F.exists("kinds", lambda t: ~t.startswith("brand:")))
    both = terms.join(read.select("id", "colours", *DIMENSIONS), "id")
    return both.select("id", F.array_sort(_terms_of(F.col("kinds"), {d: F.col(d) for d in DIMENSIONS}, F.col("colours"))).alias("terms"))


def pairs_of(signs: DataFrame, variants: DataFrame, ws: Workspace) -> DataFrame:
    """``pid, sig, v, n, terms, v_terms``: a signature with each variant of which it has the code or line."""
    names = lambda t: F.filter(t, lambda x: x.startswith("code:") | x.startswith("line:"))
    a = signs.select("sig", "n", "terms", F.explode(names(F.col("terms"))).alias("name"))
    b = variants.select("v", F.col("terms").alias("v_terms"), F.explode(names(F.col("terms"))).alias("name"))
    # Numbers are given to written rows, so that a lost task's rerun gives them again.
    pairs = ws.cut(a.join(b, "name").dropDuplicates(["sig", "v"]).drop("name"), "met")
    return ws.cut(pairs.withColumn("pid", F.monotonically_increasing_id()), "pairs")


def pair_links(pairs: DataFrame) -> DataFrame:
    """``pid, n, term, shared`` of every term of every pair's signature."""
    return pairs.select("pid", "n", "v_terms", F.explode("terms").alias("term")).select("pid", "n", "term", F.array_contains("v_terms", F.col("term")).alias("shared"))


def pair_scores(links: DataFrame, weights: DataFrame) -> DataFrame:
    """``pid, s``: the share of the weight of a signature's terms that a variant has too."""
    held = links.join(weights, "term").groupBy("pid").agg(F.sum(F.when(F.col("shared"), F.col("x")).otherwise(0.0)).alias("a"), F.sum("x").alias("b"))
    return held.select("pid", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("s"))


def reinforced(links: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """``term, x``: weights of terms when they have settled, and the number of rounds that took."""
    weights = ws.cut(links.select("term").distinct().withColumn("x", F.lit(1.0)), "weights0")
    for turn in range(1, MOST_ROUNDS + 1):
        scored = links.join(pair_scores(links, weights), "pid")
        mean = F.sum(F.when(F.col("shared"), F.col("s")).otherwise(0.0) * F.col("n")) / F.sum("n")
        new = ws.cut(scored.groupBy("term").agg(mean.alias("x")), f"weights{turn}")
        moved = new.join(weights.withColumnRenamed("x", "before"), "term").agg(F.max(F.abs(F.col("x") - F.col("before")))).first()[0]
        ws.drop(f"weights{turn - 1}")
        weights = new
        if moved is None or moved < SETTLED:
            return weights, turn
    warnings.warn(f"weights still move by {moved:.2g} after {MOST_ROUNDS} rounds", RuntimeWarning, stacklevel=2)
    return weights, MOST_ROUNDS


def classes(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Model, measure and colour of every ungrouped listing that offers a product: ``id, code, dim, measure, colour, score``.

    Traits that neither the listing nor its best variants settle are null; parts, and listings whose terms lead to no
    model or to several, are left out. Copies of an id give one row. Null titles and attributes state nothing.
    """
    ws = Workspace(listings.sparkSession, "same")
    own = listings.where(F.col("seo_id").isNull() & F.col("id").isNotNull()).select("id", "title", "attributes").dropDuplicates(["id"])
    read = ws.cut(read_traits(own).where(~F.col("part")), "read")
    variants = ws.cut(variants_of(products, ws), "variants")
    listed = ws.cut(signatures(read, variants).withColumn("sig", F.concat_ws(" ", "terms")), "listed")
    signs = ws.cut(listed.groupBy("sig").agg(F.count("*").alias("n"), F.first("terms").alias("terms")), "signs")
    pairs = pairs_of(signs, variants, ws)
    links = ws.cut(pair_links(pairs), "links")
    weights, _ = reinforced(links, ws)
    scored = pair_scores(links, weights).where(F.col("s") >= ACCEPT).join(pairs.select("pid", "sig", "v"), "pid")
    found = scored.join(variants.select("v", "code", "dim", "measure", "colour"), "v").groupBy("sig").agg(F.max("s").alias("score"), F.collect_list(F.struct("s", "code", "dim", "measure", "colour")).alias("every"))
    best = found.select("sig", "score", F.filter("every", lambda x: x["s"] >= F.col("score") - EQUAL).alias("best"))
    one = best.where(F.size(F.array_distinct(F.transform("best", lambda x: x["code"]))) == 1).select("sig", "score", "best", F.col("best")[0]["code"].alias("code"), F.col("best")[0]["dim"].alias("dim"))
    matched = ws.cut(one.join(signs.select("sig", "terms"), "sig"), "matched")

    def stated(prefix: Column) -> Column:
        """The one value the terms of a kind state, null if there are none or several."""
        told = F.filter("terms", lambda t: t.startswith(F.concat(prefix, F.lit(":"))))
        return F.when(F.size(told) == 1, F.substring_index(told[0], ":", -1))

    def only(field: str) -> Column:
        """The value all best variants have."""
        values = F.array_distinct(F.transform("best", lambda v: v[field]))
        return F.when(F.size(values) == 1, values[0])

    told = matched.select("sig", "code", "dim", F.coalesce(stated(F.col("dim")).cast("bigint"), only("measure")).alias("measure"), F.coalesce(stated(F.lit("colour")), only("colour")).alias("colour"), "score")
    return ws.finish(listed.select("id", "sig").join(told, "sig").drop("sig"))


def same_product(found: DataFrame) -> DataFrame:
    """Pairs of listings whose model, measure and colour are all known and equal, smaller id first."""
    full = found.where("measure is not null and colour is not null")
    key = ["code", "measure", "colour"]
    a, b = full.select(*key, F.col("id").alias("id_a")), full.select(*key, F.col("id").alias("id_b"))
    return a.join(b, key).where("id_a < id_b").select("id_a", "id_b")


__all__ = ["classes", "colours", "measures", "pair_links", "pair_scores", "pairs_of", "read_traits", "reinforced", "same_product", "signatures", "traits", "variants_of"]
