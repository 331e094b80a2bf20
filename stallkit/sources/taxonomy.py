"""The category tree as a table of paths.

The tree is a reference file of bounded size: it is read and flattened once on the driver, and walks along it are map
lookups inside column expressions. Slugs and labels are compared without regard to case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkit.functions.vocabulary import sql_text

DEFAULT_FILE = Path(__file__).with_name("categories.json")
#: A tree of more categories is refused: walks along it are literals of the plan.
MAX_CATEGORIES = 20_000
NODES = (
    "preorder int, depth int, slug string, label string, path array<string>, labels array<string>, prompt string, attributes map<string,string>, inherited map<string,string>, is_leaf boolean, parent int"
)


class Category(NamedTuple):
    preorder: int
    depth: int
    slug: str
    label: str
    path: list[str]
    labels: list[str]
    prompt: str | None
    attributes: dict[str, str] | None
    inherited: dict[str, str]
    is_leaf: bool
    parent: int


def find_file(candidates: Sequence[str | Path]) -> Path:
    """The first of the files that is there."""
    for c in candidates:
        if Path(c).is_file():
            return Path(c)
    raise FileNotFoundError(f"no category file at {', '.join(map(str, candidates))}")


def merged(base: dict[str, str], over: dict[str, str] | None) -> dict[str, str]:
    """``base`` with the entries of ``over`` in place; keys are compared without case, the first spelling stays."""
    out = dict(base)
    spelled = {k.lower(): k for k in out}
    for k, v in (over or {}).items():
        out[spelled.setdefault(k.lower(), k)] = v
    return out


def load(path: str | Path = DEFAULT_FILE) -> list[Category]:
    """All categories of a file in preorder. Property names are matched without regard to case."""

    def lower(x):
        return {k.lower(): v for k, v in x.items()}

    def walk(items: list, path: list[str], labels: list[str], inherited: dict[str, str], parent: int) -> Iterator[Category]:
        nonlocal count
        for item in map(lower, items or []):
            if count >= MAX_CATEGORIES:
                raise ValueError(f"more than {MAX_CATEGORIES} categories")
            mine, count = count, count + 1
            here, told = [*path, item["slug"]], [*labels, item["label"]]
            own, subs = item.get("attributes"), item.get("subcategories")
            all_attributes = merged(inherited, own)
            yield Category(mine, len(here), item["slug"], item["label"], here, told, item.get("attributeextractionprompt"), own, all_attributes, subs is None, parent)
            yield from walk(subs, here, told, all_attributes, mine)

    count = 0
    return list(walk(lower(json.loads(Path(path).read_text()))["categories"], [], [], {}, -1))


def nodes(spark: SparkSession, tree: Sequence[Category]) -> DataFrame:
    """The tree as a table, in preorder by its first column."""
    return spark.createDataFrame([tuple(c) for c in tree], NODES)


def lookup(table: DataFrame) -> DataFrame:
    """One category a slug: of equal slugs the last in preorder."""
    best = table.groupBy(F.lower("slug").alias("_slug")).agg(F.max_by(F.struct(*table.columns), "preorder").alias("c"))
    return best.select("c.*")


def category(table: DataFrame, slug: str) -> DataFrame:
    """The category of a slug, or no row."""
    return table.filter(F.lower("slug") == slug.lower()).orderBy(F.desc("preorder")).limit(1)


def top_level(table: DataFrame) -> DataFrame:
    return table.filter(F.col("depth") == 1)


def sub_categories(table: DataFrame, parent: str) -> DataFrame:
    """Categories below a top-level one; a slug deeper down gives no rows."""
    of = table.filter((F.col("depth") == 1) & (F.lower("slug") == parent.lower())).orderBy("preorder").limit(1).select(F.col("preorder").alias("_p"))
    return table.join(of, F.col("parent") == F.col("_p"), "left_semi")


def resolved_path(table: DataFrame, slug: str) -> DataFrame:
    """The path of a slug: of equal slugs the first in preorder; no row if there is none."""
    return table.filter(F.lower("slug") == slug.lower()).orderBy("preorder").limit(1).select("path")


def _literal(entries: dict[str, str]) -> Column:
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in entries.items()) + ")")


def _steps(tree: Sequence[Category]) -> dict[str, str]:
    """``level|segment`` to ``category|next level``: of a level's categories the first whose slug or label fits.

    A category without sub-categories leaves the level as it is, so the next segment is looked for among its siblings.
    """
    out: dict[str, str] = {}
    for c in tree:
        for name in (c.slug, c.label):
            out.setdefault(f"{c.parent}|{name.lower()}", f"{c.preorder}|{c.parent if c.is_leaf else c.preorder}")
    return out


def _walk(path: Column, tree: Sequence[Category], stop_at_leaf: bool) -> Column:
    """``struct<node, level, ok>`` after following a path as far as it goes."""
    steps = _literal(_steps(tree))
    start = F.struct(F.lit("-1").alias("node"), F.lit("-1").alias("level"), F.lit(True).alias("ok"))

    def step(at: Column, segment: Column) -> Column:
        to = F.try_element_at(steps, F.concat_ws("|", at["level"], F.lower(segment)))
        node, level = F.substring_index(to, "|", 1), F.substring_index(to, "|", -1)
        go = at["ok"] & to.isNotNull()
        leaf = (level != node) if stop_at_leaf else F.lit(False)
        return F.struct(F.when(go, node).otherwise(at["node"]).alias("node"), F.when(go, level).otherwise(at["level"]).alias("level"), (go & ~leaf).alias("ok"))

    return F.aggregate(path, start, step)


def prompt_for(path: Column, tree: Sequence[Category]) -> Column:
    """The prompt of the category at the end of a path of slugs or labels; null if a segment is missing or the path is empty."""
    prompts = _literal({str(c.preorder): c.prompt for c in tree if c.prompt is not None})
    end = _walk(path, tree, False)
    return F.when((F.size(path) > 0) & end["ok"], F.try_element_at(prompts, end["node"]))


def attributes_for(path: Column, tree: Sequence[Category]) -> Column:
    """Attributes of the categories along a path, those further down replacing others; a missing segment ends the walk. Null if there are none."""
    of = {str(c.preorder): c.inherited for c in tree if c.inherited}
    if not of:
        return F.lit(None).cast("map<string,string>")
    maps = F.expr("map(" + ", ".join(f"'{k}', map({', '.join(f'{sql_text(a)}, {sql_text(b)}' for a, b in v.items())})" for k, v in of.items()) + ")")
    return F.when(F.size(path) > 0, F.try_element_at(maps, _walk(path, tree, True)["node"]))


def category_matches(wanted: Column, path: Column) -> Column:
    """Whether ``wanted`` is the beginning of ``path``; an empty one begins every path. Null on either side is no match."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    fits = (F.size(wanted) <= F.size(path)) & (low(wanted) == F.slice(low(path), 1, F.greatest(F.size(wanted), F.lit(0))))
    return F.coalesce(F.when(wanted.isNotNull() & path.isNotNull(), fits), F.lit(False))
