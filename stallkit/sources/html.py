"""Pages of HTML as rows: one pass of a small document tree, everything after it is columns.

The tree is that of the markup as written: void elements close themselves, ``p`` and ``li`` and table cells close where
the next begins, end tags close what they match. Scripts, styles, ``noscript``, ``svg`` and ``template`` are left out.
"""

from __future__ import annotations

import html
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("script style noscript svg template".split())
#: Elements that end an open one of the set beside them. Fixed values.
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Longest text of an element that any rule looks at.
LONGEST = 220
LONGEST_ID = 80
_SPACE = regex.compile(r"[\s\p{Z}]+")
_HEADINGS = frozenset(("h1", "h2", "h3", "p", "li"))

META = "struct<property:string,name:string,itemprop:string,content:string,selector:string>"
NODE = "struct<ord:int,tag:string,id:string,class:string,itemprop:string,testid:string,label:string,text:string,children:int,selector:string,in_body:boolean,shown:boolean>"
PAGE = f"metas array<{META}>, nodes array<{NODE}>, images array<string>, h1 string, title string"


def clean(text: str | None) -> str:
    """Entities decoded twice, runs of white space one space."""
    return _SPACE.sub(" ", html.unescape(html.unescape(text))).strip() if text else ""


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "nth", "counts", "size", "shape")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.counts: dict[str, int] = {}
        self.nth = 1
        if parent is not None:
            self.nth = parent.counts[tag] = parent.counts.get(tag, 0) + 1
            parent.children.append(self)

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def elements(self) -> Iterator[Element]:
        """This element and those below it, in document order."""
        todo = [self]
        while todo:
            at = todo.pop()
            yield at
            todo.extend(c for c in reversed(at.children) if isinstance(c, Element))


class Tree(HTMLParser):
    """Builds the tree of a page; ``noisy`` keeps scripts and the like."""

    def __init__(self, noisy: bool = False):
        super().__init__(convert_charrefs=False)
        self.root = self.at = Element("#document", {}, None)
        self.noisy, self.skip = noisy, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip or (tag in NOISE and not self.noisy):
            self.skip += tag in NOISE and tag not in VOID
            return
        ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        at = self.at
        while at.parent is not None and ends and at.tag not in ("ul", "ol", "table", "dl", "select", "div", "body"):
            if at.tag in ends:
                self.at = at.parent
                break
            at = at.parent
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        e = Element(tag, first, self.at)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        skip = self.skip
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not skip:
            self.skip = 0
            if self.at.tag == tag:
                self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.skip -= tag in NOISE
            return
        at: Element | None = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def _text(self, text: str) -> None:
        if not self.skip:
            self.at.children.append(text)

    def handle_data(self, data: str) -> None:
        self._text(data)

    def handle_entityref(self, name: str) -> None:
        self._text(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._text(f"&#{name};")


def parse(text: str, noisy: bool = False) -> Element:
    tree = Tree(noisy)
    tree.feed(text)
    tree.close()
    return tree.root


def inner_texts(root: Element) -> dict[int, str | None]:
    """Clean text of every element by its identity; None where it is longer than any rule looks at.

    An element's text is at least as long as each child's, so long texts are never joined again further up.
    """
    raw: dict[int, str | None] = {}
    out: dict[int, str | None] = {}
    for e in reversed(list(root.elements())):
        parts = [raw[id(c)] if isinstance(c, Element) else c for c in e.children]
        text = None if any(p is None for p in parts) else "".join(parts)
        told = None if text is None else clean(text)
        if told is not None and len(told) > LONGEST:
            text = told = None
        raw[id(e)], out[id(e)] = text, told
    return out


def whole_text(e: Element) -> str:
    """Clean text of an element, however long."""
    parts, todo = [], [e]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        else:
            todo.extend(reversed(at.children))
    return clean("".join(parts))


def selector(e: Element) -> str:
    """The path to an element by tag and place among its kind, from the nearest element with an id, or ``html``."""
    parts = []
    at: Element | None = e
    while at is not None and at.parent is not None:
        name = at.get("id")
        if at.tag == "html":
            parts.append(at.tag)
            break
        if name.strip() and len(name) <= LONGEST_ID:
            parts.append(f"{at.tag}#{regex.sub(r'[^a-zA-Z0-9_-]', '_', name)}")
            break
        parts.append(f"{at.tag}:nth-of-type({at.nth})")
        at = at.parent
    return " > ".join(reversed(parts))


def _first(root: Element, tag: str) -> str:
    return next((whole_text(e) for e in root.elements() if e.tag == tag), "")


def page_row(text: str | None) -> dict:
    """What all rules need of a page. A null or empty page has no elements."""
    root = parse(text or "")
    texts = inner_texts(root)
    metas, nodes, images = [], [], []
    inside: set[int] = set()
    for n, e in enumerate(root.elements()):
        if e.parent is not None and (id(e.parent) in inside or e.parent.tag == "body"):
            inside.add(id(e))
        if e.tag == "meta":
            metas.append({k: e.get(k) for k in ("property", "name", "itemprop")} | {"content": clean(e.get("content")), "selector": selector(e)})
        if e.tag == "img" and (e.get("src") or e.get("data-src")):
            images.append(e.get("src") if e.get("src").strip() else e.get("data-src"))
        t = texts[id(e)]
        if e.parent is None or not t:
            continue
        css = e.get("class").lower()
        shown = e.tag in _HEADINGS or e.get("itemprop") == "name" or "title" in css or "name" in css
        if shown or id(e) in inside:
            nodes.append({"ord": n, "tag": e.tag, "id": e.get("id"), "class": e.get("class"), "itemprop": e.get("itemprop"), "testid": e.get("data-testid"), "label": e.get("aria-label"), "text": t,
                          "children": sum(isinstance(c, Element) for c in e.children), "selector": selector(e), "in_body": id(e) in inside, "shown": shown})
    return {"metas": metas, "nodes": nodes, "images": images, "h1": _first(root, "h1"), "title": _first(root, "title")}


#: Hides banners that ask for consent, in a page shown apart from its site. A fixed value.
BANNER_STYLE = (
    "[class*='cookie' i], [class*='consent' i], [id*='cookie' i], [id*='consent' i], [class*='banner' i][style*='fixed'], dialog[open] { display: none !important; } html, body { overflow: auto !important; }"
)


def sandboxed(text: str | None, url: str | None) -> str | None:
    """A page to be shown apart from its site: no scripts or handlers, forms that go nowhere, addresses relative to the site.

    A blank page gives null. Comments and the document type are left out.
    """
    if not text or not text.strip():
        return None
    root = parse(text, noisy=True)
    top = next((e for e in root.elements() if e.tag == "html"), None)
    head = next((e for e in root.elements() if e.tag == "head"), None)
    if head is None and top is not None:
        head = Element("head", {}, top)
        top.children.insert(0, top.children.pop())
    if head is not None:
        at = urlsplit(url or "")
        base, style = Element("base", {"href": f"{at.scheme}://{at.netloc}/"}, None), Element("style", {"id": "banner-strip"}, None)
        style.children.append(BANNER_STYLE)
        head.children[:0] = [style, base]
    out: list[str] = []
    todo: list[Element | str | tuple[str]] = list(reversed(root.children))
    while todo:
        e = todo.pop()
        if isinstance(e, tuple):
            out.append(e[0])
        elif isinstance(e, str):
            out.append(e)
        elif e.tag != "script":
            attrs = {k: v for k, v in e.attrs.items() if not k.lower().startswith("on")}
            if e.tag == "form" and "action" in attrs:
                attrs["action"] = "javascript:void(0)"
            shown = "".join(f' {k}="{html.escape(v, quote=True)}"' for k, v in attrs.items())
            out.append(f"<{e.tag}{shown}{' /' if e.tag in VOID else ''}>")
            if e.tag not in VOID:
                todo.append((f"</{e.tag}>",))
                todo.extend(reversed(e.children))
    return "".join(out)


def parse_pages(pages: DataFrame, key: str = "page_id", text: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """``key`` with ``metas, nodes, images, h1, title`` of every page, and the columns ``keep`` as they are. Others are not read."""
    rows = pages.select(F.col(key), F.col(text).cast("string").alias("t"), *keep)
    schema = rows.select(key).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made_fields = StructType.fromDDL(PAGE)
    whole = StructType([*schema.fields, *made_fields.fields, *rows.select(*keep).schema.fields])
    arrow = to_arrow_schema(made_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [page_row(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), *[pa.array([m[f.name] for m in made], f.type) for f in arrow], *part.columns[2:]]
                yield pa.record_batch(cols, names=[f.name for f in whole])

    return rows.mapInArrow(run, whole)


def sandbox_pages(pages: DataFrame, key: str = "page_id", text: str = "html", url: str = "url") -> DataFrame:
    """``key, sandbox_html`` of every page."""
    rows = pages.select(F.col(key), F.col(text).cast("string").alias("t"), F.col(url).cast("string").alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sandboxed(t, u) for t, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.string())], names=[key, "sandbox_html"])

    return rows.mapInArrow(run, rows.select(key).schema.add("sandbox_html", "string"))
