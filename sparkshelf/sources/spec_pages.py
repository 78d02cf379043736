"""Specification pages of several makers, read by declared layouts.

A layout says where a page keeps its name, its rows and its price: either as places in the document tree (tag and class) or as a path into the
page's state. One reader follows all layouts; a new maker is a new declaration. A page that has no row where its layout says is an error, since a
block page or a changed one must not look like a product without specifications."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkshelf.sources.page_state import FLAT, StateError, from_call, from_flat

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that break a line, and those whose content is no text.
LINES = frozenset("address article aside blockquote br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style template noscript svg".split())


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    inside: list[Node | str] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set(self.attributes.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        """This node and all below it in the page's order, without recursion."""
        open_ = [self]
        while open_:
            node = open_.pop()
            yield node
            open_ += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def find(self, place: str) -> list[Node]:
        """Nodes at ``tag``, ``.class`` or ``tag.class``."""
        tag, _, name = place.partition(".")
        return [n for n in self.walk() if n is not self and (not tag or n.tag == tag) and (not name or name in n.classes)]

    def lines(self, hidden: frozenset[str] = frozenset()) -> list[str]:
        """The text below this node, a line for each block, white space squeezed; hidden elements and classes are left out."""
        out: list[str] = []
        open_: list[Node | str] = [self]
        while open_:
            x = open_.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in SILENT and "hidden" not in x.attributes and not x.classes & hidden:
                breaks = ["\0"] if x.tag in LINES or "visuallyhidden" in x.classes else []
                open_ += [*breaks, *reversed(x.inside), *breaks]
        found = (" ".join(line.split()) for line in "".join(out).split("\0"))
        return [line for line in found if line]

    def text(self) -> str:
        return " ".join(self.lines())


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a start changes nothing
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


@dataclass(frozen=True)
class Layout:
    """Where a maker's pages keep what. ``state`` names the form of the page's state (flat or call), with ``variants`` the paths, the first of which that leads to a
    list is it; without it, rows are nodes: ``sections`` with ``heading``, and in each ``row`` a ``label`` and a ``value``, or, without a row, all its lines."""

    name: str = "title"
    state: str | None = None
    variants: tuple[tuple[str, ...], ...] = ()
    rows: tuple[str, ...] = ()
    pair: tuple[str, str] | None = None
    label: tuple[str, ...] | str = ()
    price: str | None = None
    sections: str = ""
    heading: str = ""
    row: str = ""
    value: str = ""
    hidden: frozenset[str] = frozenset()
    cut: str = ""


#: The places of three makers' pages.
LAYOUTS = {
    "flat": Layout(name="pinia.pdPageStore.productTabList.ModelName", state="flat", variants=(("pinia", "pdPageStore", "PDTechSpecM2List", "TechSpec"), ("pinia", "pdPageStore", "PDTechSpec", "TechSpec"), ("pinia", "pdPageStore", "PDTechSpecM2", "TechSpec")), rows=("SpecList",), label=("Name",)),
    "call": Layout(name="", state="call", variants=(("state", "Spec", "spec"),), rows=("specContent",), pair=("displayField", "descriptionText"), label=("mktName", "skuName"), price="price"),
    "groups": Layout(sections=".product-spec-swapper", heading=".product-spec-group", row="dl.product-spec-attribute", label=".label", value=".value", price="[data-price-type=finalPrice]"),
    "lines": Layout(sections=".techspecs-section", hidden=frozenset({"medium-down", "cto-pricing-failed"}), cut="-"),
}


class PageError(ValueError):
    pass


def _at(value, path) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _said(value) -> str:
    return value.strip() if isinstance(value, str) else "" if value is None or isinstance(value, dict | list) else str(value)


def money(value) -> str | None:
    """A price as text, null if it is none above zero."""
    try:
        amount = float(str(value).replace(",", "").replace("RM", ""))
    except ValueError:
        return None
    return f"{amount:.2f}" if 0 < amount < float("inf") else None


def _of_state(page: str, layout: Layout) -> list[tuple]:
    try:
        if layout.state == "flat":
            found = FLAT.search(page)
            state = from_flat(found[1]) if found else None
        else:
            state = from_call(page) if "window.__NUXT__=" in page else None
    except (StateError, RecursionError) as e:
        raise PageError(f"state: {e}") from e
    if state is None:
        raise PageError("no state")
    lists = [x for x in (_at(state, path) for path in layout.variants) if isinstance(x, list) and x]
    if not lists:
        raise PageError("no variants")
    base, out = _said(_at(state, layout.name.split("."))) if layout.name else "", []
    for n, variant in enumerate(lists[0], 1):
        names = [_said(_at(variant, (key,))) for key in layout.label]
        name, code = (names[0] if len(names) > 1 else base), names[-1]
        shown = f"{name} ({code})" if name and code else name or code
        rows = _at(variant, layout.rows)
        if layout.pair is None and isinstance(rows, dict):
            pairs = [(_said(k), _said(v)) for k, v in rows.items()]
        elif layout.pair is not None and isinstance(rows, list):
            pairs = [tuple(_said(_at(r, (key,))).replace("\\n", "\n") for key in layout.pair) for r in rows]
        else:
            raise PageError("rows of another kind than the layout says")
        price = money(_at(variant, (layout.price,))) if layout.price else None
        out += [(n, shown, "", k, v, price) for k, v in pairs if k and v]
    return out


def _of_tree(page: str, layout: Layout) -> list[tuple]:
    tree = Tree()
    tree.feed(page)
    tree.close()
    root, out, price = tree.root, [], None
    title = next((n.text() for n in root.find(layout.name)), "")
    if layout.cut:
        title = title.split(layout.cut)[0].strip()
    if layout.price:
        attribute, _, wanted = layout.price.strip("[]").partition("=")
        price = next((p for n in root.walk() if n.attributes.get(attribute) == wanted and (p := money(n.attributes.get("data-price-amount") or n.text()))), None)
    for section in root.find(layout.sections):
        heading = next((n.text() for n in section.find(layout.heading)), "") if layout.heading else ""
        if not layout.row:
            out += [(1, title, heading, "", line, price) for line in section.lines(layout.hidden)]
        for row in section.find(layout.row) if layout.row else []:
            label, value = (next((n.text() for n in row.find(place)), "") for place in (layout.label, layout.value))
            if label and value:
                out.append((1, title, heading, label, value, price))
    return out


def read_page(page: str | None, layout: Layout) -> tuple[list[tuple], str | None]:
    """(rows, error): (variant, product, section, label, value, price) of one page."""
    try:
        rows = (_of_state if layout.state else _of_tree)(page or "", layout)
    except PageError as e:
        return [], str(e)
    return (rows, None) if rows else ([], "no specification rows")


ROW = T.StructType([T.StructField("variant", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("product", "section", "label", "value", "price")]])
READ = T.StructType([T.StructField("rows", T.ArrayType(ROW)), T.StructField("error", T.StringType())])


def _reader(layouts: dict[str, Layout]):
    kind = pa.struct([("rows", pa.list_(pa.struct([("variant", pa.int32()), *[(n, pa.string()) for n in ("product", "section", "label", "value", "price")]]))), ("error", pa.string())])

    @F.arrow_udf(READ)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, makers in batches:
            found = []
            for page, maker in zip(pages, makers.to_pylist()):  # one page is held at a time
                rows, error = read_page(page.as_py(), layouts[maker]) if maker in layouts else ([], f"no layout for {maker}")
                found.append({"rows": [dict(zip(ROW.names, r)) for r in rows], "error": error})
            yield pa.array(found, kind)

    return read


def spec_rows(pages: DataFrame, id_col: str, html: str, layout: str | Column, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """(id_col, variant, product, section, label, value, price, error): a row for each specification of each page, in no order; a page that can't be read
    by its layout (a name of ``layouts``, given as a column) has one row with an error and nulls.

    Null and empty pages are errors like any page without rows; labels that a page repeats are repeated; pages of any length are read one at a time; an empty
    table gives none. Other columns are not read."""
    which = F.col(layout) if isinstance(layout, str) else layout
    read = _reader(layouts or LAYOUTS)
    each = pages.select(F.col(id_col).alias("__id"), read(F.col(html), which.cast("string")).alias("__r"))
    return each.select(F.col("__id").alias(id_col), F.explode_outer("__r.rows").alias("__s"), F.col("__r.error").alias("error")).select(id_col, "__s.*", "error")
