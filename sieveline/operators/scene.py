"""Element lists of pages: harvest from HTML, relevance tiers, trimming."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles, states and stop words of the relevance tiers.
ACTIONABLE_ROLES = ("link", "button", "textbox", "searchbox", "combobox", "checkbox", "radio", "switch", "slider", "spinbutton", "menuitem", "menuitemcheckbox", "menuitemradio", "tab", "option", "treeitem")
ACTIONABLE_STATES = ("clickable", "typeable", "selectable", "focusable", "editable", "checkable", "toggleable")
NAV_FORM_ROLES = ("navigation", "search", "form", "menu", "menubar", "toolbar", "tablist")
STRUCTURE_ROLES = ("heading", "banner", "main", "contentinfo", "complementary", "region", "landmark", "alert", "status", "dialog", "alertdialog", "label")
STOP_WORDS = ("the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "click", "type", "enter", "search", "find", "go", "open", "navigate")
#: Roles of tags, most nodes of a page and characters of a text.
TAG_ROLES = {"a": "link", "button": "button", "h1": "heading", "h2": "heading", "h3": "heading", "nav": "navigation", "ul": "list", "ol": "list", "li": "listitem", "article": "article", "footer": "contentinfo", "header": "banner", "main": "main", "form": "form", "select": "combobox", "textarea": "textbox", "img": "img", "p": "paragraph"}
MOST_NODES, MOST_TEXT = 1000, 200
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Harvest(HTMLParser):
    """Elements in order of their start, each with its own text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self._open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        self.nodes.append({"tag": tag, "depth": len(self._open), "href": given.get("href"), "type": given.get("type"), "label": given.get("aria-label") or given.get("title") or given.get("alt"), "text": []})
        if tag not in VOID:
            self._open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self.nodes[self._open[k]]["tag"] == tag:
                del self._open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self._open and self.nodes[self._open[-1]]["tag"] not in ("script", "style"):
            self.nodes[self._open[-1]]["text"].append(data)


def harvest(pages: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """A row per element: page_id, ord, depth, tag, role, name, text, href.

    The first ``most`` elements of a page are kept, which is the operator's own
    limit; own texts are trimmed and cut to 200 characters. A null page has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("page_id", "ord", "depth", "tag", "role", "name", "text", "href")}
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
                parser = _Harvest()
                parser.feed(html.as_py() or "")
                parser.close()
                for k, node in enumerate(parser.nodes[:most]):
                    text = " ".join("".join(node["text"]).split())[:MOST_TEXT]
                    row = (page, k, node["depth"], node["tag"], TAG_ROLES.get(node["tag"], "generic"), (node["label"] or text)[:MOST_TEXT], text, node["href"])
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id bigint, ord bigint, depth bigint, tag string, role string, name string, text string, href string")


def task_terms(task: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(task), r"[^0-9a-z_\s]", " "), r"\s+")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 2), F.array(*map(F.lit, STOP_WORDS)))


def tier(terms: Column, width: float = 1280.0, height: float = 800.0, margin: float = 100.0) -> Column:
    """0 to 11; of columns role, name, value, actionability, source, x, y, w, h, duplicate."""
    role = F.col("role")
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("value", F.lit("")), F.coalesce("role", F.lit(""))))
    named = F.exists(terms, lambda t: F.contains(text, t))
    act = F.coalesce(role.isin(*ACTIONABLE_ROLES), F.lit(False)) | F.coalesce(F.col("actionability").isin(*ACTIONABLE_STATES), F.lit(False))
    view = (F.col("x") + F.col("w") > -margin) & (F.col("y") + F.col("h") > -margin) & (F.col("x") < width + margin) & (F.col("y") < height + margin)
    dom = F.array_contains("source", "dom") | F.array_contains("source", "a11y")
    both = F.array_contains("source", "dom") & F.array_contains("source", "vision")
    new = ~F.col("duplicate")
    rules = (named & act, act & view & dom, act & dom, both & view, role.isin(*NAV_FORM_ROLES), named, role.isin(*STRUCTURE_ROLES) & view, dom & view & new, dom & new, ~dom & view & new, F.col("duplicate"))
    out = F.lit(11)
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(rules[k], k).otherwise(out)
    return out


def compact(nodes: DataFrame, task: str, most: int) -> DataFrame:
    """The ``most`` nodes of each scene by tier, then order: scene, n_id, tier.

    Later nodes of one role and lower-cased name count as duplicates. A scene of
    at most ``most`` nodes stays as it is.
    """
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    seen = F.row_number().over(Window.partitionBy("scene", "role", name).orderBy("ord"))
    tiered = nodes.withColumn("duplicate", (name != "") & (seen > 1)).withColumn("tier", tier(task_terms(F.lit(task))))
    rank = F.row_number().over(Window.partitionBy("scene").orderBy("tier", "ord"))
    return tiered.withColumn("k", rank).where(F.col("k") <= most).select("scene", "n_id", "tier")
