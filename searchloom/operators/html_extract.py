"""Typed answers of result pages, parsed with the standard library.

A page becomes a small tree; the lower-cased text of its first ``h2`` chooses
what is read from it, and pages of no known kind fall back to other marks.
Lists are arrays, not printed lists; dates have their own type; a part that is
missing gives a null, not an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = T.StructType(
    [
        T.StructField("answer_type", T.StringType()),
        T.StructField("short_answer", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("answer_url", T.StringType()),
        T.StructField("expanded_search", T.BooleanType()),
    ]
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

# Headings and the answer types that they stand for.
PLAIN_TYPES = {
    "resultados locales": "local_rst",
    "resultado de pronóstico del clima": "weather",
    "cómo llegar": "direction",
    "resultados deportivos": "sports",
    "resultados en el mapa": "map",
    "resultados de mapa": "map",
    "resultados de twitter": "twitter",
}
NO_ANSWER = {
    "resultados de la web", "resultados web", "people also ask", "avisos sobre resultados filtrados",
    "resultado web con vínculos a sitio", "resultado web con enlaces de sitio", "resultados complementarios",
}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, tag: str, **attrs: str) -> list[Node]:
        return [n for n in self.walk() if n.tag == tag and n.fits(attrs)]

    def first(self, tag: str, **attrs: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and n.fits(attrs)), None)

    def fits(self, attrs: dict[str, str]) -> bool:
        """Attributes by name (``_`` for ``-``, ``class_`` for class); a class is one of several."""
        for name, value in attrs.items():
            own = self.attrs.get(name.rstrip("_").replace("_", "-"))
            if own is None or value not in (own.split() if name == "class_" else [own]):
                return False
        return True

    def text(self, without: str | None = None) -> str:
        """All text, but for what is in tags named ``without``."""
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag != without:
                stack += reversed(x.children)
        return "".join(parts)

    def after(self) -> Node | None:
        """The next sibling."""
        own = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        at = next((i for i, c in enumerate(own) if c is self), len(own))
        return own[at + 1] if at + 1 < len(own) else None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _text(node: Node | None) -> str | None:
    return node.text() if node else None


def _unlinked(node: Node, found: str | None) -> str | None:
    """The text without the links that a ``›`` gives away."""
    return node.text(without="div") if found and "›" in found else found


def _link(node: Node | None) -> str | None:
    a = next((n for n in node.walk() if n.tag == "a" and "href" in n.attrs), None) if node else None
    return a.attrs["href"] if a else None


def _snippet_url(snippet: Node | None) -> str | None:
    if snippet is None:
        return None
    return _link(snippet.first("div", class_="g") or snippet)


def _snippet(snippet: Node | None) -> tuple:
    """Type, short answer, answer and items of a featured snippet."""
    if snippet is None:
        return "rich_snip", None, None, None
    bold = snippet.first("b")
    short = _unlinked(bold, bold.text()) if bold else None
    headings = snippet.all("div", role="heading")
    if headings and (span := headings[0].first("span")):
        return "feat_snip", short, _unlinked(headings[0], span.text()), None
    short = _text(bold)
    if len(headings) > 1:
        longest = max(headings, key=lambda h: len(h.text()))
        return "feat_snip", short, _unlinked(longest, longest.text()), None
    for kind, found in (("rich_list", snippet.first("ol")), ("rich_set", snippet.first("ul"))):
        if found and not (kind == "rich_list" and "role" in found.attrs):
            items = [x.text() for x in found.all("li")]
            return kind, short, "\n".join(items), items
    return "rich_snip", short, None, None


def _beside(node: Node) -> Node | None:
    """The first ``div`` of what holds a heading."""
    return node.parent.first("div") if node.parent else None


def _knowledge(doc: Node) -> tuple | None:
    header = doc.first("div", class_="kp-header")
    panel = header.first("div", class_="gsrt") if header else None
    if panel is None:
        return None
    long, span = None, None
    if (beside := header.after()) and (span := beside.first("span")):
        long = _unlinked(span, span.text() if span.text().strip() else None)
    parts = [c for c in panel.children if isinstance(c, Node) and c.tag == "div"]
    if long is None and len(parts) > 1:
        long = parts[1].text()
    return "knowledge", _text(panel.first("div")), long, None, _link(header.after()) if long is not None else None


def _marks(doc: Node, heading: Node | None) -> tuple | None:
    """What pages without a known heading may still hold."""
    if answered := doc.first("div", class_="answered-question"):
        return *_snippet(answered), _snippet_url(_beside(heading)) if heading else None
    if found := _knowledge(doc):
        return found
    block = doc.first("div", data_attrid="description")
    if block and (head := block.first("h3")) and head.text() == "Descripción":
        return "descript", None, _text(block.first("span")), None, _link(block)
    return None


def _currency(heading: Node) -> str | None:
    found = [n for n in heading.parent.walk() if n.tag in ("select", "input", "option")] if heading.parent else []
    at = next((i for i, n in enumerate(found) if n.tag == "select"), None)
    if at is None:
        return None
    value = next((i for i in range(at + 1, len(found)) if found[i].tag == "input"), None)
    if value is None:
        return None
    unit = next((n for n in found[value + 1 :] if n.tag == "option" and n.attrs.get("selected") == "1"), None)
    return f"{found[value].attrs.get('value')} {unit.text()}" if unit else None


def extract(page: str) -> tuple:
    """``answer_type, short_answer, answer, items, answer_url, expanded_search`` of a page."""
    doc = tree(page)
    heading = doc.first("h2")
    kind = heading.text().lower() if heading else None
    clause = doc.first("p")
    expanded = bool(clause and "se incluyen resultados de" in clause.text().lower())
    found: tuple = (None, None, None, None, None)
    if kind == "fragmento destacado de la web":
        found = *_snippet(_beside(heading)), _snippet_url(_beside(heading))
    elif kind == "conversor de unidades":
        found = "unit_conv", "", None, None, None
    elif kind == "conversor de divisas":
        found = "curr_conv", _currency(heading), None, None, None
    elif kind == "translation result":
        found = "tr_result", _text(heading.parent.first("pre", id="tw-target-text")), None, None, None
    elif kind in ("conversión de hora local", "hora local"):
        said = _text(heading.parent.first("div", class_="vk_bk"))
        local = kind == "hora local"
        found = "localtime" if local else "time_conv", said.strip() if said and local else said, None, None, None
    elif kind == "overview":
        found = "overview", _text(doc.first("a")), None, None, None
    elif kind == "resultado de fechas":
        head = (_beside(heading) or Node("", {}, None)).first("div", role="heading")
        inner = head.first("div") if head else None
        texts = [c.text() for c in inner.children if isinstance(c, Node) and c.tag == "div"] if inner else []
        found = "date", texts[0] if texts else None, " - ".join(texts[:2]) if len(texts) > 1 else None, None, None
    elif kind in PLAIN_TYPES:
        found = PLAIN_TYPES[kind], None, None, None, None
    elif marked := _marks(doc, heading):
        found = marked
    elif kind is None or kind in NO_ANSWER:
        found = "no_answer", None, None, None, None
    elif kind == "resultados adicionales":
        snippet = _beside(heading)
        health = snippet and any("p=medical_conditions" in a.attrs.get("href", "") for a in snippet.all("a"))
        found = "other_health" if health else "other", None, None, None, None
    return *found, expanded


def page_body(page: str) -> str | None:
    """Text of the node that holds a page's results."""
    node = tree(page).first("div", id="rcnt")
    return node.text() if node else None


@F.arrow_udf(ANSWER)
def extract_answer(pages: pa.Array) -> pa.Array:
    rows = [(None,) * 6 if p is None else extract(p) for p in pages.to_pylist()]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ANSWER.names)
