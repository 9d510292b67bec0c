"""Selection and extraction from HTML columns: one parse and one pass for all fields."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedXPath
from ..html.parser import parse, parse_checked
from ..html.serialize import inner_html, outer_html
from ..html.tree import Tree, ascii_lower, tokens
from ..select.css import Selector, find_css, parse_css
from ..select.xpath import XPath, find_xpath, parse_xpath
from ..sources.tables import dealt

NODE = (
    "struct<node_id:int,parent_id:int,sibling_ord:int,pre:int,post:int,depth:int,kind:string,name:string,ns:string,"
    "attrs:array<struct<name:string,ns:string,value:string>>,text:string,target:string,public_id:string,system_id:string,"
    "element_ord:int,text_from:int,text_to:int,running:string>"
)
SLICE_PAGES = 128  # that are held as nodes at once
SLICE_NODES = 8192  # of a batch of the node table, a document more at most
PARSED = f"struct<nodes:array<{NODE}>,errors:array<string>,quirks:string>"


@dataclass(frozen=True)
class Spec:
    """What to select and what to take of each node. Made by css() or xpath(), refined by the methods."""

    query: Selector | XPath
    take: tuple = ("text",)
    one: bool = False
    scope: Spec | None = None

    def text(self) -> Spec:
        return replace(self, take=("text",))

    def attr(self, name: str) -> Spec:
        """The attribute's value; nodes without it give null."""
        return replace(self, take=("attr", ascii_lower(name)))

    def html(self) -> Spec:
        return replace(self, take=("html",))

    def outer_html(self) -> Spec:
        return replace(self, take=("outer",))

    def tag(self) -> Spec:
        return replace(self, take=("tag",))

    def classes(self) -> Spec:
        """The class words, joined by spaces."""
        return replace(self, take=("classes",))

    def node_id(self) -> Spec:
        return replace(self, take=("id",))

    def within(self, scope: Spec) -> Spec:
        """Selects from each node that the scope selects; results of several keep their first place."""
        return replace(self, scope=scope)

    def all(self) -> Spec:
        return replace(self, one=False)

    def first(self) -> Spec:
        return replace(self, one=True)

    def nodes(self, tree: Tree) -> list[int]:
        starts = [None] if self.scope is None else self.scope.nodes(tree)
        find = find_css if isinstance(self.query, Selector) else find_xpath
        return list(dict.fromkeys(n for s in starts for n in find(tree, self.query, s)))

    def of(self, tree: Tree, node: int) -> str | None:
        how = self.take[0]
        if how == "text":
            return tree.text_content(node) if tree.kind[node] in ("element", "document") else tree.text[node]
        if how == "attr":
            return tree.attr(node, self.take[1])
        if how == "html":
            return inner_html(tree, node)
        if how == "outer":
            return outer_html(tree, node)
        if how == "tag":
            return tree.name[node]
        if how == "classes":
            return " ".join(tokens(tree.attr(node, "class") or ""))
        return str(node)

    def run(self, tree: Tree):
        found = self.nodes(tree)
        return (self.of(tree, found[0]) if found else None) if self.one else [self.of(tree, n) for n in found]


def css(query: str) -> Spec:
    """A CSS selection; a query that does not parse raises here, on the driver."""
    return Spec(parse_css(query))


def xpath(query: str) -> Spec:
    """An XPath selection; what is not supported raises here, on the driver."""
    return Spec(parse_xpath(query))


def extract(html: Column, fields: dict[str, Spec], checked: bool = False) -> Column:
    """A struct with a string for each first() field and an array of strings for each other.

    Each document is parsed once for all fields, in Arrow batches. A null document gives
    null. checked raises for documents with parse errors.
    """
    kind = T.StructType([T.StructField(n, T.StringType() if s.one else T.ArrayType(T.StringType())) for n, s in fields.items()])
    arrow = pa.struct([(n, pa.string() if s.one else pa.list_(pa.string())) for n, s in fields.items()])

    @F.arrow_udf(kind)
    def run(pages: pa.Array) -> pa.Array:
        read = parse_checked if checked else parse
        out = []
        for page in pages.to_pylist():
            tree = None if page is None else read(page)
            out.append(None if tree is None else {n: s.run(tree) for n, s in fields.items()})
        return pa.array(out, arrow)

    return run(html)


def _told(query: Column, how) -> Column:
    """What how() gives for each query text; null for null."""

    @F.arrow_udf("string")
    def run(queries: pa.Array) -> pa.Array:
        return pa.array([None if q is None else how(q) for q in queries.to_pylist()], pa.string())

    return run(query)


def _error(parsed, q: str) -> str | None:
    try:
        parsed(q)
    except QueryError as e:
        return e.kind
    except UnsupportedXPath as e:
        return f"unsupported {e.feature}: {e.detail}"
    return None


def css_error(query: Column) -> Column:
    """Why a selector does not parse, null if it does."""
    return _told(query, lambda q: _error(parse_css, q))


def xpath_error(query: Column) -> Column:
    """Why a path does not parse or is outside what is evaluated, null if neither."""
    return _told(query, lambda q: _error(parse_xpath, q))


def css_text(query: Column) -> Column:
    """Selectors in one spelling; null for those that do not parse."""
    return _told(query, lambda q: None if _error(parse_css, q) else parse_css(q).to_css())


def node_rows(tree: Tree) -> list[dict]:
    """Rows of the nodes that the document holds, in document order; pre and post number them for ranges,
    element_ord counts the elements among siblings, and text_from and text_to are what of the running text lies below."""
    out: list[dict] = []
    at: dict[int, int] = {}
    stack: list[tuple[int, int, int, bool]] = [(0, 0, 0, False)]
    post = chars = 0
    elements: dict[int | None, int] = {}
    while stack:
        node, order, depth, done = stack.pop()
        if done:
            out[at[node]].update(post=post, text_to=chars)
            post += 1
            continue
        if tree.kind[node] == "element":
            elements[tree.parent[node]] = elements.get(tree.parent[node], -1) + 1
        kind, ids = tree.kind[node], tree.ids[node] or (None, None)
        at[node] = len(out)
        out.append(
            {
                "node_id": node, "parent_id": tree.parent[node], "sibling_ord": order, "pre": len(out), "post": 0, "depth": depth, "kind": kind,
                "name": None if kind == "processing_instruction" else tree.name[node], "ns": tree.ns[node],
                "attrs": [{"name": n, "ns": ns, "value": v} for n, ns, v in tree.attrs[node]], "text": tree.text[node],
                "target": tree.name[node] if kind == "processing_instruction" else None, "public_id": ids[0], "system_id": ids[1],
                "element_ord": elements[tree.parent[node]] if kind == "element" else None, "text_from": chars, "text_to": chars, "running": None,
            }
        )
        if kind == "text":
            chars += len(tree.text[node])
        stack.append((node, order, depth, True))
        own = tree.children[node]
        stack += [(own[k], k, depth + 1, False) for k in range(len(own) - 1, -1, -1)]
    return out


def html_parse(html: Column, checked: bool = False) -> Column:
    """struct(nodes, errors, quirks) of each document; null for null. running, of the document's node, is all its text nodes in order. checked raises if there are errors."""
    arrow = _arrow(PARSED)

    @F.arrow_udf(PARSED)
    def run(pages: pa.Array) -> pa.Array:
        read = parse_checked if checked else parse

        def told(part: pa.Array) -> pa.Array:
            return pa.array([None if p is None else _parsed(read(p)) for p in part.to_pylist()], arrow)

        # Rows of nodes as Python values take many times their size in Arrow, so a batch is told in parts.
        parts = [told(pages.slice(k, SLICE_PAGES)) for k in range(0, len(pages), SLICE_PAGES)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return run(html)


def _parsed(tree: Tree) -> dict:
    nodes = node_rows(tree)
    nodes[0]["running"] = "".join(n["text"] for n in nodes if n["kind"] == "text")
    return {"nodes": nodes, "errors": tree.errors, "quirks": tree.quirks}


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.DataType.fromDDL(ddl))


class _Nodes:
    """Columns of NODE for the nodes of several documents, as node_rows() tells them."""

    def __init__(self):
        self.pages: list[int] = []
        self.cols: dict[str, list] = {n: [] for n in ("node_id", "parent_id", "sibling_ord", "pre", "post", "depth", "kind", "name", "ns", "text", "target", "public_id", "system_id", "element_ord", "text_from", "text_to", "running")}
        self.offsets, self.attrs = [0], ([], [], [])

    def add(self, page: int, tree: Tree) -> None:
        c, base = self.cols, len(self.pages)
        names, spaces, values = self.attrs
        post, text_to, pre = c["post"], c["text_to"], 0
        out = [c[n].append for n in c]
        stack: list[tuple[int, int, int, bool]] = [(0, 0, 0, False)]
        left = chars = 0
        elements: dict[int | None, int] = {}
        texts: list[str] = []
        while stack:
            node, order, depth, done = stack.pop()
            if done:  # node is its place here
                post[node], text_to[node] = left, chars
                left += 1
                continue
            kind, parent, ids, at = tree.kind[node], tree.parent[node], tree.ids[node] or (None, None), None
            if kind == "element":
                at = elements[parent] = elements.get(parent, -1) + 1
            instruction, text = kind == "processing_instruction", tree.text[node]
            row = (node, parent, order, pre, 0, depth, kind, None if instruction else tree.name[node], tree.ns[node], text, tree.name[node] if instruction else None, *ids, at, chars, chars, None)
            for put, value in zip(out, row):
                put(value)
            for n, ns, v in tree.attrs[node]:
                names.append(n)
                spaces.append(ns)
                values.append(v)
            self.offsets.append(len(names))
            self.pages.append(page)
            if kind == "text":
                texts.append(text)
                chars += len(text)
            own = tree.children[node]
            if own:
                stack.append((base + pre, 0, 0, True))
                stack += [(own[k], k, depth + 1, False) for k in range(len(own) - 1, -1, -1)]
            else:
                post[base + pre], text_to[base + pre] = left, chars
                left += 1
            pre += 1
        c["running"][base] = "".join(texts)

    def batch(self, ids: pa.Array, id_name: str, kind: pa.StructType) -> pa.RecordBatch:
        own = kind.field("attrs").type
        attrs = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in self.attrs], fields=list(own.value_type))
        lists = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), attrs, type=own)
        cols = [lists if f.name == "attrs" else pa.array(self.cols[f.name], f.type) for f in kind]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(self.pages, pa.int64())), *cols], [id_name, *[f.name for f in kind]])


def node_batches(batches: Iterator[pa.RecordBatch], kind: pa.StructType) -> Iterator[pa.RecordBatch]:
    """The node table of batches of an id and a page, in batches of SLICE_NODES and the rest of a document at most."""
    for batch in batches:
        held = _Nodes()
        for k, page in enumerate(batch.column(1)):
            if page.is_valid:
                held.add(k, parse(page.as_py()))
            if len(held.pages) >= SLICE_NODES:
                yield held.batch(batch.column(0), batch.schema.names[0], kind)
                held = _Nodes()
        if held.pages:
            yield held.batch(batch.column(0), batch.schema.names[0], kind)


def html_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The node table: the id and the fields of NODE for every node of every page; null pages have none.

    Pages are dealt to all cores, and a task holds few documents' nodes at a time, however many pages it has (node_batches)."""
    kind = _arrow(NODE)
    pages = pages.select(id_col, html_col)
    return dealt(pages).mapInArrow(lambda batches: node_batches(batches, kind), T.StructType([pages.schema[id_col], *T.DataType.fromDDL(NODE).fields]))
