"""Relational operators over the node table of html_nodes().

pre and post number nodes on entering and leaving. Axes among neighbours are equality
joins; those up and down the tree are one pass over a document's nodes in order, which
holds the open ancestors only, so no document costs its nodes times its contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedXPath
from ..functions.text import ascii_lower
from ..select.css import Selector, parse_css

SPACE = "[ \t\n\f\r]+"


def attr(name: str, attrs: Column | str = "attrs") -> Column:
    """The first attribute of a name in any ASCII case, null without one."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.get(F.filter(attrs, lambda a: ascii_lower(a["name"]) == ascii_lower(F.lit(name))), F.lit(0))["value"]


def has_attr(name: str) -> Column:
    return F.exists("attrs", lambda a: ascii_lower(a["name"]) == ascii_lower(F.lit(name)))


def attrs_map() -> Column:
    return F.map_from_entries(F.transform("attrs", lambda a: F.struct(a["name"], a["value"])))


def attr_names() -> Column:
    return F.transform("attrs", lambda a: a["name"])


def attr_tokens(name: str) -> Column:
    """Words of an attribute; none without it."""
    return F.filter(F.split(F.coalesce(attr(name), F.lit("")), SPACE), lambda t: t != "")


def classes() -> Column:
    return attr_tokens("class")


def has_class(name: str) -> Column:
    return F.array_contains(classes(), name)


def data_attr(name: str) -> Column:
    return attr(f"data-{name}")


def aria_attr(name: str) -> Column:
    return attr(f"aria-{name}")


def is_tag(name: str) -> Column:
    return (F.col("kind") == "element") & (F.col("name") == ascii_lower(F.lit(name)))


def node_text() -> Column:
    return F.when(F.col("kind") == "text", F.col("text"))


def comment_text() -> Column:
    return F.when(F.col("kind") == "comment", F.col("text"))


def doctype() -> Column:
    return F.when(F.col("kind") == "doctype", F.struct("name", "public_id", "system_id"))


def processing_instruction() -> Column:
    return F.when(F.col("kind") == "processing_instruction", F.struct("target", F.col("text").alias("data")))


# Indexes


def by_tag(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(is_tag(name))


def by_class(nodes: DataFrame, name: str, doc: str = "page_id") -> DataFrame:
    """Elements of a class, once for each mention of it."""
    return nodes.where("kind = 'element'").withColumn("c", F.explode(classes())).where(F.col("c") == name).drop("c")


def by_id(nodes: DataFrame, value: str | Column, doc: str = "page_id") -> DataFrame:
    """The first created element of a non-empty id in each document; the id may be a column's value."""
    value = F.lit(value) if isinstance(value, str) else value
    own = nodes.where((F.col("kind") == "element") & (attr("id") == value) & (value != ""))
    return own.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("node_id"))).where("n = 1").drop("n")


def root_element(nodes: DataFrame, doc: str = "page_id") -> DataFrame:
    return nodes.where("kind = 'element' and depth = 1").withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("pre"))).where("n = 1").drop("n")


def with_siblings(nodes: DataFrame, doc: str = "page_id") -> DataFrame:
    """Adds prev_sibling and next_sibling, of any kind."""
    w = Window.partitionBy(doc, "parent_id").orderBy("sibling_ord")
    return nodes.withColumn("prev_sibling", F.lag("node_id").over(w)).withColumn("next_sibling", F.lead("node_id").over(w))


def with_ends(nodes: DataFrame, doc: str = "page_id") -> DataFrame:
    """Adds first_child and last_child."""
    ends = nodes.where("parent_id is not null").groupBy(doc, F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "sibling_ord").alias("first_child"), F.max_by("node_id", "sibling_ord").alias("last_child"))
    return nodes.join(ends, [doc, "node_id"], "left")


# Axes

_COLUMNS = ("node_id", "parent_id", "pre", "post", "sibling_ord")


def _pairs(above: DataFrame, below: DataFrame, doc: str, with_self: bool) -> DataFrame:
    """doc, up and down: ids of each node of below with those of above that it lies in.

    Both are sorted by document and place together; a document is read in one task, and only
    the nodes of above that are open at a place are held.
    """
    kind = above.schema[doc].dataType
    side = lambda df, up: df.select(F.col(doc), F.lit(up).alias("up"), "pre", "post", "node_id")
    both = side(above, 0).unionByName(side(below, 1)).repartition(F.col(doc)).sortWithinPartitions(doc, "pre", "up")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, []
        for batch in batches:
            docs, up, down = [], [], []

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(up, pa.int64()), pa.array(down, pa.int64())], [doc, "up", "down"])

            for d, below_, pre, post, node in zip(*(c.to_pylist() for c in batch.columns)):
                if d != here:
                    here, open_ = d, []
                while open_ and open_[-1][1] < post:
                    open_.pop()
                if not below_:
                    open_.append((pre, post, node))
                    continue
                for n in [n for p, _, n in open_ if with_self or p < pre]:
                    docs.append(d)
                    up.append(n)
                    down.append(node)
                if len(docs) >= 65536:
                    yield told()
                    docs, up, down = [], [], []
            yield told()

    return both.mapInArrow(run, T.StructType([T.StructField(doc, kind), T.StructField("up", T.LongType()), T.StructField("down", T.LongType())]))


def axis(nodes: DataFrame, context: DataFrame, name: str, doc: str = "page_id") -> DataFrame:
    """Nodes on an axis of each context node: context_id, and the node's columns.

    Equality joins where the axis allows one (child, parent, siblings, self), else one
    ordered pass over each document.
    """
    c = context.select(F.col(doc), *[F.col(x).alias(f"c_{x}") for x in _COLUMNS])
    n = nodes
    if name == "self":
        met = n.join(c.withColumn("node_id", F.col("c_node_id")), [doc, "node_id"])
    elif name == "child":
        met = n.join(c.withColumn("parent_id", F.col("c_node_id")), [doc, "parent_id"])
    elif name == "parent":
        met = n.join(c.withColumn("node_id", F.col("c_parent_id")), [doc, "node_id"])
    elif name in ("following-sibling", "preceding-sibling"):
        later = F.col("sibling_ord") > F.col("c_sibling_ord") if name[0] == "f" else F.col("sibling_ord") < F.col("c_sibling_ord")
        met = n.join(c.withColumn("parent_id", F.col("c_parent_id")), [doc, "parent_id"]).where(later)
    elif name in ("descendant", "descendant-or-self", "ancestor", "ancestor-or-self"):
        down = name[0] == "d"
        pairs = _pairs(context, nodes, doc, name.endswith("self")) if down else _pairs(nodes, context, doc, name.endswith("self"))
        met = n.join(pairs.select(doc, F.col("down" if down else "up").alias("node_id"), F.col("up" if down else "down").alias("c_node_id")), [doc, "node_id"])
    else:
        raise UnsupportedXPath("axis", name)
    return met.select(F.col("c_node_id").alias("context_id"), *nodes.columns)


def text_content(nodes: DataFrame, context: DataFrame, doc: str = "page_id", texts: DataFrame | None = None) -> DataFrame:
    """Text of the subtree of each context node: doc, node_id, text_content.

    texts: doc and running text of each document, as a NodeStore keeps it, else it is put
    together from the text nodes. A node's text is its range of that, so nested contexts
    cost what they tell and no pairs of nodes are made.
    """
    if texts is None:
        own = nodes.where("kind = 'text'").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pre", "text"))).alias("t"))
        texts = own.select(doc, F.array_join(F.transform("t", lambda x: x["text"]), "").alias("running"))
    else:
        texts = texts.select(doc, F.col("text").alias("running"))
    met = context.select(doc, "node_id", "text_from", "text_to").join(texts, doc, "left")
    part = F.substring("running", F.col("text_from") + 1, F.col("text_to") - F.col("text_from"))
    return met.select(doc, "node_id", F.coalesce(part, F.lit("")).alias("text_content"))


def _test(t: tuple) -> Column:
    kind = t[0]
    if kind == "type":
        return F.lit(True) if t[1] == "*" else F.when(F.col("ns") == "html", F.col("name") == t[1].lower()).otherwise(F.col("name") == t[1])
    if kind == "id":
        return attr("id") == t[1]
    if kind == "class":
        return has_class(t[1])
    if kind == "attr" and not t[4]:
        # Names of HTML elements' attributes are in lower case, others as written; without *| those of no namespace.
        name = F.when(F.col("ns") == "html", F.lit(t[1].lower())).otherwise(F.lit(t[1]))
        own = F.filter("attrs", lambda a: (a["name"] == name) & (F.lit(t[5]) | (F.coalesce(a["ns"], F.lit("")) == "")))
        value, op, wanted = F.get(own, F.lit(0))["value"], t[2], t[3]
        if not op:
            return F.size(own) > 0
        if op == "=":
            return value == wanted
        if op == "~=":
            return F.array_contains(F.split(value, SPACE), wanted) & F.lit(wanted != "")
        if op == "|=":
            return (value == wanted) | F.startswith(value, F.lit(wanted + "-"))
        return {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](value, F.lit(wanted))
    raise UnsupportedXPath("predicate", f"{t} has no relational form")


def twig(nodes: DataFrame, query: str | Selector, doc: str = "page_id") -> DataFrame:
    """doc and node_id of the elements that a selector matches: all its steps in one ordered pass over each document.

    Tests of steps are column expressions; of the nodes that pass one, only places and a mask
    of the steps go to the pass, dealt by document. It holds the open nodes of a document
    and what stood before among siblings, each with the mask of the steps that end there, so
    no pairs of nodes are made and every node is seen once, whatever the number of steps.
    """
    selector = parse_css(query) if isinstance(query, str) else query
    steps = [(k > 0 and c.combinator, k + 1 == len(alternative), c) for alternative in selector.alternatives for k, c in enumerate(alternative)]
    if len(steps) > 62:
        raise UnsupportedXPath("selector", f"{len(steps)} steps in one selector")
    tests = [reduce(Column.__and__, [F.coalesce(_test(t), F.lit(False)) for t in c.tests]) for *_, c in steps]
    mask = reduce(Column.__add__, [F.when(t, F.lit(1 << k)).otherwise(0) for k, t in enumerate(tests)]).cast("long")
    own = nodes.where("kind = 'element'").select(doc, "node_id", "parent_id", "pre", "post", "element_ord", mask.alias("mask")).where("mask > 0")
    how, last = [h for h, *_ in steps], sum(1 << k for k, (_, end, _) in enumerate(steps) if end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_, before, beside = None, [], {}, {}
        for batch in batches:
            docs, ids = [], []
            for d, node, parent, _, post, place, tested in zip(*(c.to_pylist() for c in batch.columns)):
                if d != here:
                    here, open_, before, beside = d, [], {}, {}  # open: post, id, ends here, ends here or above
                while open_ and open_[-1][0] < post:
                    open_.pop()
                top = open_[-1] if open_ else (0, None, 0, 0)
                above, over = top[3], top[2] if top[1] == parent else 0
                earlier, (at, next_) = before.get(parent, 0), beside.get(parent, (None, 0))
                ends = 0
                for k in range(tested.bit_length()):
                    if tested >> k & 1:
                        h, bit = how[k], 1 << k >> 1
                        if not h or (h == " " and above & bit) or (h == ">" and over & bit) or (h == "~" and earlier & bit) or (h == "+" and at == place - 1 and next_ & bit):
                            ends |= 1 << k
                if ends:
                    open_.append((post, node, ends, above | ends))
                    before[parent], beside[parent] = earlier | ends, (place, ends)
                    if ends & last:
                        docs.append(d)
                        ids.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(ids, pa.int32())], [doc, "node_id"])

    return own.repartition(F.col(doc)).sortWithinPartitions(doc, "pre").mapInArrow(run, T.StructType([T.StructField(doc, nodes.schema[doc].dataType), T.StructField("node_id", T.IntegerType())]))


def select(nodes: DataFrame, query: str | Selector, doc: str = "page_id") -> DataFrame:
    """Elements that a selector of types, ids, classes, attributes and combinators matches, for documents
    that are not in quirks mode: one pass for all steps (twig), and one join for the nodes' columns."""
    return nodes.join(twig(nodes, query, doc), [doc, "node_id"], "left_semi").select(*nodes.columns)
