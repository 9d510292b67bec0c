"""Merge folds against plain loops; the stored node table, selectors in one pass and texts by ranges against the tree engine."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.html.parser import parse
from pagequarry.operators import movie as M
from pagequarry.operators import nodes as N
from pagequarry.operators.extract import html_nodes
from pagequarry.operators.node_store import store_nodes
from pagequarry.select.css import find_css, parse_css

def _text(value: str | None) -> str | None:
    """How texts compare; blank ones are none."""
    value = (value or "").strip()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value) or None


def _fill(into: dict, source: dict, strings: tuple[str, ...], others: tuple[str, ...] = ()) -> None:
    for k in strings:
        if _text(into.get(k)) is None and _text(source.get(k)) is not None:
            into[k] = source[k].strip()
    for k in others:
        if into.get(k) is None:
            into[k] = source.get(k)


def merge_ratings(have: list[dict] | None, come: list[dict] | None) -> list[dict] | None:
    """Ratings of one name are one; without any so far all are taken as they are."""
    if have is None or come is None:
        return come if have is None else have
    for r in come:
        same = next((x for x in have if _text(x["@name"]) == _text(r["@name"])), None)
        if same is None:
            have.append(r)
        else:
            _fill(same, r, ("@name",), ("@max", "@default", "value", "votes"))
    return have


def merge_unique_ids(have: list[dict], come: list[dict] | None) -> list[dict]:
    for u in come or []:
        same = next((x for x in have if (_text(x["@type"]), _text(x["$text"])) == (_text(u["@type"]), _text(u["$text"]))), None)
        if same is None:
            have.append(u)
        else:
            _fill(same, u, ("@type", "$text"), ("@default",))
    return have


def merge_actors(have: list[dict], come: list[dict] | None) -> list[dict]:
    """Actors of one name and order are one, else those of one name; then all are numbered anew."""
    for a in come or []:
        named = [x for x in have if _text(x["name"]) == _text(a["name"])]
        same = next((x for x in named if x["order"] == a["order"]), named[0] if named and _text(a["name"]) is not None else None)
        if same is None:
            have.append(a)
        else:
            _fill(same, a, ("role", "gender", "name"), ("order",))
    for k, a in enumerate(have, 1):
        a["order"] = k
    return have


def _filled(t: dict) -> bool:
    return any(_text(t.get(k)) for k in ("$text", "@preview", "@aspect"))


def merge_fanart(have: list[dict] | None, come: list[dict] | None) -> list[dict] | None:
    """Thumbs with anything in them; those of one address or preview are one, and an empty place is filled."""
    come = [t for t in come or [] if _filled(t)]
    if not come or have is None:
        return come or have
    for t in come:
        value, preview, aspect = (_text(t[k]) for k in ("$text", "@preview", "@aspect"))

        def fits(x: dict, value=value, preview=preview, aspect=aspect) -> bool:
            v, p, a = (_text(x[k]) for k in ("$text", "@preview", "@aspect"))
            return (value and v == value) or (preview and p == preview) or (not v and not p and (not aspect or a == aspect)) or (not value and not preview and aspect and a == aspect)

        same = next((x for x in have if fits(x)), None)
        if same is None:
            have.append(t)
        else:
            _fill(same, t, ("@aspect", "@preview", "$text"))
    return [t for t in have if _filled(t)]



def plain(fold, start, lists):
    have = None if start is None else list(start)
    for come in lists:
        have = fold(have, [dict(x) for x in come] if come is not None else None)
        have = [dict(x) for x in have] if have is not None else None
    return have


NAMES = [None, "", " ", "Ann", "ann ", "BOB", "bob", "\u2003Eve"]
KINDS = {
    "ratings": (M.fold_ratings, merge_ratings, None, M.RATINGS, lambda r: {"@name": r.choice(NAMES), "@max": r.choice([None, 10.0]), "@default": r.choice([None, True, False]), "value": r.choice([None, 1.5, 2.0]), "votes": r.choice([None, 3])}),
    "ids": (M.fold_unique_ids, merge_unique_ids, [], M.UNIQUE_IDS, lambda r: {"@type": r.choice(NAMES[:4]), "@default": r.choice([None, True]), "$text": r.choice(NAMES)}),
    "actors": (M.fold_actors, merge_actors, [], M.ACTORS, lambda r: {"name": r.choice(NAMES), "role": r.choice([None, "", "x"]), "gender": r.choice([None, "f"]), "order": r.choice([None, 1, 2, 3])}),
    "fanart": (M.fanarts, merge_fanart, None, f"array<{M._THUMB}>", lambda r: {"@aspect": r.choice([None, "", "wide", "WIDE"]), "@preview": r.choice([None, " ", "p", "q"]), "$text": r.choice([None, "", "v", "V ", "w"])}),
}


@pytest.mark.parametrize("kind", KINDS)
def test_folds_match_plain_loops(spark, kind):
    fold, loops, start, ddl, item = KINDS[kind]
    r = random.Random(kind)
    rows = [(i, [None if r.random() < 0.15 else [item(r) for _ in range(r.randint(0, 4))] for _ in range(r.randint(0, 4))]) for i in range(400)]
    df = spark.createDataFrame(rows, f"i long, lists array<{ddl}>").repartition(3)
    out = df.select("i", fold(F.col("lists")).alias("x"))
    assert "Arrow" not in out._jdf.queryExecution().toString()
    got = {x.i: None if x.x is None else [y.asDict() for y in x.x] for x in out.collect()}
    assert got == {i: plain(loops, start, lists) for i, lists in rows}


def page(r):
    def node(depth):
        if depth > 5 or r.random() < 0.25:
            return r.choice(["text ", "&amp;", "<!--c-->", "\u00e9\U0001f642"])
        tag = r.choice(["div", "span", "section", "b"])
        attrs = "".join(r.choice(["", f' class="{r.choice("ab")} {r.choice("ab")}"', f' id="{r.choice("xy")}"', ' data-k="v"']) for _ in range(1))
        return f"<{tag}{attrs}>" + "".join(node(depth + 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    return "<!DOCTYPE html><html><body>" + "".join(node(0) for _ in range(4)) + "</body></html>"


QUERIES = ["div", "div span", "div > span", "div span > b", "div + span", "div ~ b", ".a .b", "div.a > .b ~ span", "#x b", "section > div + div span", "[data-k] *", "div, span > b", "div div div", "* + * > *", "body > * ~ * b"]


@pytest.fixture(scope="module")
def pages():
    r = random.Random(11)
    return [(i, page(r)) for i in range(60)] + [(100, None), (101, ""), (102, "<!DOCTYPE html>" + "<div>" * 200 + "deep")]


@pytest.fixture(scope="module")
def store(spark, pages):
    return store_nodes(spark.createDataFrame(pages, "page_id long, html string").repartition(4), "page_id", "html")


@pytest.mark.parametrize("query", QUERIES)
def test_one_pass_matches_the_tree(store, pages, query):
    got = sorted(tuple(x) for x in N.twig(store.nodes, query).collect())
    assert got == sorted((i, n) for i, html in pages if html is not None for n in find_css(parse(html), parse_css(query), None))


def test_texts_by_ranges(store, pages):
    elements = store.nodes.where("kind in ('element', 'document')")
    want = {(i, n): t.text_content(n) for i, html in pages if html is not None for t in [parse(html)] for n in range(len(t.kind)) if t.kind[n] in ("element", "document")}
    got = {(x.page_id, x.node_id): x.text_content for x in store.text_content(elements).collect()}
    assert got == {k: want[k] for k in got} and len(got) == elements.count()
    put_together = {(x.page_id, x.node_id): x.text_content for x in N.text_content(store.nodes, elements).collect()}
    assert put_together == got


def test_store_reads_by_tag_and_class_without_parsing(spark, store, pages):
    lazy = html_nodes(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html")
    rows = lambda df: sorted(tuple(x) for x in df.select("page_id", "node_id").collect())
    assert rows(store.by_tag("DIV", "b")) == rows(lazy.where("kind = 'element' and name in ('div', 'b')"))
    assert rows(store.by_class("a")) == rows(N.by_class(lazy, "a"))
    assert rows(N.by_id(store.nodes, "x")) == rows(N.by_id(lazy, "x"))
    plan = N.twig(store.by_tag("div", "span"), "div > span")._jdf.queryExecution().toString()
    assert "In(name, [div,span])" in plan and "arrow_udf" not in plan and "text:string" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_attributes_in_any_case(spark):
    nodes = html_nodes(spark.createDataFrame([(1, "<!DOCTYPE html><svg viewBox='0 0 1 1'></svg>")], "page_id long, html string"), "page_id", "html").where("name = 'svg'")
    assert nodes.select(N.attr("VIEWBOX"), N.has_attr("viewBox")).first()[:] == ("0 0 1 1", True)


def test_empty_store(spark):
    store = store_nodes(spark.createDataFrame([(1, None)], "page_id long, html string"), "page_id", "html")
    assert (store.nodes.count(), store.by_class("a").count(), store.texts.count(), N.twig(store.nodes, "div p").count()) == (0, 0, 0, 0)
    store.discard()
