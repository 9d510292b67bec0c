"""Queries over pages and records that are made of the given tables, so that SQL knows what they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import image_action
from .operators import nodes as N
from .operators.node_store import store_nodes
from .operators.extract import css, css_error, css_text, extract, html_nodes, html_parse, xpath, xpath_error
from .operators.images import name_images
from .operators.mapping import Mapper, map_movies
from .operators.movie import fanarts, merge_sources, movie
from .operators.parts import group_video_inputs
from .operators.subtitles import is_noise, is_year, match_subtitles, tokens
from .operators.template import output_paths
from .operators.translate import translate_movies
from .plans.output import conflicts, targets, without_present
from .queries import _FILES, _files, _subtitles, _t, query
from .sources.files import depth_under
from .sources.registry import Source, run_sources
from .sources.tables import dealt
from .streaming.watch import relevant, shared_folder, watch

# A page for each part; every part of it is known to SQL by construction.

_N = "(p_partkey % 4 + 1)"


def _cards(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    items = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")), lambda i: F.concat(F.lit('<li n="'), i.cast("string"), F.lit('">v'), i.cast("string"), F.lit("</li>"))), "")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), "p_name", F.lit('</title></head><body id="b'), k, F.lit('"><div id="d'), k, F.lit('" class="card  '), "p_type", F.lit(' big" data-size="'), F.col("p_size").cast("string"),
        F.lit('" aria-label="'), "p_brand", F.lit('"><h2>A &amp; &lt;'), "p_name", F.lit("></h2>text<!--c"), k, F.lit("--><ul>"), items, F.lit('</ul><p>one</p><p title="a &quot;b&quot;">two</p><br></div></body></html>'),
    )
    part = _t(spark, sf_dir, "part")
    return (dealt(part) if deal else part).select("p_partkey", html.alias("html"))


def _counted(spark: SparkSession, sf_dir: str, fields: dict) -> DataFrame:
    x = _cards(spark, sf_dir, True).select("p_partkey", extract(F.col("html"), {n: s.node_id() for n, s in fields.items()}).alias("x"))
    return x.select("p_partkey", *[F.size(F.col(f"x.{n}")).cast("long").alias(n) for n in fields])


@query(
    f"""SELECT p_partkey, 4 AS following, 4 AS preceding, 4 AS ancestors, 5 AS ancestors_self, 1 AS parents, {_N} AS self, {_N} + 5 AS descendants, {_N} + 6 AS descendants_self, 7 AS children, 2 AS commas, {_N} AS scoped FROM part"""
)
def xpath_axes(spark, sf_dir):
    fields = {
        "following": "//h2/following-sibling::*", "preceding": "//br/preceding-sibling::*", "ancestors": "//li[1]/ancestor::*", "ancestors_self": "//li[1]/ancestor-or-self::*", "parents": "//li/parent::*", "self": "//li/self::li",
        "descendants": "//div/descendant::*", "descendants_self": "//div/descendant-or-self::*", "children": "//div/child::node()",
    }
    return _counted(spark, sf_dir, {n: xpath(q) for n, q in fields.items()} | {"commas": css("h2 ~ p"), "scoped": css(":scope > li").within(css("ul"))})


@query(
    f"""SELECT p_partkey, greatest({_N} - 2, 0) AS above, greatest(least({_N}, 3) - 1, 0) AS between_, 1 + CAST({_N} >= 4 AS BIGINT) AS either, 1 + CAST({_N} >= 3 AS BIGINT) AS grouped,
    {_N} - CAST({_N} >= 2 AS BIGINT) AS other, CAST(p_size > 25 AS BIGINT) AS large, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS promo FROM part"""
)
def xpath_compare(spark, sf_dir):
    fields = {
        "above": "//li[@n > 2]", "between_": "//li[@n >= 2 and @n < 4]", "either": "//li[@n lt 2 or @n ge 4]", "grouped": "//li[(@n = '1' or @n eq '3') and @n <= 3]", "other": "//li[@n ne '2']", "large": "//div[@data-size gt 25]",
        "promo": "//div[contains(@class, 'PROMO')]",
    }
    return _counted(spark, sf_dir, {n: xpath(q) for n, q in fields.items()})


@query("SELECT p_partkey, 'two' AS nearest, 'v1' AS first, 'text' AS kind_text, 'ul' AS tag, 'card ' || p_type || ' big' AS classes, 'c' || p_partkey AS comment FROM part")
def xpath_nearest(spark, sf_dir):
    fields = {
        "nearest": xpath("//br/preceding-sibling::*[1]").text().first(), "first": xpath("//ul/li[1]").text().first(), "kind_text": xpath("//div/text()").text().first(), "tag": xpath("//li/parent::*").tag().first(), "classes": css("div").classes().first(),
        "comment": xpath("//div/comment()").text().first(),
    }
    return _cards(spark, sf_dir, True).select("p_partkey", extract(F.col("html"), fields).alias("x")).select("p_partkey", "x.*")


@query(
    """SELECT n_nationkey, a AS axis, CASE WHEN a IN ('following', 'preceding', 'attribute', 'namespace') THEN 'unsupported axis: ' || a WHEN a = 'sideways' THEN 'unknown axis' END AS error
    FROM nation, (VALUES ('following'), ('preceding'), ('attribute'), ('namespace'), ('child'), ('ancestor'), ('sideways')) v(a)"""
)
def xpath_refused(spark, sf_dir):
    axes = F.explode(F.array(*map(F.lit, ("following", "preceding", "attribute", "namespace", "child", "ancestor", "sideways")))).alias("axis")
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", axes)
    return rows.select("n_nationkey", "axis", xpath_error(F.concat(F.lit("//div/"), "axis", F.lit("::"), "n_name")).alias("error"))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'div > a.' || n_name WHEN 1 THEN '#' || n_name || ':nth-child(2n+1)' WHEN 2 THEN '[data-k^="' || n_name || '"] ~ *' END AS shown,
    CASE n_nationkey % 5 WHEN 3 THEN 'unsupported pseudo-class' WHEN 4 THEN 'unsupported pseudo-element' END AS error FROM nation"""
)
def css_spelling(spark, sf_dir):
    k, name = F.col("n_nationkey") % 5, F.col("n_name")
    q = F.when(k == 0, F.concat(F.lit("div>a."), name)).when(k == 1, F.concat(F.lit("#"), name, F.lit(":nth-child( odd )"))).when(k == 2, F.concat(F.lit("[ data-k ^= '"), name, F.lit("']~*")))
    q = q.when(k == 3, F.concat(name, F.lit(":hover"))).otherwise(F.concat(name, F.lit("::before")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", css_text(q).alias("shown"), css_error(q).alias("error"))


_ITEMS = "(SELECT string_agg('<li n=\"' || i || '\">v' || i || '</li>', '' ORDER BY i) FROM range(1, p_partkey % 4 + 2) r(i))"


@query(
    f"""SELECT p_partkey, 'A &amp; &lt;' || p_name || '&gt;' AS inner_, '<ul>' || {_ITEMS} || '</ul>' AS outer_, 'A & <' || p_name || '>' AS text, '<p title="a &quot;b&quot;">two</p>' AS quoted, '<br>' AS void_ FROM part"""
)
def serialised(spark, sf_dir):
    fields = {"inner_": css("h2").html().first(), "outer_": css("ul").outer_html().first(), "text": css("h2").text().first(), "quoted": css("p[title]").outer_html().first(), "void_": css("br").outer_html().first()}
    return _cards(spark, sf_dir, True).select("p_partkey", extract(F.col("html"), fields).alias("x")).select("p_partkey", "x.*")


@query(
    """SELECT p_partkey, 'd' || p_partkey AS id, 'card  ' || p_type || ' big' AS class_value, 'card|' || p_type || '|big' AS classes, true AS has_big, false AS has_bi, CAST(p_size AS VARCHAR) AS size, p_brand AS label,
    'id,class,data-size,aria-label' AS names, 4 AS n_attrs, true AS has_id, false AS has_title FROM part"""
)
def node_attributes(spark, sf_dir):
    div = N.by_tag(html_nodes(_cards(spark, sf_dir), "p_partkey", "html"), "DIV")
    return div.select(
        "p_partkey", N.attr("ID").alias("id"), N.attr("class").alias("class_value"), F.array_join(N.classes(), "|").alias("classes"), N.has_class("big").alias("has_big"), N.has_class("bi").alias("has_bi"), N.data_attr("size").alias("size"), N.aria_attr("label").alias("label"),
        F.array_join(N.attr_names(), ",").alias("names"), F.size(N.attrs_map()).cast("long").alias("n_attrs"), N.has_attr("id").alias("has_id"), N.has_attr("title").alias("has_title"),
    )


@query(
    f"""SELECT p_partkey, 'comment' AS before, 'p' AS after, 'v1' AS first_text, 'v' || {_N} AS last_text, 'div' AS parent, 2 * {_N} AS below, 'html' AS root, 'document' AS top FROM part"""
)
def node_neighbours(spark, sf_dir):
    store = store_nodes(_cards(spark, sf_dir), "p_partkey", "html")
    nodes = store.nodes
    ul = N.by_tag(nodes, "ul").select("p_partkey", F.col("node_id").alias("ul"))
    near = N.with_ends(N.with_siblings(nodes, "p_partkey"), "p_partkey")
    own = near.join(ul, (near["p_partkey"] == ul["p_partkey"]) & (near["node_id"] == ul["ul"]), "left_semi")
    named = lambda c, by, value: nodes.select("p_partkey", F.col("node_id").alias(by), value.alias(c))
    told = store.text_content(store.by_tag("li")).select("p_partkey", "node_id", "text_content")
    side = lambda by, c: told.select("p_partkey", F.col("node_id").alias(by), F.col("text_content").alias(c))
    below = N.axis(nodes, N.by_tag(nodes, "ul"), "descendant", "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("below"))
    root = N.root_element(nodes, "p_partkey").select("p_partkey", F.col("name").alias("root"))
    top = nodes.where("depth = 0").select("p_partkey", F.col("kind").alias("top"))
    out = own.select("p_partkey", "prev_sibling", "next_sibling", "first_child", "last_child", "parent_id")
    out = out.join(named("before", "prev_sibling", F.coalesce("name", "kind")), ["p_partkey", "prev_sibling"]).join(named("after", "next_sibling", F.col("name")), ["p_partkey", "next_sibling"])
    out = out.join(side("first_child", "first_text"), ["p_partkey", "first_child"]).join(side("last_child", "last_text"), ["p_partkey", "last_child"]).join(named("parent", "parent_id", F.col("name")), ["p_partkey", "parent_id"])
    return out.join(below, "p_partkey").join(root, "p_partkey").join(top, "p_partkey").select("p_partkey", "before", "after", "first_text", "last_text", "parent", "below", "root", "top")


@query(f"SELECT p_partkey, {_N} + 4 AS ancestors, {_N} + 5 AS descendants, {_N} AS siblings, 2 AS texts FROM part")
def node_axes(spark, sf_dir):
    """The axes as joins and ordered passes over the node table."""
    nodes = store_nodes(_cards(spark, sf_dir), "p_partkey", "html").nodes
    n = lambda df, c: df.groupBy("p_partkey").agg(F.count("*").alias(c))
    elements, li = nodes.where("kind = 'element'"), N.by_tag(nodes, "li")
    up = N.axis(elements, li, "ancestor-or-self", "p_partkey").select("p_partkey", "node_id").distinct()  # li, ul, div, body, html
    down = N.axis(elements, N.by_tag(nodes, "div"), "descendant", "p_partkey")
    beside = N.axis(li, N.by_tag(nodes, "ul"), "child", "p_partkey")
    return n(up, "ancestors").join(n(down, "descendants"), "p_partkey").join(n(beside, "siblings"), "p_partkey").join(n(N.select(nodes, "div > ul ~ p", "p_partkey"), "texts"), "p_partkey")


@query("""SELECT p_partkey, 'div' AS by_id, CASE WHEN p_type = 'PROMO' THEN 2 ELSE 1 END AS mentions, 2 AS paragraphs FROM part""")
def node_indexes(spark, sf_dir):
    cards = _cards(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<br>"), F.lit('<i class="PROMO"></i><b id=""></b>')))
    store = store_nodes(cards, "p_partkey", "html")
    nodes = store.nodes
    first = N.by_id(nodes, F.concat(F.lit("d"), F.col("p_partkey").cast("string")), "p_partkey").select("p_partkey", F.col("name").alias("by_id"))
    mentions = store.by_class("PROMO").groupBy("p_partkey").agg(F.count("*").alias("mentions"))
    return first.join(mentions, "p_partkey").join(N.by_tag(nodes, "p").groupBy("p_partkey").agg(F.count("*").alias("paragraphs")), "p_partkey")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'no-quirks' WHEN 3 THEN 'limited-quirks' ELSE 'quirks' END AS quirks, p_partkey % 4 = 1 AS wrong, 1 AS paragraphs, 'x' AS seen FROM part"""
)
def parse_modes(spark, sf_dir):
    """Doctypes of four kinds; what a template holds is no one's child."""
    strict = "-//W3C//DTD HTML 3.2//EN"
    types = F.when(F.col("p_partkey") % 4 == 0, "<!DOCTYPE html>").when(F.col("p_partkey") % 4 == 1, "").when(F.col("p_partkey") % 4 == 2, f'<!DOCTYPE HTML PUBLIC "{strict}">')
    types = types.otherwise('<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN" "http://www.w3.org/TR/html4/loose.dtd">')
    pages = dealt(_t(spark, sf_dir, "part")).select("p_partkey", F.concat(types, F.lit("<html><body><template><p>"), "p_name", F.lit("</p></template><p>x</p></body></html>")).alias("html"))
    both = pages.select("p_partkey", html_parse(F.col("html")).alias("t"), extract(F.col("html"), {"p": css("p").text().all()})["p"].alias("p"))
    # A public doctype is itself told as wrong by the standard, but not by all parsers; a missing one is by all.
    missing = F.exists("t.errors", lambda e: F.contains(e, F.lit("doctype"))) & (F.col("p_partkey") % 4 == 1)
    return both.select("p_partkey", "t.quirks", missing.alias("wrong"), F.size("p").cast("long").alias("paragraphs"), F.get("p", F.lit(0)).alias("seen"))


# Records


def _pair(spark: SparkSession, sf_dir: str, a, b) -> DataFrame:
    """Two sources of each part."""
    rows = F.array(*[F.struct(F.lit(i).alias("source_ord"), F.lit(n).alias("alias"), m.alias("movie")) for i, (n, m) in enumerate((("a", a), ("b", b)))])
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.explode(rows).alias("s")).select("entity_id", "s.*")


def _struct(*values):
    return F.struct(*[v if not (v is None or isinstance(v, (str, int, float, bool))) else F.lit(v) for v in values])


@query(
    """SELECT p_partkey AS entity_id, 'x:' || p_size || ':5|y:2:null' AS ratings, 'db:true:' || p_partkey || '|other:null:z' AS ids, 'https://f/' || p_partkey || '>null' AS fanart,
    p_brand AS set_name, 'o' AS set_overview FROM part"""
)
def merge_folds(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    empty = F.lit(None).cast("string")
    a = movie(
        title=F.lit("t"), ratings=F.struct(F.array(_struct("x", None, None, F.col("p_size"), None)).cast("array<struct<n:string,m:float,d:boolean,v:float,c:bigint>>")), uniqueid=F.array(_struct("db", F.lit(None).cast("boolean"), k)),
        fanart=F.struct(F.array(_struct(empty, empty, F.concat(F.lit("https://f/"), k)))), set=F.struct(F.col("p_brand"), empty),
    )
    b = movie(
        ratings=F.struct(F.array(_struct(" X ", F.lit(None).cast("float"), F.lit(None).cast("boolean"), F.lit(1.0), F.lit(5)), _struct("y", F.lit(None).cast("float"), F.lit(None).cast("boolean"), F.lit(2.0), F.lit(None).cast("int")))),
        uniqueid=F.array(_struct(" DB", True, F.concat(F.lit(" "), k, F.lit(" "))), _struct("other", F.lit(None).cast("boolean"), "z")),
        fanart=F.struct(F.array(_struct(F.lit("a"), F.concat(F.lit("https://p/"), k), empty), _struct(empty, F.lit("https://q"), F.concat(F.lit(" https://F/"), k)), _struct(empty, F.lit(" "), empty))), set=F.struct(F.lit("no"), F.lit("o")),
    )
    told = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    join = lambda c, f: F.array_join(F.transform(c, f), "|")
    m = "movie"
    return merge_sources(_pair(spark, sf_dir, a, b)).select(
        "entity_id", join(F.col(f"{m}.ratings.rating"), lambda r: F.concat(r["@name"], F.lit(":"), told(r["value"].cast("int")), F.lit(":"), told(r["votes"]))).alias("ratings"),
        join(F.col(f"{m}.uniqueid"), lambda u: F.concat(u["@type"], F.lit(":"), told(u["@default"]), F.lit(":"), u["$text"])).alias("ids"),
        join(F.col(f"{m}.fanart.thumb"), lambda t: F.concat(told(t["$text"]), F.lit(">"), told(t["@preview"]))).alias("fanart"), F.col(f"{m}.set.name").alias("set_name"), F.col(f"{m}.set.overview").alias("set_overview"),
    )


@query("SELECT p_partkey, 'https://f/' || p_partkey || '>https://q|null>https://p/' || p_partkey AS fanart FROM part")
def fanart_fold(spark, sf_dir):
    """Thumbs of two lists: one address is one thumb, whose empty fields are filled; blank ones go."""
    k, empty = F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    thumb = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("@aspect", "@preview", "$text"), v)])
    first = F.array(thumb(empty, empty, F.concat(F.lit("https://f/"), k)))
    second = F.array(thumb(F.lit("a"), F.concat(F.lit("https://p/"), k), empty), thumb(empty, F.lit("https://q"), F.concat(F.lit(" HTTPS://F/"), k)), thumb(empty, F.lit(" "), empty))
    told = lambda c: F.coalesce(c, F.lit("null"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(fanarts(F.array(first, second)), lambda t: F.concat(told(t["$text"]), F.lit(">"), told(t["@preview"]))), "|").alias("fanart"))


def _actors(*rows):
    named = lambda r: [(x if not (x is None or isinstance(x, str)) else F.lit(x).cast("string")).alias(n) for n, x in zip(("name", "role", "gender"), r)]
    return F.array(*[F.struct(*named(r), F.lit(i).cast("long").alias("order")) for i, r in enumerate(rows, 1)])


@query(
    """SELECT p_partkey, '1:Bob:Hero:m|2:' || p_brand || ':null:null|3:null:Hero:null|4:null:x:null' AS actors, 'a|b' AS untouched FROM part"""
)
def actor_mapping(spark, sf_dir):
    rules = "node,to,from\nactor,Bob,bobby,robert\nactor.role,Hero,lead\nactor.gender,m,male\n"
    record = movie(title=F.lit("t"), tag=F.array(F.lit("a"), F.lit("b")), actor=_actors(("Bobby", "lead", None), (F.col("p_brand"), None, None), (" ROBERT ", "other", "male"), (None, "LEAD", None), (" ", "x", None)))
    mapped = dealt(_t(spark, sf_dir, "part")).select("p_partkey", map_movies(record, Mapper([rules])).alias("m"), map_movies(record, Mapper([])).alias("same"))
    told = lambda c: F.coalesce(c, F.lit("null"))
    shown = F.transform("m.actor", lambda a: F.concat_ws(":", a["order"].cast("string"), told(a["name"]), told(a["role"]), told(a["gender"])))
    return mapped.select("p_partkey", F.array_join(shown, "|").alias("actors"), F.array_join("same.tag", "|").alias("untouched"))


@query(
    """SELECT p_partkey, 'both' AS template, unnest([0, 1]) AS ord, unnest(['Ann - ' || p_name, 'Cy - ' || p_name]) AS path FROM part
    UNION ALL SELECT p_partkey, 'one', 0, 'Ann - ' || p_name || '/f' FROM part"""
)
def actor_template(spark, sf_dir):
    """An actor who passes all filters stands for all actor fields of a path."""
    record = movie(title=F.col("p_name"), actor=_actors(("Ann", "lead", "f"), ("Bob", None, "m"), ("Cy", "x", "F")))
    both, one = (output_paths(t, record, F.lit("none")) for t in ("{actor.name[gender='f']} - {title}", "{actor.name[gender='f']} - {title}/{actor.gender[name=ann]}"))
    part = dealt(_t(spark, sf_dir, "part"))
    return part.select("p_partkey", F.lit("both").alias("template"), F.posexplode_outer(both).alias("ord", "path")).unionByName(part.select("p_partkey", F.lit("one").alias("template"), F.posexplode_outer(one).alias("ord", "path")))


@query(
    f"""WITH {_FILES}, h AS (SELECT DISTINCT k, stem, dir, parts, min(path) OVER (PARTITION BY k) AS group_id, (min(n) OVER (PARTITION BY k)) = 0 AS plain FROM g),
s AS (SELECT *, unnest([1, 2, 3]) AS i FROM h),
m AS (SELECT *, stem || CASE i WHEN 1 THEN '.zh.srt' WHEN 2 THEN '.en-us.forced.ass' ELSE '-CD1.ger.srt' END AS name,
  CASE WHEN i = 3 AND plain THEN '.CD1.ger' WHEN i = 3 THEN CASE WHEN parts > 1 THEN '.part01' ELSE '' END || '.de' WHEN NOT plain AND parts = 1 THEN '' WHEN i = 1 THEN '.zh-CN' ELSE '.en-US.forced' END AS base FROM s WHERE plain OR parts > 1 OR i = 3)
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN parts > 1 AND i < 3 THEN '1:' ELSE '0:' END || lower(name)) - 1 AS ord, dir || name AS source, 'T/' || stem || base || CASE i WHEN 2 THEN '.ass' ELSE '.srt' END AS target FROM m"""
)
def subtitle_targets(spark, sf_dir):
    files = _files(spark, sf_dir)
    groups = group_video_inputs(files)
    places = groups.select("group_id", F.lit(0).alias("output_ord"), F.lit("T").alias("dir"), F.regexp_replace("input_stem", "-CD1$", "").alias("file_base"))
    found = targets(places, groups, match_subtitles(groups, files.unionByName(_subtitles(spark, sf_dir))))
    return found.where("kind = 'subtitle'").select("group_id", F.col("ord").cast("long").alias("ord"), "source", "target")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step for each part: every tenth shares its target with the next but nine, every seventh's source is its target."""
    k = F.col("p_partkey")
    target = F.concat(F.lit("t/"), F.when(k % 10 == 9, k - 9).otherwise(k).cast("string"))
    return _t(spark, sf_dir, "part").select(k.cast("string").alias("group_id"), F.lit(0).cast("long").alias("step"), F.when(k % 3 == 0, "fetch").otherwise("move").alias("action"), F.when(k % 7 == 0, target).otherwise(F.concat(F.lit("s/"), k.cast("string"))).alias("source"), target.alias("target"))


_MOVES = """m AS (SELECT CAST(p_partkey AS VARCHAR) AS group_id, p_partkey AS k, 't/' || CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 9 ELSE p_partkey END AS target, CASE WHEN p_partkey % 3 = 0 THEN 'fetch' ELSE 'move' END AS action FROM part)"""


@query(
    f"""WITH {_MOVES}, r AS (SELECT * FROM m WHERE k % 7 <> 0), d AS (SELECT target FROM r GROUP BY 1 HAVING count(*) > 1)
    SELECT group_id, target, 'exists' AS reason FROM r WHERE target IN (SELECT 't/' || s_suppkey FROM supplier) UNION ALL SELECT group_id, target, 'shared' FROM r WHERE target IN (SELECT target FROM d)"""
)
def plan_conflicts(spark, sf_dir):
    existing = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("t/"), F.col("s_suppkey").cast("string")).alias("path"))
    return conflicts(_moves(spark, sf_dir), existing)


@query(f"WITH {_MOVES} SELECT group_id, action, target FROM m WHERE action = 'move' OR target NOT IN (SELECT 't/' || s_suppkey FROM supplier)")
def images_present(spark, sf_dir):
    existing = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("t/"), F.col("s_suppkey").cast("string")).alias("path"))
    return without_present(_moves(spark, sf_dir), existing).select("group_id", "action", "target")


@query(
    """SELECT c_nationkey, c_custkey, 'n-poster' || CASE WHEN n = 0 THEN '' ELSE '-' || n END || '.png' AS file_name, CASE c_custkey % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'refuse' ELSE 'keep' END AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)"""
)
def image_collisions(spark, sf_dir):
    """Addresses of one role in one place: each gets a name of its own; only https ones may be fetched."""
    k = F.col("c_custkey")
    scheme = F.when(k % 3 == 0, "HTTPS://").when(k % 3 == 1, "http://").otherwise("data:")
    images = _t(spark, sf_dir, "customer").select("c_nationkey", k.alias("ord"), F.lit("poster").alias("role"), F.concat(scheme, F.lit("h/"), k.cast("string"), F.lit(".PNG?x")).alias("url"), F.lit("n").alias("base"))
    named = name_images(images, id_col="c_nationkey").select("c_nationkey", F.col("ord").alias("c_custkey"), "file_name", image_action(F.col("url")).alias("action"))
    return named


# Names and places


@query(
    """SELECT p_partkey, p_size + 2080 BETWEEN 1900 AND 2100 AS is_year, p_partkey % 2 = 0 AS is_noise, p_name || ' ' || (p_size + 2080) || CASE WHEN p_partkey % 2 = 0 THEN ' 1080p' ELSE ' 80p' END AS words FROM part"""
)
def stem_tokens(spark, sf_dir):
    stem = F.concat("p_name", F.lit(".("), (F.col("p_size") + 2080).cast("string"), F.lit(")_["), F.when(F.col("p_partkey") % 2 == 0, "1080p").otherwise("80p"), F.lit("]"))
    found = _t(spark, sf_dir, "part").select("p_partkey", tokens(stem).alias("t"))
    last = lambda i: F.lower(F.element_at("t", i))
    return found.select("p_partkey", is_year(last(-2)).alias("is_year"), is_noise(last(-1)).alias("is_noise"), F.array_join("t", " ").alias("words"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN -1 ELSE c_custkey % 3 END AS depth FROM customer")
def listing_depth(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/in/"), "c_name")).when(k % 3 == 1, F.concat(F.lit("/in/d/"), "c_name")).otherwise(F.concat(F.lit("/int/"), "c_name"))
    return _t(spark, sf_dir, "customer").select("c_custkey", depth_under(path, "/in/").cast("long").alias("depth"))


# Sources


def _fails(name, path=None):
    if name.endswith("bolt"):
        raise ValueError(f"no {name}")
    return {"title": name.upper()}


@query(
    """SELECT p_partkey AS entity_id, o AS source_ord, CASE o WHEN 0 THEN 'first' ELSE 'second' END AS alias, o > 0 OR p_name NOT LIKE '%bolt' AS ok, CASE WHEN o = 0 AND p_name LIKE '%bolt' THEN 'no ' || p_name END AS error,
    CASE WHEN o = 1 THEN '2 ' || p_name WHEN p_name NOT LIKE '%bolt' THEN upper(p_name) END AS title FROM part, (VALUES (0), (1)) v(o) WHERE o = 0 OR p_name LIKE '%bolt'"""
)
def source_attempts(spark, sf_dir):
    """Sources in order until one succeeds; a failure is a row, and a repeated alias is not run."""
    sources = [Source("first", (), _fails), Source(" second ", (), lambda name, path=None: {"title": f"2 {name}"}), Source("first", (), lambda name, path=None: 1 / 0)]
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("path"))
    return run_sources(names, sources, 1).select("entity_id", "source_ord", "alias", "ok", "error", F.col("movie.title").alias("title"))


@query(
    """SELECT p_partkey, 'EN ' || p_type || '|de ' || p_type AS genre, 'de Ann:ROLE ' || upper(p_brand) AS actor, true AS changed FROM part"""
)
def translated_lists(spark, sf_dir):
    """Only texts of another language go out; lists and actors' fields keep their places."""
    record = movie(genre=F.array(F.concat(F.lit("en "), "p_type"), F.concat(F.lit("de "), "p_type")), actor=_actors(("de Ann", F.concat(F.lit("role "), "p_brand"), None)))
    told = lambda text: ("deu" if text.startswith("de") else "eng", 1.0)
    out = translate_movies(_t(spark, sf_dir, "part").select("p_partkey", record.alias("movie")), ["genre", "actor.name", "actor.role"], "de", lambda texts: [t.upper() for t in texts], told)
    return out.select("p_partkey", F.array_join("movie.genre", "|").alias("genre"), F.array_join(F.transform("movie.actor", lambda a: F.concat(a["name"], F.lit(":"), a["role"])), "|").alias("actor"), "changed")


# The watched directory

_T0 = "c_custkey * 1000000"


@query(
    f"""SELECT '/in/d/c' || c_custkey || '.mkv' AS path, status, CASE WHEN status = 'removed' THEN 0 ELSE c_custkey END AS length, {_T0} + d AS at_ms
    FROM customer, (VALUES ('pending', 0), ('ready', 0), ('retry', 2000), ('ready', 7000), ('removed', 21000)) v(status, d)"""
)
def watch_retries(spark, sf_dir):
    """Files that are there at the start are ready at once; one that fails waits, is ready again, and is done until it goes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_t(spark, sf_dir, "customer").schema).parquet(f"{sf_dir}/custome[r].parquet").repartition(spark.sparkContext.defaultParallelism)  # a pattern, as a stream of a lone file is refused
    moments = (("startup", 0), ("modify", 1000), ("failed", 2000), ("access", 3000), ("modify", 4000), ("modify", 9000), ("done", 9500), ("modify", 20000), ("remove", 21000))
    event = lambda path, kind, at: F.struct(path.alias("path"), F.lit(kind).alias("kind"), F.col("c_custkey").alias("length"), (F.col("c_custkey") * 1000000 + at).alias("at_ms"))
    path = lambda before, after: F.concat(F.lit(before), F.col("c_custkey").cast("string"), F.lit(after))
    elsewhere = [event(path(*p), "create", 0) for p in (("/in/d/c", ".txt"), ("/other/c", ".mkv"), ("/in/d/e/c", ".mkv"))]
    rows = stream.select(F.explode(F.array(*[event(path("/in/d/c", ".mkv"), k, at) for k, at in moments], *elsewhere)).alias("e")).select("e.*")
    done = watch(relevant(rows, "/in", 1), tick_by_events=True).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("path string, status string, length long, at_ms long").parquet(f"{where}/out")
