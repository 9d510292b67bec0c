"""Queries over the given tables, one for each operator or family, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json as js
from .functions.languages import language_prefix
from .functions.text import format_input_name, sanitize_component, union_list_agg
from .functions.urls import check_request, image_extension, is_trusted
from .operators import nodes as N
from .operators.node_store import store_nodes
from .operators.extract import css, extract, html_nodes, xpath
from .operators.images import name_images
from .operators.mapping import Mapper, map_column, map_movies, rules_frame
from .operators.movie import first_by_alias, from_nfo, limit_sources, merge_sources, movie, success_limit, to_nfo, unknown_aliases
from .operators.parts import group_video_inputs
from .operators.subtitles import match_subtitles
from .operators.template import output_paths
from .operators.translate import translate_movies
from .plans.output import actions, outputs, targets
from .sources.tables import dealt
from .streaming.watch import shared_folder, watch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(sql: str) -> str:
    """SQL that replaces the character references of the pages, whose semicolon may be missing."""
    for a, b in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        sql = f"regexp_replace({sql}, '{a}', '{b}', 'g')"
    return sql


# HTML


def _page_field(name: str, spec, spark: SparkSession, sf_dir: str, table_cols=("page_id",)) -> DataFrame:
    pages = dealt(_t(spark, sf_dir, "pages"))
    return pages.select(*table_cols, extract(F.col("html"), {name: spec})[name].alias(name))


@query(f"SELECT page_id, {_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM pages")
def page_titles(spark, sf_dir):
    return _page_field("title", css("title").text().first(), spark, sf_dir)


@query(f"SELECT page_id, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading FROM pages")
def page_headings(spark, sf_dir):
    return _page_field("heading", css("article > h1").text().first(), spark, sf_dir)


@query(
    f"""SELECT page_id, i - 1 AS pos, {_plain("h[i]")} AS href, {_plain("t[i]")} AS label FROM (
    SELECT page_id, h, t, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages))"""
)
def page_links(spark, sf_dir):
    links = css("nav ul li a[href]")
    pages = dealt(_t(spark, sf_dir, "pages")).select("page_id", extract(F.col("html"), {"href": links.attr("href").all(), "label": links.text().all()}).alias("x"))
    return pages.select("page_id", F.posexplode_outer(F.arrays_zip("x.href", "x.label")).alias("pos", "l")).where("pos is not null").select("page_id", F.col("pos").cast("long").alias("pos"), "l.href", "l.label")


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def page_lang(spark, sf_dir):
    return _page_field("lang", css(":root").attr("lang").first(), spark, sf_dir)


_ADS = f"""SELECT page_id, {_plain("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")} AS ad FROM pages"""


@query(_ADS)
def page_ads_css(spark, sf_dir):
    return _page_field("ad", css("div.ad").text().first(), spark, sf_dir)


@query(_ADS)
def page_ads_xpath(spark, sf_dir):
    return _page_field("ad", xpath("//div[contains(@class, 'ad')]").text().first(), spark, sf_dir)


@query("SELECT page_id, c AS comment FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS c FROM pages)")
def page_comments(spark, sf_dir):
    return _page_field("comment", xpath("//comment()").text().all(), spark, sf_dir).select("page_id", F.posexplode_outer("comment").alias("pos", "comment")).where("pos is not null").select("page_id", "comment")


@query(f"SELECT page_id, {_plain("regexp_replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '<[^>]*>', '', 'g')")} AS footer FROM pages")
def page_footer_text(spark, sf_dir):
    return _page_field("footer", css("footer").text().first(), spark, sf_dir)


@query("SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS script FROM pages")
def page_scripts(spark, sf_dir):
    return _page_field("script", css("script").text().first(), spark, sf_dir)


@query(f"""SELECT page_id, {_plain("regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)[2]")} AS by_path, by_path AS by_selector FROM pages""")
def nth_nav_item(spark, sf_dir):
    fields = {"by_path": xpath("//nav/ul/li[2]/a").text().first(), "by_selector": css("nav li:nth-child(2) > a").text().first()}
    return dealt(_t(spark, sf_dir, "pages")).select("page_id", extract(F.col("html"), fields).alias("x")).select("page_id", "x.*")


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<li><a href="/[^"]*">')) AS rooted, len(regexp_extract_all(html, '<div class="ad">')) AS ads,
    len(regexp_extract_all(html, '<meta charset')) AS charsets FROM pages"""
)
def attr_predicates(spark, sf_dir):
    fields = {"rooted": xpath("//nav//a[starts-with(@href, '/')]").node_id(), "ads": xpath("//div[@class = 'ad']").node_id(), "charsets": xpath("//meta[@charset]").node_id()}
    x = dealt(_t(spark, sf_dir, "pages")).select("page_id", extract(F.col("html"), fields).alias("x"))
    return x.select("page_id", *[F.size(F.col(f"x.{n}")).cast("long").alias(n) for n in fields])


@query(
    "SELECT page_id, name, n FROM ("
    + " UNION ALL ".join(f"SELECT page_id, '{n}' AS name, len(regexp_extract_all(html, '<{n}[ >]')) AS n FROM pages" for n in ("li", "a", "nav", "h1", "footer", "script"))
    + ") WHERE n > 0"
)
def nodes_by_tag(spark, sf_dir):
    nodes = html_nodes(_t(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.where((F.col("kind") == "element") & F.col("name").isin("li", "a", "nav", "h1", "footer", "script")).groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query(
    f"""SELECT page_id, len(regexp_extract_all(nav, '<a ')) AS links, {_plain("regexp_replace(nav, '<[^>]*>', '', 'g')")} AS nav_text FROM (
    SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages)"""
)
def axes_relational(spark, sf_dir):
    store = store_nodes(_t(spark, sf_dir, "pages"), "page_id", "html")
    navs = store.by_tag("nav")
    links = N.axis(store.by_tag("a"), navs, "descendant").groupBy("page_id").agg(F.count("*").alias("links"))
    return links.join(store.text_content(navs).select("page_id", F.col("text_content").alias("nav_text")), "page_id")


@query("""SELECT page_id, len(regexp_extract_all(html, '<li><a href="')) AS n FROM pages""")
def selector_relational(spark, sf_dir):
    store = store_nodes(_t(spark, sf_dir, "pages"), "page_id", "html")
    return N.twig(store.by_tag("nav", "ul", "li", "a"), "nav > ul li > a[href^='/']").groupBy("page_id").agg(F.count("*").alias("n"))


@query()
def dom_outline(spark, sf_dir):
    nodes = html_nodes(_t(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


# Addresses and JSON

_RULES = ["https://*.example.com/en/", "https://m.ththth.example.net/*/25", "http://ththre.example.com"]


@query(
    r"""SELECT page_id, regexp_matches(url, '^https://[^./]+\.example\.com/en/') OR regexp_matches(url, '^https://m\.ththth\.example\.net/[^/]*/25([?#]|$)')
    OR regexp_matches(url, '^http://ththre\.example\.com([/?#]|$)') AS trusted FROM pages"""
)
def url_allowlist(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", is_trusted(F.col("url"), _RULES).alias("trusted"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^./]+\.example\.com/en/') THEN 'none' ELSE 'untrusted' END AS refused FROM pages""")
def url_requests(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.coalesce(check_request(F.col("url"), _RULES[:1]), F.lit("none")).alias("refused"))


@query(
    r"""SELECT page_id, CASE WHEN e = '' THEN 'jpg' ELSE lower(e) END AS ext FROM (
    SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '#.*', ''), '\?.*', ''), '\.([A-Za-z0-9]{1,8})$', 1) AS e,
    url FROM pages) WHERE regexp_matches(url, '/[^/]*$')"""
)
def url_image_ext(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", image_extension(F.col("url")).alias("ext"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def json_props(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("v", js.decode(F.col("props")))
    k = js.get(F.col("v"), "$.k", "bigint")
    return events.select("event_id", k.alias("k"), js.encode(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("encoded"))


# Names


@query(r"""SELECT p_partkey, trim(regexp_replace(replace(replace(replace(regexp_replace(p_name || '_' || lower(p_type), '(gear|ring)', '<\1>', 'g'), 'o', '0'), 'sm', ''), '_', ' '), '\s+', ' ', 'g')) AS name FROM part""")
def name_cleanup(spark, sf_dir):
    rules = ["regex-replace:(?P<what>gear|ring)=><${what}>", "replace:o=>0", "sm", "replace:_=> ", "regex:^zz"]
    return _t(spark, sf_dir, "part").select("p_partkey", format_input_name(F.concat("p_name", F.lit("_"), F.lower("p_type")), rules).alias("name"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g'), '[/\\:*?"<>|]', '_', 'g'), '\s+', ' ', 'g'), '. ') AS name FROM (
    SELECT doc_id, text FROM documents)"""
)
def sanitize_titles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(sanitize_component("text"), r"^[. ]+|[. ]+\z", "").alias("name"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of parts: one to three split files for each, in a thousand directories. Numbers follow a
    letter, so that none reads as a year, which names may leave out."""
    part = dealt(_t(spark, sf_dir, "part"))
    n = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")))
    base = F.concat(F.lit("/in/"), (F.col("p_partkey") % 1000).cast("string"), F.lit("/"), "p_name", F.lit(" n"), F.col("p_partkey").cast("string"))
    return part.select(F.explode(n).alias("n"), base.alias("base")).select(F.concat("base", F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("-CD"), F.col("n").cast("string"))), F.lit(".mkv")).alias("path"))


_FILES = """f AS (SELECT p_partkey AS k, p_name || ' n' || p_partkey AS stem, '/in/' || (p_partkey % 1000) || '/' AS dir,
  unnest(CASE WHEN p_partkey % 4 = 0 THEN [0] ELSE range(1, p_partkey % 3 + 2) END) AS n FROM part),
g AS (SELECT *, dir || stem || CASE WHEN n = 0 THEN '' ELSE '-CD' || n END || '.mkv' AS path, count(*) OVER (PARTITION BY k) AS parts FROM f)"""


@query(
    f"""WITH {_FILES} SELECT min(path) OVER (PARTITION BY k) AS group_id, CASE WHEN parts = 1 AND n > 0 THEN stem || '-CD1' ELSE stem END AS input_stem,
  row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS pos, path, CASE WHEN parts = 1 THEN '' ELSE '.part0' || n END AS output_suffix FROM g"""
)
def part_groups(spark, sf_dir):
    groups = group_video_inputs(_files(spark, sf_dir))
    return groups.select("group_id", "input_stem", F.posexplode("parts").alias("pos", "p")).select("group_id", "input_stem", F.col("pos").cast("long").alias("pos"), "p.path", "p.output_suffix")


def _subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = dealt(_t(spark, sf_dir, "part"))
    stem = F.concat(F.lit("/in/"), (F.col("p_partkey") % 1000).cast("string"), F.lit("/"), "p_name", F.lit(" n"), F.col("p_partkey").cast("string"))
    return part.select(F.explode(F.array(*[F.concat(stem, F.lit(x)) for x in (".zh.srt", ".en-us.forced.ass", "-CD1.ger.srt", ".txt")])).alias("path"))


@query(
    f"""WITH {_FILES}, h AS (SELECT DISTINCT k, stem, dir, parts, min(path) OVER (PARTITION BY k) AS group_id, (min(n) OVER (PARTITION BY k)) = 0 AS plain FROM g),
s AS (SELECT *, unnest([1, 2, 3]) AS i FROM h)
SELECT group_id, dir || stem || CASE i WHEN 1 THEN '.zh.srt' WHEN 2 THEN '.en-us.forced.ass' ELSE '-CD1.ger.srt' END AS path,
  CASE WHEN i = 3 AND plain THEN '.CD1.ger' WHEN i = 3 THEN CASE WHEN parts > 1 THEN '.part01' ELSE '' END || '.de' WHEN NOT plain AND parts = 1 THEN '' WHEN i = 1 THEN '.zh-CN' ELSE '.en-US.forced' END AS target_base
FROM s WHERE plain OR parts > 1 OR i = 3"""
)
def subtitle_matches(spark, sf_dir):
    files = _files(spark, sf_dir)
    return match_subtitles(group_video_inputs(files), files.unionByName(_subtitles(spark, sf_dir))).select("group_id", "path", "target_base")


_MARKED = (("zh.hans.forced", "zh-CN", 2), ("eng", "en", 1), ("PT BR", "pt-BR", 2), ("pt", "pt", 1), ("nothing", None, 0), ("jp.2", "ja", 1))


@query(
    "SELECT c_custkey, w || '.' || lower(c_mktsegment) AS words, language, consumed FROM customer JOIN (VALUES "
    + ", ".join(f"({k}, '{w}', {'NULL' if lang is None else repr(lang)}, {n})" for k, (w, lang, n) in enumerate(_MARKED))
    + ") v(k, w, language, consumed) ON c_custkey % 6 = k"
)
def language_suffix(spark, sf_dir):
    words = F.concat(F.element_at(F.array(*[F.lit(w) for w, _, _ in _MARKED]), (F.col("c_custkey") % 6 + 1).cast("int")), F.lit("."), F.lower("c_mktsegment"))
    one = _t(spark, sf_dir, "customer").select("c_custkey", words.alias("words")).withColumn("x", language_prefix(F.split(F.lower("words"), "[. ]")))
    return one.select("c_custkey", "words", "x.language", "x.consumed")


# Records


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    thumb = lambda url: F.struct(F.lit(None).cast("string").alias("@aspect"), F.lit(None).cast("string").alias("@preview"), text(url).cast("string").alias("$text"))
    actor = lambda *names: F.array(*[F.struct(n.alias("name"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("gender"), F.lit(i).cast("long").alias("order")) for i, n in enumerate(names, 1)])
    a = movie(
        title=F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))), year=F.when(k % 4 != 0, F.col("p_size") + 1900), genre=F.array("p_type", F.lower("p_type")),
        thumb=F.when(k % 2 == 1, thumb(F.concat(F.lit("https://a/"), k.cast("string")))), actor=actor(F.col("p_brand"), F.lit("Ann")),
    )
    b = movie(title=F.concat(F.lit("B "), "p_name"), year=F.lit(2000), studio=F.col("p_brand"), genre=F.array(F.lit("promo"), F.concat(F.lit(" "), "p_brand")), actor=actor(F.lit("ann "), F.lit("Bob")))
    c = movie(studio=F.lit("C"), thumb=F.when(k % 10 != 0, thumb(F.concat(F.lit("https://c/"), k.cast("string")))))
    rows = [F.struct(F.lit(i).alias("source_ord"), F.lit(n).alias("alias"), m.alias("movie")) for i, (n, m) in enumerate((("a", a), ("b", b), ("c", c)))]
    out = part.select(k.alias("entity_id"), F.explode(F.array(*rows)).alias("s")).select("entity_id", "s.*")
    return out.where("alias <> 'c' or entity_id % 5 = 0")


def _flat(merged: DataFrame) -> DataFrame:
    m = "movie"
    return merged.select("entity_id", F.col(f"{m}.title").alias("title"), F.col(f"{m}.year").alias("year"), F.col(f"{m}.studio").alias("studio"), F.array_join(F.col(f"{m}.genre"), "|").alias("genre"), F.col(f"{m}.thumb.`$text`").alias("thumb"))


@query(
    """SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN 'B ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 1900 ELSE 2000 END AS year,
    p_brand AS studio, p_type || CASE WHEN p_type = 'PROMO' THEN '' ELSE '|promo' END || '|' || p_brand AS genre,
    CASE WHEN p_partkey % 2 = 1 THEN 'https://a/' || p_partkey WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 0 THEN 'https://c/' || p_partkey END AS thumb FROM part"""
)
def merge_details(spark, sf_dir):
    return _flat(merge_sources(_sources(spark, sf_dir)))


@query(
    """SELECT p_partkey AS entity_id, 'B ' || p_name AS title, 2000 AS year, p_brand AS studio, 'promo|' || p_brand AS genre,
    CASE WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 0 THEN 'https://c/' || p_partkey WHEN p_partkey % 2 = 1 THEN 'https://a/' || p_partkey END AS thumb FROM part"""
)
def merge_priority(spark, sf_dir):
    return _flat(merge_sources(_sources(spark, sf_dir), details=["b", " a ", "b"], images=["c", "a"], multi=False))


@query(
    """SELECT o_custkey, string_agg(v, '|' ORDER BY k) AS priorities FROM (
    SELECT o_custkey, trim(o_orderpriority) AS v, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1"""
)
def merge_lists(spark, sf_dir):
    spelled = F.posexplode(F.array(F.concat(F.lit(" "), "o_orderpriority"), F.lower("o_orderpriority"), F.lit(" "))).alias("pos", "v")
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", spelled)
    return union_list_agg(rows, ["o_custkey"], "v", ["o_orderkey", "pos"]).select("o_custkey", F.array_join("values", "|").alias("priorities"))


@query(
    """SELECT p_partkey AS entity_id, unnest([0, 1, 2]) AS pos, unnest([p_brand, 'Ann', 'Bob']) AS name, unnest([1, 2, 3]) AS actor_order FROM part"""
)
def merge_actors(spark, sf_dir):
    merged = merge_sources(_sources(spark, sf_dir)).select("entity_id", F.posexplode("movie.actor").alias("pos", "a"))
    return merged.select("entity_id", "pos", "a.name", F.col("a.order").alias("actor_order"))


@query("SELECT user_id AS entity_id, event_id AS source_ord FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 2")
def source_limit(spark, sf_dir):
    tried = _t(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("source_ord"), (F.col("event_type") != "error").alias("ok"))
    return limit_sources(tried, success_limit(True)).select("entity_id", "source_ord")


@query("SELECT source AS alias, doc_id AS ord, doc_id > min(doc_id) OVER (PARTITION BY source) AS is_duplicate FROM documents")
def alias_dedup(spark, sf_dir):
    return first_by_alias(_t(spark, sf_dir, "documents").select(F.col("source").alias("alias"), F.col("doc_id").alias("ord"))).select("alias", "ord", "is_duplicate")


@query("SELECT n_name AS alias, min(n_nationkey) AS ord FROM nation WHERE n_name NOT IN (SELECT DISTINCT source FROM documents) GROUP BY 1")
def alias_unknown(spark, sf_dir):
    wanted = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("ord"))
    return unknown_aliases(wanted, _t(spark, sf_dir, "documents").select(F.col("source").alias("alias")))


_MAPPING = """# values of segments
node,to,from
segment,Home,HOUSEHOLD, "house hold"
segment,,machinery
segment,Car,AUTOMOBILE
segment,Auto,automobile
genre,Cheap,economy,promo
genre,,small
studio,"Brand, the second",Brand#2
"""


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN NULL WHEN 'AUTOMOBILE' THEN 'Auto' ELSE c_mktsegment END AS segment FROM customer")
def value_mapping(spark, sf_dir):
    rules = rules_frame(spark, [_MAPPING])
    return map_column(_t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", rules, "segment", len(_MAPPING))


@query(
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Cheap|Extra' WHEN 'PROMO' THEN 'Cheap|Extra' WHEN 'SMALL' THEN 'Extra' ELSE p_type || '|Extra' END AS genre,
    CASE p_brand WHEN 'Brand#2' THEN 'Brand, the second' ELSE p_brand END AS studio FROM part"""
)
def record_mapping(spark, sf_dir):
    record = movie(genre=F.array("p_type", F.lit(" Extra"), F.lower("p_type")), studio=F.concat("p_brand", F.lit(" ")))
    part = dealt(_t(spark, sf_dir, "part")).select("p_partkey", map_movies(record, Mapper([_MAPPING])).alias("m"))
    return part.select("p_partkey", F.array_join("m.genre", "|").alias("genre"), F.col("m.studio").alias("studio"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.struct(F.lit("local").alias("@type"), F.lit(True).alias("@default"), F.col("p_partkey").cast("string").alias("$text")))
    record = movie(title=F.concat("p_name", F.lit("/"), "p_brand"), year=F.col("p_size") + 1950, genre=F.array("p_type", F.lit("All")), userrating=(F.col("p_size") / 10), uniqueid=ids)
    return dealt(_t(spark, sf_dir, "part")).select("p_partkey", record.alias("movie"))


@query(
    """SELECT p_partkey, i AS ord, CASE i WHEN 0 THEN p_type ELSE 'All' END || '/' || p_name || '_' || p_brand || ' (' || (p_size + 1950) || ')/' || p_partkey AS path
    FROM (SELECT *, unnest([0, 1]) AS i FROM part)"""
)
def template_paths(spark, sf_dir):
    paths = output_paths("{genre}/{title} ({year})/{uniqueid.local}", F.col("movie"), F.lit("x"))
    return _records(spark, sf_dir).select("p_partkey", F.posexplode_outer(paths).alias("ord", "path"))  # there is always one


@query(
    f"""WITH {_FILES}, t AS (SELECT k, min(path) OVER (PARTITION BY k) AS group_id, path, parts, n, stem, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS i FROM g),
p AS (SELECT group_id, 0 AS o, i, 'move' AS action, path AS source, 'A/' || stem || CASE WHEN parts = 1 THEN '' ELSE '.part0' || n END || '.mkv' AS target FROM t
UNION ALL SELECT DISTINCT group_id, 0, parts, 'write', NULL, 'A/' || stem || '.nfo' FROM t
UNION ALL SELECT group_id, 1, i, 'hardlink', 'A/' || stem || CASE WHEN parts = 1 THEN '' ELSE '.part0' || n END || '.mkv', 'B/' || stem || CASE WHEN parts = 1 THEN '' ELSE '.part0' || n END || '.mkv' FROM t
UNION ALL SELECT DISTINCT group_id, 1, parts, 'hardlink', 'A/' || stem || '.nfo', 'B/' || stem || '.nfo' FROM t)
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY o, i) - 1 AS step, action, source, target FROM p"""
)
def output_plan(spark, sf_dir):
    files = _files(spark, sf_dir)
    groups = group_video_inputs(files)
    title = F.regexp_replace("input_stem", "-CD1$", "")
    records = groups.select("group_id", "input_stem", movie(title=title, genre=F.array(F.lit("A"), F.lit("B"))).alias("movie"))
    places = outputs(records, "{genre}/{title}", "hard")
    none = match_subtitles(groups, files)
    return actions(targets(places, groups, none), "hard")


@query(
    """WITH l AS (SELECT page_id, i - 1 AS ord, 'https://h' || h[i] AS url FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages)))
    SELECT page_id, ord, 'p-fanart' || CASE WHEN f = 0 THEN '' ELSE '-' || (f + 1) END || '.jpg' AS file_name FROM (SELECT *, min(ord) OVER (PARTITION BY page_id, url) AS f FROM l)"""
)
def image_names(spark, sf_dir):
    found = dealt(_t(spark, sf_dir, "pages")).select("page_id", extract(F.col("html"), {"u": css("nav a").attr("href").all()})["u"].alias("u"))
    images = found.select("page_id", F.posexplode_outer("u").alias("ord", "href"), F.lit("p").alias("base")).where("ord is not null")
    role = F.when(F.col("ord") == 0, "fanart").otherwise(F.concat(F.lit("fanart-"), (F.col("ord") + 1).cast("string")))
    images = images.select("page_id", F.col("ord").cast("long").alias("ord"), role.alias("role"), F.concat(F.lit("https://h"), "href").alias("url"), "base")
    return name_images(images, id_col="page_id").select("page_id", "ord", "file_name")


@query("SELECT p_partkey, p_name || '/' || p_brand AS title, p_size + 1950 AS year, p_type || '|All' AS genre, CAST(p_partkey AS VARCHAR) AS id, CAST(round(p_size * 10) AS BIGINT) AS rating100 FROM part")
def nfo_roundtrip(spark, sf_dir):
    back = _records(spark, sf_dir).select("p_partkey", from_nfo(to_nfo(F.col("movie"))).alias("m"))
    rating = F.round(F.col("m.userrating") * 100).cast("long")
    return back.select("p_partkey", "m.title", "m.year", F.array_join("m.genre", "|").alias("genre"), F.get("m.uniqueid", F.lit(0))["$text"].alias("id"), rating.alias("rating100"))


def _told(text: str) -> tuple[str, float]:
    return {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}.get(text[:2], "und"), 1.0


def _louder(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN lang || ' title ' || source ELSE upper(lang || ' title ' || source) END AS title, lang <> 'en' AS changed FROM documents")
def translate_gate(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", movie(title=F.concat("lang", F.lit(" title "), "source")).alias("movie"))
    return translate_movies(docs, ["Title", "plot"], "en-US", _louder, _told).select("doc_id", "movie.title", "changed")


@query(
    """WITH e AS (SELECT user_id, event_id * 10000 AS t, event_type = 'error' AS gone, CAST(floor(value * 100) AS BIGINT) AS length FROM events),
s AS (SELECT *, count(*) FILTER (gone) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS next FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(life, 0) ORDER BY t) AS k FROM s)
SELECT '/in/u' || user_id || '.mkv' AS path, 'pending' AS status, length, t AS at_ms FROM f WHERE k = 1 AND NOT gone
UNION ALL SELECT '/in/u' || user_id || '.mkv', 'ready', length, t + 3000 FROM f WHERE k = 1 AND NOT gone AND next IS NOT NULL
UNION ALL SELECT '/in/u' || user_id || '.mkv', 'removed', 0, t FROM f WHERE gone AND k > 1"""
)
def watch_replay(spark, sf_dir):
    """Events of users as events of files, replayed by their own clock until all are read."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    stored = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream of a lone file is refused
    kind = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "create").otherwise("modify")
    events = stream.select(F.concat(F.lit("/in/u"), F.col("user_id").cast("string"), F.lit(".mkv")).alias("path"), kind.alias("kind"), F.floor(F.col("value") * 100).cast("long").alias("length"), (F.col("event_id") * 10000).alias("at_ms"))
    done = watch(events, tick_by_events=True).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("path string, status string, length long, at_ms long").parquet(f"{where}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings, languages and link counts of all pages, by one parse of each."""
    fields = {"title": css("title").text().first(), "heading": css("article > h1").text().first(), "lang": css(":root").attr("lang").first(), "links": css("nav a[href]").attr("href").all()}
    x = _t(spark, sf_dir, "pages").select("page_id", extract(F.col("html"), fields).alias("x"))
    return x.select("page_id", "x.title", "x.heading", "x.lang", F.size("x.links").alias("n_links"))

