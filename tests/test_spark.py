"""Operators on Spark, by small cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagequarry import config as conf
from pagequarry.errors import ConfigError, MappingError, NotEnabled, PlanError, RequestRefused, RuleError, SourceError, TemplateError, TranslationError, UnknownFieldError, UrlRuleError
from pagequarry.functions import json as js
from pagequarry.functions.languages import language_code
from pagequarry.functions.text import file_extension, file_stem, format_input_name, key, parent_dir, sanitize_component, trim_u, union_list, union_list_agg, user_template
from pagequarry.functions.urls import UrlRule, check_request, image_action, image_extension, is_trusted
from pagequarry.operators import movie as M
from pagequarry.operators import nodes as N
from pagequarry.operators.extract import css, extract, html_nodes, html_parse, xpath
from pagequarry.operators.images import images_to_fetch, local_images, movie_images, name_images
from pagequarry.operators.mapping import Mapper, parse_line, parse_rules
from pagequarry.operators.parts import group_of, group_video_inputs
from pagequarry.operators.subtitles import match_subtitles, subtitle_suffix
from pagequarry.operators.template import output_paths, parse_template, render, template_fields
from pagequarry.operators.translate import chat_answer, cloud_answer, endpoint, requests, resolve_keys, segment_answer, texts_answer, translate_movies
from pagequarry.plans.effects import carry_out
from pagequarry.plans.library import plan_library
from pagequarry.plans.output import conflicts, preflight
from pagequarry.sources.files import scan_files, scan_videos
from pagequarry.sources.registry import Request, Source, check, counts, fetch, listing, lookup, run_sources, trusted_union
from pagequarry.streaming import watch as W


def values(spark, f, rows, ddl="a string, b string"):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    ddl = ", ".join(ddl.split(", ")[: len(rows[0])]) if ddl.startswith("a string") else ddl
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ddl)
    return [r[0] for r in df.orderBy("i").select(f(df).alias("v")).collect()]


def test_text(spark):
    assert values(spark, lambda d: trim_u("a"), ["\t a \n", "　x ", None]) == ["a", "x", None]
    assert values(spark, lambda d: key("a"), [" ÉA "]) == ["Éa"]
    assert values(spark, lambda d: sanitize_component("a"), ['a/b\\c:d*e?f"g<h>i|j', " ..x  y\t\tz.. ", "\x01", "."]) == ["a_b_c_d_e_f_g_h_i_j", "x yz", "", ""]
    assert values(spark, lambda d: file_extension("a"), ["/a/b.MKV", "/a.b/c", ".hidden", "x.", "a.tar.gz"]) == ["MKV", None, None, None, "gz"]
    assert values(spark, lambda d: file_stem("a"), ["/a/b.MKV", "/a.b/c", ".hidden", "a.tar.gz"]) == ["b", "c", ".hidden", "a.tar"]
    assert values(spark, lambda d: parent_dir("a"), ["/a/b", "b", "/b"]) == ["/a", "", ""]
    assert values(spark, lambda d: union_list(F.split("a", ","), F.split("b", ",")), [("a, B ,,b", "A,c,C ")]) == [["a", "B", "c"]]


def test_union_list_agg(spark):
    rows = [(1, 2, " b "), (1, 1, "A"), (1, 3, "a"), (1, 4, " "), (2, 1, None), (3, 9, "x"), (3, 8, "X ")]
    df = spark.createDataFrame(rows, "g int, o int, v string")
    assert {r.g: r["values"] for r in union_list_agg(df, ["g"], "v", ["o"]).collect()} == {1: ["A", "b"], 3: ["X"]}


def test_name_rules(spark):
    run = lambda name, *rules: values(spark, lambda d: format_input_name("a", list(rules)), [name])[0]
    assert run("Movie_2024_1080p", r"regex-replace:_(\d+)_=> ", r"regex:\d{4}$") == "Movie 1080p"
    assert run(" raw ") == " raw "
    assert run("A.x264.B", "x264, .") == "AB"
    assert run("a-b", "replace:-=> to ") == "a to b"
    assert run("ab12", "regex-replace:(?P<l>[a-z]+)(\\d+)=>$2${l}$1a$9!$$") == "12ab!$"
    assert user_template("(a)", "$10") == "" and user_template("(a)", "${1}0") == "$1\\0"
    for bad in ("regex:", "replace:=>x", "replace:ab", "regex:a(?=b)", r"regex:(a)\1", "regex:["):
        with pytest.raises(RuleError):
            format_input_name("a", [bad])
    with pytest.raises(Exception, match="leave nothing"):
        run("abc", "abc")


def test_urls(spark):
    for rule, url, want in (
        ("https://a.com/foo", "https://A.com/foobar?x", True), ("https://a.com/foo", "http://a.com/foo", False), ("https://a.com/*/x", "https://a.com/b/x", True),
        ("https://a.com/*/x", "https://a.com/b/c/x", False), ("https://a.com/*.nfo", "https://a.com/b.nfo", True), ("https://*.a.com/", "https://b.a.com/q", True),
        ("https://*.a.com/", "https://c.b.a.com/", False), ("https://*.a.com/", "https://a.com/", False), ("https://a.com:8443/", "https://a.com:8443/x", True),
        ("https://a.com/", "https://a.com:443/", True), ("https://a.com", "https://a.com", True), ("https://a.com/", "https://a.com.evil/", False), ("https://a.com/", None, False),
    ):
        assert values(spark, lambda d: is_trusted(F.col("a"), [rule]), [(url, "")]) == [want], (rule, url)
    for bad in ("ftp://a/", "a.com", "https://u@*.a.com/", "https://*.u@a.com/", "https://"):
        with pytest.raises(UrlRuleError):
            UrlRule.parse(bad)
    assert values(spark, lambda d: check_request(F.col("a"), ["https://a.com/"]), ["x", "ftp://a", "https:///p", "https://b/", "https://a.com/"]) == ["invalid", "scheme", "host", "untrusted", None]
    assert values(spark, lambda d: image_extension(F.col("a")), ["http://x/a.PNG?y.z#q", "http://x/a", "x/a.toolongext", "x/a.b/c"]) == ["png", "jpg", "jpg", "jpg"]
    assert values(spark, lambda d: image_action(F.col("a")), ["HTTPS://x", "http://x", "a.jpg"]) == ["fetch", "refuse", "keep"]


def test_json(spark):
    v = values(spark, lambda d: F.struct(js.get(js.decode(F.col("a")), "$.list[2]").alias("x"), js.is_null(F.variant_get(js.decode(F.col("a")), "$.n", "variant")).alias("n"), js.encode(js.decode(F.col("a"))).alias("j")), ['{"list":[1,2,3],"n":null}'])[0]
    assert v.x == "3" and v.n and json.loads(v.j) == {"list": [1, 2, 3], "n": None}


def test_extract(spark):
    page = '<!DOCTYPE html><html lang=en><body><nav><a href="/x">X &amp; Y</a><a>Z</a></nav><p class=" q  r">t<i>u</i></p></body></html>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    fields = {
        "one": css("nav a").text().first(), "all": css("a").attr("href").all(), "none": css("h1").text().first(), "inner": css("p").html().first(), "outer": xpath("//i").outer_html().first(),
        "cls": css("p").classes().first(), "scoped": css("a").text().within(css("nav")).all(), "tag": xpath("//p/*").tag().first(),
    }
    a, b, c = [r.x for r in df.select(extract(F.col("html"), fields).alias("x"), "page_id").orderBy("page_id").collect()]
    assert a.asDict() == {"one": "X & Y", "all": ["/x", None], "none": None, "inner": "t<i>u</i>", "outer": "<i>u</i>", "cls": "q r", "scoped": ["X & Y", "Z"], "tag": "i"}
    assert b is None and c.one is None and c.all == []
    parsed = df.where("page_id = 1").select(html_parse(F.col("html")).alias("p")).first().p
    assert parsed.errors == [] and parsed.quirks == "no-quirks" and parsed.nodes[1].kind == "doctype"
    with pytest.raises(Exception, match="missing doctype"):
        df.where("page_id = 3").select(html_parse(F.col("html"), checked=True)).collect()


def test_node_table(spark):
    page = "<!DOCTYPE html><div id=a class='x y x'><p data-k=v>1<b>2</b></p><p>3</p><!--c--></div><ul><li>1<li class=y>2</ul>"
    nodes = html_nodes(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "page_id", "html").cache()
    names = lambda df: [r.name for r in df.orderBy("pre").collect()]
    assert names(N.select(nodes, "div > p")) == ["p", "p"] and names(N.select(nodes, "div b, li + li")) == ["b", "li"]
    assert names(N.select(nodes, "p ~ p, li.y, #a, [data-k='v']")) == ["div", "p", "p", "li"]
    b = N.by_tag(nodes, "B")
    assert names(N.axis(nodes, b, "ancestor")) == [None, "html", "body", "div", "p"] and names(N.axis(nodes, b, "parent")) == ["p"]
    div = N.by_id(nodes, "a")
    assert N.axis(nodes, div, "descendant").count() == 7 and N.axis(nodes, div, "descendant-or-self").count() == 8 and N.axis(nodes, div, "following-sibling").count() == 1
    assert N.text_content(nodes, div).first().text_content == "123" and N.by_class(nodes, "x").count() == 2
    row = div.select(N.attrs_map().alias("m"), N.attr_names().alias("n"), N.classes().alias("c"), N.has_class("y").alias("h"), N.has_attr("q").alias("q")).first()
    assert row.m["id"] == "a" and row.n == ["id", "class"] and row.c == ["x", "y", "x"] and row.h and not row.q
    assert nodes.where(N.data_attr("k") == "v").count() == 1 and nodes.where(N.comment_text() == "c").count() == 1 and nodes.where(N.doctype().isNotNull()).count() == 1
    sib = N.with_siblings(nodes).where("name = 'li'").orderBy("pre").collect()
    assert sib[0].next_sibling == sib[1].node_id and sib[0].prev_sibling is None
    assert N.with_ends(nodes).where("name = 'ul'").first().first_child == sib[0].node_id
    assert N.root_element(nodes).first().name == "html"


def test_parts_and_subtitles(spark):
    paths = ["in/Movie-CD2.mkv", "in/Movie-CD1.mkv", "in/Movie CD3.mp4", "other/Movie-CD1.mkv", "in/Solo.part 1.mkv", "in/b.mkv", "in/x.txt", "in/Movie-CD1.zh.srt", "in/Movie.zh.srt", "in/Movie-CD1.mkv", "in/b.eng.ass", "in/bb.srt"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    groups = group_video_inputs(files)
    got = {r.group_id: (r.input_stem, [(p.path, p.output_suffix) for p in r.parts]) for r in groups.collect()}
    assert got["in/Movie-CD1.mkv"] == ("Movie", [("in/Movie-CD1.mkv", ".part01"), ("in/Movie-CD2.mkv", ".part02"), ("in/Movie CD3.mp4", ".part03")])
    assert got["other/Movie-CD1.mkv"] == ("Movie-CD1", [("other/Movie-CD1.mkv", "")]) and got["in/Solo.part 1.mkv"][0] == "Solo.part 1" and len(got) == 4
    subs = {r.path: (r.group_id, r.target_base) for r in match_subtitles(groups, files).collect()}
    assert subs == {"in/Movie-CD1.zh.srt": ("in/Movie-CD1.mkv", ".part01.zh-CN"), "in/Movie.zh.srt": ("in/Movie-CD1.mkv", ".zh-CN"), "in/b.eng.ass": ("in/b.mkv", ".en")}
    assert group_of(files, spark.createDataFrame([("in/Movie-CD2.mkv",)], "path string")).first().group_id == "in/Movie-CD1.mkv"
    cases = [("Movie", "Movie", ""), ("Movie.2020.1080p.BluRay.x264", "Movie.zh", ".zh-CN"), ("Up.2009", "U", None), ("Up.2009", "Up", ""), ("A.B", "a b.en-US.forced", ".en-US.forced"), ("A", "A.commentary", ".commentary"), ("A", "B", None), ("Éa", "éA.fr", ".fr")]
    assert values(spark, lambda d: subtitle_suffix(F.col("a"), F.col("b")), [c[:2] for c in cases]) == [c[2] for c in cases]


def record(**fields):
    empty = {f.name: [] if f.dataType.typeName() == "array" else None for f in M.struct_type(M.MOVIE).fields}
    return empty | fields


def movies(spark, *records):
    return spark.createDataFrame([(i, r) for i, r in enumerate(records)], f"i int, movie {M.MOVIE}")


def test_templates(spark):
    actors = [{"name": "Ann", "role": "lead", "gender": "f", "order": 1}, {"name": " ", "role": None, "gender": None, "order": 2}, {"name": "Bob", "role": None, "gender": "m", "order": 3}]
    m = record(title="A/B", year=2020, userrating=8.0, genre=["x", " ", "y"], actor=actors, set={"name": "S", "overview": None}, uniqueid=[{"@type": "t", "@default": None, "$text": "1"}, {"@type": "d", "@default": True, "$text": "2"}])
    df = movies(spark, m)
    paths = lambda t, fallback="fb": df.select(output_paths(t, F.col("movie"), F.lit(fallback)).alias("p")).first().p
    assert paths("{genre}/{actor}/{title}") == ["x/Ann/A_B", "y/Ann/A_B", "x/Bob/A_B", "y/Bob/A_B"]
    assert paths("{title} ({year}) {{x}}") == ["A_B (2020) {x}"] and paths("{userrating} {set.name} {uniqueid} {uniqueid.t}") == ["8 S 2 1"]
    assert paths("{actor[gender=F]}/{title}") == ["Ann/A_B"] and paths("{actor.role[order=1]}") == ["lead"] and paths("{actor[name='nobody']}/x") == ["fb"]
    assert paths("{tag}/{title}") == ["/A_B"] and paths("/abs//{title}") == ["/abs/A_B"] and paths("{tagline}") == ["fb"]
    assert df.select(render("{actor}", F.col("movie")).alias("r")).first().r == "Ann, Bob"
    assert template_fields("{year}{{c}} { title }") == ["year", "title"]
    for bad in ("{", "}", "{}", "{actor[}", "{actor[x=1]}", "{title[name=a]}", "{actor[order=x]}"):
        with pytest.raises(TemplateError):
            parse_template(bad)
    with pytest.raises(UnknownFieldError):
        parse_template("{nope}")
    with pytest.raises(Exception, match="relative segment|empty segment"):
        paths("{title}/../x")


def merged(spark, *named, **kw):
    rows = spark.createDataFrame([(1, i, a, m) for i, (a, m) in enumerate(named)], f"entity_id int, source_ord int, alias string, movie {M.MOVIE}")
    return M.merge_sources(rows, **kw).first().movie


def test_merge(spark):
    a = record(title=" ", year=None, genre=["Drama", " drama"], actor=[{"name": "Ann", "role": None, "gender": None, "order": 1}, {"name": "Bob", "role": None, "gender": None, "order": 2}], ratings={"rating": [{"@name": "x", "@max": None, "@default": None, "value": 5.0, "votes": None}]}, set={"name": " S ", "overview": None})
    b = record(title=" Two ", year=1999, genre=["DRAMA", "War"], actor=[{"name": " ann", "role": "lead", "gender": None, "order": 7}, {"name": "Cy", "role": None, "gender": None, "order": 1}], ratings={"rating": [{"@name": "X ", "@max": 10.0, "@default": True, "value": 1.0, "votes": 3}, {"@name": None, "@max": None, "@default": None, "value": 2.0, "votes": None}]}, set={"name": "T", "overview": " o "}, uniqueid=[{"@type": "t", "@default": None, "$text": "1"}])
    c = record(uniqueid=[{"@type": " T", "@default": True, "$text": "1 "}], thumb={"@aspect": None, "@preview": None, "$text": "u"}, fanart={"thumb": [{"@aspect": " ", "@preview": None, "$text": None}, {"@aspect": None, "@preview": "p", "$text": None}]})
    m = merged(spark, ("a", a), ("b", b), ("c", c))
    assert (m.title, m.year, m.genre, m["set"].name, m["set"].overview) == ("Two", 1999, ["Drama", "War"], " S ", "o")
    assert [(x.name, x.role, x.order) for x in m.actor] == [("Ann", "lead", 1), ("Bob", None, 2), ("Cy", None, 3)]
    assert [(r["@name"], r["@max"], r.value, r.votes) for r in m.ratings.rating] == [("x", 10.0, 5.0, 3), (None, None, 2.0, None)]
    assert [(u["@type"], u["@default"], u["$text"]) for u in m.uniqueid] == [("t", True, "1")]
    assert m.thumb["$text"] == "u" and [t["@preview"] for t in m.fanart.thumb] == ["p"]
    m = merged(spark, ("a", a), ("b", b), ("c", c), details=["c", "b", "zz"], images=["a"], multi=False)
    assert m.title is None and m.thumb is None and len(m.uniqueid) == 1
    m = merged(spark, ("a", a), ("b", b), details=["b"], multi=True)
    assert m.title == "Two" and m.genre == ["DRAMA", "War"]
    assert merged(spark, ("a", a), details=["b"]).title == " " and merged(spark, ("a", a), ("b", b), multi=False).title == " "
    twice = merged(spark, ("a", b), ("b", b))
    assert twice == merged(spark, ("a", b), ("b", record()))
    assert (M.success_limit(False, 5), M.success_limit(True, 0), M.success_limit(False, 1, True), M.success_limit(True)) == (1, None, None, 2)
    assert M.resolve_priority([], [" x ", "", "x", "y"]) == ["x", "y"]


def test_mapping():
    assert parse_line('a, "b ""q"", c" ,d|e') == ["a", 'b "q", c', "d|e"]
    rules = parse_rules("# c\n\nnode,to,from\ngenre,Drama,drama,dramatic\n genre ,,Bad\nactor,Ann B,ann\n")
    assert rules == [("genre", "drama", "Drama"), ("genre", "dramatic", "Drama"), ("genre", "bad", ""), ("actor", "ann", "Ann B")]
    assert parse_rules("node,from,to\ng,a,b") == [("g", "a", "b")] and parse_rules("g,b,a,c") == [("g", "a", "b"), ("g", "c", "b")]
    for bad in ("a,b", ",b,c", "g,b,", 'g,"b,c', "node,from,to\ng,a,b,c"):
        with pytest.raises(MappingError):
            parse_rules(bad)
    m = Mapper(["genre,Drama,dramatic\ngenre,,bad\ntitle,New,old\nactor,Ann,annie\nset.name,,gone", "title,Newer,OLD"])
    got = m.movie(record(title=" Old ", plot=" p ", genre=["Dramatic", "drama", "bad", "x "], set={"name": "gone", "overview": " o"}, actor=[{"name": "Annie", "role": None, "gender": None, "order": 5}, {"name": "ANN", "role": "r", "gender": None, "order": None}, {"name": None, "role": None, "gender": None, "order": 1}]))
    assert got["title"] == "Newer" and got["plot"] == "p" and got["genre"] == ["Drama", "x"] and got["set"] == {"name": None, "overview": "o"}
    assert [(a["name"], a["role"], a["order"]) for a in got["actor"]] == [("Ann", "r", 1), (None, None, 2)]
    same = record(title=" Old ")
    assert Mapper([]).movie(same) is same


def test_nfo(spark):
    m = record(title="A & B <c>", userrating=8.0, genre=["x", "y"], actor=[{"name": "Ann", "role": None, "gender": None, "order": 1}], uniqueid=[{"@type": "t", "@default": True, "$text": "1"}], thumb={"@aspect": 'p"', "@preview": None, "$text": "u"}, ratings={"rating": [{"@name": "i", "@max": 10.0, "@default": None, "value": 7.5, "votes": 3}]})
    df = movies(spark, m, record())
    texts = [r.x for r in df.select(M.to_nfo(F.col("movie")).alias("x"), "i").orderBy("i").collect()]
    assert texts[0].splitlines()[:2] == ["<movie>", "  <title>A &amp; B &lt;c&gt;</title>"] and "  <actor>\n    <name>Ann</name>\n" in texts[0] and texts[1] == "<movie />" and "<userrating>8</userrating>" in texts[0]
    back = df.where("i = 0").select(M.from_nfo(M.to_nfo(F.col("movie"))).alias("m")).first().m
    assert back.title == "A & B <c>" and back.genre == ["x", "y"] and back.uniqueid[0]["$text"] == "1" and back.ratings.rating[0].value == 7.5 and back.thumb["@aspect"] == 'p"'
    with pytest.raises(Exception):
        values(spark, lambda d: M.from_nfo(F.col("a")), ["<movie><title>"])
    kept = df.where("i = 1").select(M.nfo_output(F.lit("<movie/>"), F.col("movie"), F.lit(False)).alias("a"), M.nfo_output(F.lit("<movie/>"), F.col("movie"), F.lit(True)).alias("b")).first()
    assert (kept.a, kept.b) == ("<movie/>", "<movie />")


def test_images(spark):
    m = record(thumb={"@aspect": None, "@preview": "https://x/p.png", "$text": "https://x/a.jpg"}, fanart={"thumb": [{"@aspect": None, "@preview": None, "$text": "https://x/a.jpg"}, {"@aspect": None, "@preview": None, "$text": "http://x/c"}]})
    images = movie_images(movies(spark, m).withColumnRenamed("i", "group_id")).withColumn("base", F.lit("B"))
    rows = {(r.ord, r.role): (r.file_name, r.action, r.is_first) for r in name_images(images).collect()}
    assert rows == {(0, "poster"): ("B-poster.jpg", "fetch", True), (1, "poster-preview"): ("B-poster-preview.png", "fetch", True), (2, "fanart"): ("B-poster.jpg", "fetch", False), (4, "fanart-2"): ("B-fanart-2.jpg", "refuse", True)}
    own = movies(spark, m).withColumnRenamed("i", "group_id")
    local = local_images(own, name_images(images).where("action <> 'refuse'")).first().movie
    assert (local.thumb["$text"], local.thumb["@preview"]) == ("B-poster.jpg", "B-poster-preview.png") and [t["$text"] for t in local.fanart.thumb] == ["B-poster.jpg", "http://x/c"]
    with pytest.raises(Exception, match="plain http"):
        local_images(own, name_images(images)).collect()
    present = spark.createDataFrame([("d", "B-poster-preview.png")], "dir string, file_name string")
    assert [r.file_name for r in images_to_fetch(name_images(images).withColumn("dir", F.lit("d")), present).collect()] == ["B-poster.jpg"]


def test_translation(spark, tmp_path):
    one = record(title="the cat of the house", plot=" el gato de la casa ", genre=["una casa por la noche", "the of"], actor=[{"name": "el de la", "role": None, "gender": None, "order": 1}])
    two = record(plot="el gato de la casa", set={"name": None, "overview": "una casa por la noche"})
    calls = str(tmp_path)

    def stub(texts):
        import uuid

        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            json.dump(texts, f)
        return ["T:" + t for t in texts]

    told = lambda: sorted(t for name in os.listdir(calls) for t in json.load(open(f"{calls}/{name}")))
    df = translate_movies(movies(spark, one, one, two, record()).withColumn("row", F.lit(1)), ["title", "plot", "genre", "set_overview"], "eng", stub)
    got = df.orderBy(F.col("movie.plot"), F.col("movie.title")).collect()
    assert df.columns[-2:] == ["row", "changed"] and [r.changed for r in got] == [False, True, True, True]
    assert got[0].movie == df.where("not changed").first().movie and [r.movie.plot for r in got[1:]] == ["T:el gato de la casa"] * 3
    assert {(r.movie.title, tuple(r.movie.genre)) for r in got if r.movie.title} == {("the cat of the house", ("T:una casa por la noche", "the of"))}
    assert [r.movie.set.overview for r in got if r.movie.set] == ["T:una casa por la noche"]
    assert told() == ["el gato de la casa", "una casa por la noche"]  # once each, however often the result is read
    assert list(requests(iter(["aa", "b" * 9, "c", "d"]), 2, 8)) == [["aa"], ["b" * 9], ["c", "d"]] and list(requests(iter([]))) == []
    with pytest.raises(Exception, match="went out"):
        translate_movies(movies(spark, two), ["plot"], "eng", lambda t: []).collect()
    assert resolve_keys(["Set", "actor", "ACTOR_ROLE", "title"]) == ["set.name", "actor.name", "actor.role", "title"]
    assert [language_code(x) for x in ("eng", "en-US", "zh_CN", "pt-por") if x != "pt-por"] == ["eng", "eng", "cmn"]
    for bad in (lambda: resolve_keys(["nope"]), lambda: language_code("xx")):
        with pytest.raises(TranslationError):
            bad()
    with pytest.raises(NotEnabled):
        endpoint("deep-l")
    assert chat_answer(json.dumps({"choices": [{"message": {"content": "```text\nhi\n```"}}]})) == "hi" and cloud_answer('{"data":{"translations":[{"translatedText":"a"}]}}') == ["a"]
    assert segment_answer('[[["a ","x"],["b","y"]],null]') == "a b" and texts_answer('{"translations":[{"text":"q"}]}') == ["q"]
    assert endpoint("google-free", lambda k, t: ['[[["Z"]]]'])(["z"]) == ["Z"]
    df = translate_movies(movies(spark, record(plot="el gato de la casa"), record()), [], "en", stub)
    assert [r.changed for r in df.collect()] == [False, False]


def test_sources(spark):
    with pytest.raises(SourceError):
        check(Source(" ", (), lambda n: None))
    with pytest.raises(SourceError):
        check(Source("a", ("https://x/",)))
    with pytest.raises(UrlRuleError):
        check(Source("a", ("nope",), lambda n: None))
    names = spark.createDataFrame([("e1", "one", None), ("e2", "two", "/p")], "entity_id string, name string, path string")

    def bad(name, path=None):
        raise ValueError("no " + name)

    found = [Source("a", ("https://a/",), bad), Source("b", ("https://a/", "https://b/"), lambda n, p=None: {"title": n + (p or "")}), Source("b", (), bad), Source("c", (), lambda n, p=None: "<movie><title>x</title></movie>"), Source("d", (), lambda n, p=None: None)]
    rows = run_sources(names, found, None).collect()
    assert len(rows) == 8 and {(r.alias, r.ok) for r in rows} == {("a", False), ("b", True), ("c", True), ("d", False)}
    assert {r.movie.title for r in rows if r.alias == "b"} == {"one", "two/p"} and {r.error for r in rows if r.alias == "a"} == {"no one", "no two"}
    assert {r.alias for r in run_sources(names, found, 1).collect()} == {"a", "b"}
    assert trusted_union(found) == ["https://a/", "https://b/"]
    listed = listing(spark, found)
    assert counts(listed).first().asDict() == {"total": 5, "active": 4, "ignored": 1} and [r.duplicate_alias_ignored for r in listed.orderBy("ord").collect()] == [False, False, True, False, False]
    pages = spark.createDataFrame([("https://a/x", "<p>1")], "url string, html string")
    got = {r.url: (r.refused, r.html) for r in lookup(spark.createDataFrame([("https://a/x",), ("https://c/x",)], "url string"), pages, ["https://a/"]).collect()}
    assert got == {"https://a/x": (None, "<p>1"), "https://c/x": ("untrusted", None)}
    assert Request.of({"headers": {"a": "b"}, "version": "h2"}) == Request((("a", "b"),), "2") and Request.of({"a": "b"}).headers == (("a", "b"),)
    with pytest.raises(SourceError):
        Request.of({"version": "9"})
    with pytest.raises(RequestRefused):
        fetch("https://a/", [])
    assert M.unknown_aliases(spark.createDataFrame([("x", 0), ("b", 1), ("x", 2)], "alias string, ord int"), listed).collect() == [("x", 0)]


def test_scan_plan_and_effects(spark, tmp_path):
    for p in ("root.mkv", "child/Show-CD1.mkv", "child/Show-CD2.MKV", "child/Show.en.srt", "child/deep/x.avi", "note.txt"):
        f = tmp_path / "in" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(p)
    root = str(tmp_path / "in")
    n = lambda d: scan_videos(spark, root, d).count()
    assert (n(0), n(1), n(-1)) == (1, 3, 4)
    told = plan_library(scan_files(spark, root), [Source("s", (), lambda name, path=None: {"title": "el gato de la casa", "thumb": {"@aspect": None, "@preview": None, "$text": "https://x/a.png"}})], conf.resolve({}, "dir", {"save_images": True, "translate": ["title"], "target_lang": "en", "output": "out/{title}"}), translate=lambda texts: ["T"] * len(texts))
    assert {(r.action, r.source, r.target) for r in told.actions.where("action = 'fetch'").collect()} == {("fetch", "https://x/a.png", "out/T-poster.png")}
    assert all("<thumb>T-poster.png</thumb>" in r.nfo for r in told.records.collect())
    for bad in (lambda: scan_files(spark, root, -2), lambda: scan_files(spark, root + "/root.mkv")):
        with pytest.raises(ConfigError):
            bad()
    src = [Source("s", (), lambda name, path=None: {"title": "T " + name, "genre": ["A", "B"]})]
    settings = conf.resolve({}, "dir", {"output": "{genre}/{title}", "multi_folder": "hard", "input_name_rules": ["replace:Show=>Movie"]})
    done = plan_library(scan_files(spark, root), src, settings)
    steps = done.actions.orderBy("group_id", "step").collect()
    show = [(s.action, s.target) for s in steps if "Show" in s.group_id]
    assert show[:4] == [("move", "A/T Movie.part01.mkv"), ("move", "A/T Movie.part02.MKV"), ("move", "A/T Movie.en.srt"), ("write", "A/T Movie.nfo")] and show[4:] == [("hardlink", t.replace("A/", "B/", 1)) for _, t in show[:4]]
    assert conflicts(done.actions, spark.createDataFrame([("A/T root.mkv",)], "path string")).count() == 1
    with pytest.raises(PlanError):
        preflight(done.actions, spark.createDataFrame([("A/T root.mkv",)], "path string"))
    out = tmp_path / "out"
    results = carry_out(done.actions, str(out), done.records)
    assert len(results) == 3 and all(e is None for _, _, e in results)
    assert (out / "B/T Movie.part02.MKV").read_text() == "child/Show-CD2.MKV" and "<title>T Movie</title>" in (out / "A/T Movie.nfo").read_text() and not os.path.exists(root + "/root.mkv")
    outside = spark.createDataFrame([("g", 0, "move", root + "/note.txt", "/elsewhere/x")], "group_id string, step long, action string, source string, target string")
    with pytest.raises(PlanError, match="outside"):
        carry_out(outside, str(out))


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('sources = "a.py"\noutput = "{title}"\nmulti-source = true\n[dir]\nmax-depth = 2\nnode-mapping = ["m.csv", "m.csv"]\n[watch]\nsources = ["b.py", "a.py"]\n')
    c = conf.load(str(f))
    s = conf.resolve(c, "dir", {"output": "{year}", "max_depth": None})
    assert (s.sources, s.output, s.multi_source, s.max_depth, s.node_mapping, s.throttle_ms) == (["a.py"], "{year}", True, 2, ["m.csv"], 1000)
    assert conf.all_sources(c) == ["a.py", "b.py"] and conf.resolve(c, "watch").sources == ["b.py", "a.py"]
    for text in ("nope = 1", "[odd]\n", "max-depth = -2", 'multi-folder = "x"', "sources = 3", "x = ["):
        f.write_text(text)
        with pytest.raises(ConfigError):
            conf.load(str(f))
    with pytest.raises(ConfigError):
        conf.load(str(tmp_path / "none.toml"))
    (tmp_path / "x1.py").touch(), (tmp_path / "x2.py").touch()
    assert conf.expand([str(tmp_path / "x*.py"), "no*match"]) == [str(tmp_path / "x1.py"), str(tmp_path / "x2.py"), "no*match"]


def test_watch_state():
    s, told = W.step(None, "create", 5, 1000)
    assert told == "pending" and W.due(s) == 4000
    s, told = W.step(s, "modify", 6, 2000)
    assert told is None and W.due(s) == 5000 and W.due(W.step(s, "modify", 6, 3000)[0]) == 5000
    assert W.due(W.step(None, "startup", 5, 1000)[0]) <= 1000
    s, told = W.step(s, "failed", None, 7000)
    assert told == "retry" and W.due(s) == 12000
    s, _ = W.step(s, "done", None, 13000)
    assert W.step(s, "modify", 9, 14000) == (s, None) and W.step(s, "remove", None, 15000) == (None, "removed")


def test_watch_timer(spark, tmp_path):
    """A processing-time timer fires without any later event."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "events"
    src.mkdir()
    now = int(time.time() * 1000)
    (src / "a.json").write_text(json.dumps({"path": "/in/a.mkv", "kind": "create", "length": 3, "at_ms": now - 9000}) + "\n" + json.dumps({"path": "/in/b.txt", "kind": "create", "length": 3, "at_ms": now}))
    stream = spark.readStream.schema("path string, kind string, length long, at_ms long").json(str(src))
    seen = []
    q = W.start(W.watch(W.relevant(stream, "/in")), str(tmp_path / "state"), lambda df, _: seen.extend((r.path, r.status) for r in df.collect()), processingTime="200 milliseconds")
    for _ in range(120):
        time.sleep(0.25)
        if ("/in/a.mkv", "ready") in seen:
            break
    q.stop()
    assert seen == [("/in/a.mkv", "pending"), ("/in/a.mkv", "ready")]


def test_throttle():
    from pagequarry.sources.throttle import Slots

    clock = [1000.03]
    workers = [Slots(900, k, 3, lambda s: clock.__setitem__(0, clock[0] + s), lambda: clock[0]) for k in range(3)]
    starts = [w.take("a") for w in workers for _ in range(4)]
    assert len(set(starts)) == 12 and all(x >= 1000 for x in starts)
    gaps = sorted(round(b - a, 6) for a, b in zip(sorted(starts), sorted(starts)[1:]))
    assert gaps[0] >= 1.0 - 1e-6 and gaps[0] < 1.01
    assert workers[0].run("b", lambda x: x + 1, 1) == 2 and clock[0] > 1000.03
    with pytest.raises(ZeroDivisionError):
        workers[0].run("c", lambda: 1 / 0)
    clock[0] = 5.0
    assert Slots(0, 0, 1, lambda s: 1 / 0).run("a", int) == 0
