"""What keeps tasks, memory and shuffles in bounds on large tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagequarry.html.parser import parse
from pagequarry.operators import extract as E
from pagequarry.operators import movie as M
from pagequarry.operators.parts import group_video_inputs
from pagequarry.operators.subtitles import match_subtitles
from pagequarry.sources.tables import dealt

SF = "/root/testdata/sf0.001"
DEALT = ("xpath_compare", "xpath_axes", "template_paths", "actor_template", "nfo_roundtrip", "output_plan", "xpath_nearest", "node_attributes", "actor_mapping", "serialised", "parse_modes", "image_names", "page_comments", "dom_outline", "nodes_by_tag")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_small_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1
    assert dealt(table).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_before_the_work(spark, name):
    told = plan(entry.queries()[name](spark, SF))
    read, work = told.count("Relation ["), told.count("Repartition ")
    assert work >= read > 0


@pytest.mark.parametrize("name", ("page_comments", "image_names", "page_links"))
def test_a_page_is_parsed_once(spark, name):
    assert plan(entry.queries()[name](spark, SF)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ("template_paths", "actor_template"))
def test_paths_are_not_worked_out_for_a_filter_too(spark, name):
    assert "Filter" not in plan(entry.queries()[name](spark, SF))


def test_nodes_go_in_bounded_batches_and_as_the_rows_tell(spark):
    page = "<!DOCTYPE html><body class=a>" + "<p id='x' t=1>one<b>two</b><!--c--><br></p>" * 100
    others = ["<svg viewBox='0 0 1 1'></svg>", None, "", "<template><p>x</p></template><?pi x?>"]
    pages = [page] * 60 + others
    kind = E._arrow(E.NODE)
    batches = list(E.node_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["id", "html"])]), kind))
    most = max(len(E.node_rows(parse(p))) for p in pages if p is not None)
    assert len(batches) > 1 and all(b.num_rows < E.SLICE_NODES + most for b in batches)
    got = [r for b in batches for r in b.to_pylist()]
    want = [{"id": k, **n} for k, p in enumerate(pages) if p is not None for n in E._parsed(parse(p))["nodes"]]
    assert got == want


def test_subtitles_meet_by_hashes(spark):
    files = spark.createDataFrame([(p,) for p in ("/a/One 1999.mkv", "/a/One.zh.srt", "/b/One.zh.srt", "/a/one.1080p.srt", "/a/On.srt")], "path string")
    met = match_subtitles(group_video_inputs(files), files)
    assert sorted((r.path, r.target_base) for r in met.collect()) == [("/a/One.zh.srt", ".zh-CN"), ("/a/one.1080p.srt", "")]
    odd = spark.createDataFrame([(p,) for p in ("/a/!!.mkv", "/a/!!.srt", "/a/--.srt", "/b/!!.srt")], "path string")
    assert [(r.path, r.target_base) for r in match_subtitles(group_video_inputs(odd), odd).collect()] == [("/a/!!.srt", "")]  # no words at all
    assert "words#" not in met._jdf.queryExecution().executedPlan().toString()  # no lists of words are moved


@pytest.mark.parametrize("name", ("subtitle_matches", "subtitle_targets", "output_plan"))
def test_groups_and_keys_of_names_are_not_broadcast(spark, name):
    found = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in found and "SortMergeJoin" in found  # both sides grow with the files


def test_parser_reads_plain_and_odd_tags_alike():
    bits = ["<a b=\"1\" c='2'>", '<a b="1" B="2">', '<a b="&amp;"c="d">', '<P Q="1">', "</p>", "</P >", "<svg><linearGradient id='x'/>", "<ul><li>a</ul>", "x"]
    rnd = random.Random(1)
    for _ in range(300):
        text = "<!DOCTYPE html>" + "".join(rnd.choice(bits) for _ in range(8))
        tree, slow = parse(text), parse(text.replace("<", "<", 1).replace('="1"', "='1'").replace('="2"', "='2'"))
        assert (tree.kind, tree.name, tree.attrs, tree.children, tree.errors) == (slow.kind, slow.name, slow.attrs, slow.children, slow.errors)


def test_xml_texts_read_only_fields_that_are_told(spark, monkeypatch):
    thumb = {"@aspect": None, "@preview": 'p"', "$text": "a & b"}
    some = {"title": "A <b>", "year": 1999, "userrating": 7.25, "genre": ["x", None, "y"], "uniqueid": [{"@type": "t", "@default": True, "$text": "1"}], "ratings": {"rating": []}, "fanart": {"thumb": [thumb]}}
    rows = [some, None, {}, {"genre": [], "thumb": {}}, {"title": "", "tag": [None]}, {"set": {"name": None, "overview": "o"}, "thumb": thumb, "votes": 1}]
    kind = M._arrow(M.MOVIE)
    for part in (rows, rows[1:4], rows[1:2], rows[:1], []):
        values = pa.array(part, kind)
        assert M.nfo_texts(values).to_pylist() == [None if r is None else M.nfo_text(r) for r in values.to_pylist()]
    seen = []
    monkeypatch.setattr(M, "nfo_text", lambda r: seen.append(set(r)) or "")
    M.nfo_texts(pa.array(rows[2:5], kind))
    assert seen == [{"title", "tag", "thumb"}] * 3
