"""Plans carried out by tasks: whole groups or nothing, again after a lost task, and no new group after a failure."""

import os

import pytest

from pagequarry.errors import PlanError
from pagequarry.plans import writer
from pagequarry.plans.writer import carry_out_groups

PLAN = "group_id string, step long, action string, source string, target string"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


@pytest.fixture()
def place(spark, tmp_path):
    out = str(tmp_path / "out")
    nothing = spark.createDataFrame([], "path string")
    go = lambda rows, existing=nothing, **kw: {r.group_id: (r.steps, r.error) for r in carry_out_groups(spark.createDataFrame(rows, PLAN), out, existing, **kw).collect()}
    return tmp_path, out, go


def test_groups_are_placed_whole_or_not_at_all(spark, place):
    tmp, out, go = place
    a, b, c = (put(str(tmp / f"in/{k}.mkv"), k) for k in "abc")
    rows = [("1", 0, "move", a, "x/a.mkv"), ("1", 1, "fetch", "https://i/p.jpg", "x/a.jpg"), ("1", 2, "write", None, "x/a.nfo"), ("1", 3, "hardlink", "x/a.mkv", "y/a.mkv"), ("1", 4, "softlink", "x/a.nfo", "y/a.nfo")]
    rows += [("2", 0, "move", b, "x/b.mkv"), ("2", 1, "move", str(tmp / "in/gone.mkv"), "x/g.mkv"), ("3", 0, "move", c, "x/c.mkv"), ("3", 1, "softlink", "x/none", "y/c")]
    texts = spark.createDataFrame([("1", "<movie/>"), ("2", "no")], "group_id string, nfo string")
    got = go(rows, records=texts, fetch=lambda url: url.encode(), workers=3)
    assert got["1"] == (5, None) and got["2"][0] == got["3"][0] == 0 and got["2"][1] and got["3"][1]
    assert below(out) == ["x/a.jpg", "x/a.mkv", "x/a.nfo", "y/a.mkv", "y/a.nfo"] and os.path.exists(b) and os.path.exists(c)
    assert open(f"{out}/x/a.nfo").read() == "<movie/>" and open(f"{out}/x/a.jpg").read() == "https://i/p.jpg" and os.path.samefile(f"{out}/x/a.mkv", f"{out}/y/a.mkv") and os.path.islink(f"{out}/y/a.nfo")


def test_a_group_that_fails_in_place_is_taken_back(place, monkeypatch):
    tmp, out, go = place
    a, b = (put(str(tmp / f"in/{k}.mkv"), k) for k in "ab")
    put(f"{out}/b.mkv", "there")  # nobody has told of it
    assert go([("1", 0, "write", None, "a.nfo"), ("1", 1, "move", a, "a.mkv"), ("1", 2, "move", b, "b.mkv")])["1"][0] == 0
    assert below(out) == ["b.mkv"] and open(a).read() == "a" and open(b).read() == "b"


def test_phases_can_run_again(tmp_path):
    a = put(str(tmp_path / "a"), "a")
    steps = [{"step": k, "action": x, "source": s, "target": str(tmp_path / t), "nfo": "n"} for k, (x, s, t) in enumerate([("move", a, "o/a"), ("write", None, "o/n"), ("hardlink", str(tmp_path / "o/a"), "o/l")])]
    for _ in range(2):
        writer._stage("g", steps, None)
    for _ in range(2):  # the second attempt finds all done
        writer._place("g", steps)
    assert below(str(tmp_path / "o")) == ["a", "l", "n"]


def test_nothing_begins_if_targets_are_taken(spark, place):
    tmp, out, go = place
    a = put(str(tmp / "in/a"), "a")
    for rows, existing in (
        ([("1", 0, "move", a, "x"), ("2", 0, "write", None, "x")], []),
        ([("1", 0, "move", a, "x")], [("x",)]),
        ([("1", 0, "move", a, "../x")], []),
        ([("1", 0, "move", a, "/elsewhere/x")], []),
    ):
        with pytest.raises(PlanError):
            go(rows, spark.createDataFrame(existing, "path string"))
    assert below(str(tmp)) == ["in/a"] and go([]) == {}


def test_no_group_begins_after_a_failure(place):
    tmp, out, go = place
    rows = [(f"{k:03}", 0, "move", put(str(tmp / f"in/{k}"), "v") if k != 3 else str(tmp / "in/none"), f"{k}") for k in range(40)]
    got = go(rows, keep_going=False, workers=1)
    assert [g for g, (_, e) in got.items() if e] == ["003"] and sorted(got) == ["000", "001", "002", "003"] and below(out) == ["0", "1", "2"]
    assert len(go(rows[4:], keep_going=True, workers=4)) == 36 and len(below(out)) == 39
