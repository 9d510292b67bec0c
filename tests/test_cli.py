"""The command line and the watched directory, end to end."""

import json

import pytest

from pagequarry import cli
from pagequarry.config import resolve
from pagequarry.sources import registry
from pagequarry.streaming.local import watch_directory

SCRIPT = """
from pagequarry.sources.registry import source

@source("demo", ["https://demo.example/"])
def demo(name, path=None):
    return {"title": name.upper(), "genre": ["G"]}

@source("demo", [])
def again(name, path=None):
    return None
"""


@pytest.fixture
def script(tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "SOURCES", found := [])
    monkeypatch.setattr(cli, "SOURCES", found)
    monkeypatch.chdir(tmp_path)
    p = tmp_path / "demo.py"
    p.write_text(SCRIPT)
    return str(p)


def test_modes(spark, tmp_path, script, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a film.mkv").write_text("v")
    (tmp_path / "in/a film.en.srt").write_text("s")
    assert cli.main(["scripts", "--source", script]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == {"total": 2, "active": 1, "ignored": 1} and lines[2]["duplicate_alias_ignored"]
    registry.SOURCES.clear()
    assert cli.main(["name", "--source", script, "some name"]) == 0
    assert "<title>SOME NAME</title>" in capsys.readouterr().out
    registry.SOURCES.clear()
    assert cli.main(["file", "--source", script, "--output", "{genre}/{title}", str(tmp_path / "in/a film.mkv")]) == 0
    steps = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(s["action"], s["target"]) for s in steps] == [("move", "G/A FILM.mkv"), ("move", "G/A FILM.en.srt"), ("write", "G/A FILM.nfo")]
    registry.SOURCES.clear()
    assert cli.main(["dir", "--source", script, "--output", "{title}", "--apply", str(tmp_path / "out"), str(tmp_path / "in")]) == 0
    assert (tmp_path / "out/A FILM.mkv").read_text() == "v" and "<genre>G</genre>" in (tmp_path / "out/A FILM.nfo").read_text()
    registry.SOURCES.clear()
    assert cli.main(["dir", "--source", script, str(tmp_path / "none")]) == 1 and "not a directory" in capsys.readouterr().err
    registry.SOURCES.clear()
    assert cli.main(["name", "x"]) == 1


def found(capsys, key):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{") and key in json.loads(x)]


def events(tmp_path):
    """(kind, file name) of the log, in order."""
    return [(e["kind"], e["path"].rpartition("/")[2]) for f in sorted((tmp_path / "state/events").glob("*.json")) for e in map(json.loads, f.read_text().splitlines())]


def test_watch_directory(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b-CD1.mkv").write_text("v")
    (tmp_path / "in/b-CD2.mkv").write_text("w")
    src = [registry.Source("s", (), lambda name, path=None: {"title": "T " + name})]
    watch = lambda *wanted: watch_directory(spark, str(tmp_path / "in"), src, resolve({}, "watch", {"output": "{title}"}), None, 120, str(tmp_path / "state"), lambda: set(wanted) <= set(events(tmp_path)))
    watch(("done", "b-CD1.mkv"), ("done", "b-CD2.mkv"))
    steps = found(capsys, "target")
    assert ("move", "T b.part01.mkv") in [(s["action"], s["target"]) for s in steps] and len({s["target"] for s in steps}) == 3
    kinds = [k for k, _ in events(tmp_path)]
    assert kinds.count("startup") == 2 and "failed" not in kinds
    # A restart knows what is done, and forgets what is gone.
    (tmp_path / "in/b-CD2.mkv").unlink()
    (tmp_path / "in/c.mkv").write_text("c")
    watch(("done", "c.mkv"), ("remove", "b-CD2.mkv"))
    assert {s["target"] for s in found(capsys, "target")} == {"T c.mkv", "T c.nfo"}


def test_watch_retries_and_waits_for_locks(spark, tmp_path, capsys):
    """A source that fails at first is tried again; a locked file is not touched until it is free."""
    import fcntl

    (tmp_path / "in").mkdir()
    (tmp_path / "in/flaky.mkv").write_text("v")
    (tmp_path / "in/held.mkv").write_text("w")
    mark = str(tmp_path / "tried")

    def run(name, path=None):
        import os

        if name == "flaky" and not os.path.exists(mark):
            open(mark, "w").close()
            raise ValueError("not yet")
        return {"title": "T " + name}

    with open(tmp_path / "in/held.mkv") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        watch_directory(spark, str(tmp_path / "in"), [registry.Source("s", (), run)], resolve({}, "watch", {"output": "{title}"}), str(tmp_path / "out"), 120, str(tmp_path / "state"), lambda: {("remove", "flaky.mkv"), ("busy", "held.mkv")} <= set(events(tmp_path)))
    out = capsys.readouterr().out
    assert "not yet" in out and (tmp_path / "out/T flaky.mkv").read_text() == "v" and not (tmp_path / "in/flaky.mkv").exists()
    kinds = events(tmp_path)
    assert ("failed", "flaky.mkv") in kinds and ("done", "flaky.mkv") in kinds
    assert ("busy", "held.mkv") in kinds and ("done", "held.mkv") not in kinds and (tmp_path / "in/held.mkv").exists()


def test_lister_and_states(tmp_path):
    from pagequarry.streaming.local import Lister, in_use
    from pagequarry.streaming.watch import due, step

    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.mkv").write_text("1")
    (tmp_path / "d/e/b.mkv").write_text("22")
    look = lambda x: sorted((p.rpartition("/")[2], kind, n) for p, kind, n, _ in x.look())
    one, flat = Lister(str(tmp_path / "d"), memory=str(tmp_path / "seen.json")), Lister(str(tmp_path / "d"), 0)
    assert look(one) == [("a.mkv", "startup", 1), ("b.mkv", "startup", 2)] and look(flat) == [("a.mkv", "startup", 1)] and look(one) == []
    (tmp_path / "d/a.mkv").write_text("333")
    (tmp_path / "d/c.mkv").write_text("4")
    (tmp_path / "d/e/b.mkv").unlink()
    assert look(one) == [("a.mkv", "modify", 3), ("b.mkv", "remove", None), ("c.mkv", "create", 1)]
    (tmp_path / "d/c.mkv").unlink()
    assert look(Lister(str(tmp_path / "d"), memory=str(tmp_path / "seen.json"))) == [("a.mkv", "startup", 3), ("c.mkv", "remove", None)]
    assert in_use(str(tmp_path / "none")) and not in_use(str(tmp_path / "d/a.mkv"))
    state, _ = step((5, 0, 0, True), "busy", None, 9000)
    assert state == (5, 0, 10_000, False) and due(state) == 10_000 and step(None, "busy", None, 1) == (None, None)


def test_first_failure_ends_a_batch(spark, tmp_path):
    from pagequarry.plans.effects import carry_out

    for k in "abc":
        (tmp_path / k).write_text(k)
    rows = [("1", 0, "move", str(tmp_path / "a"), "x/a"), ("2", 0, "move", str(tmp_path / "gone"), "x/g"), ("2", 1, "move", str(tmp_path / "b"), "x/b"), ("3", 0, "move", str(tmp_path / "c"), "x/c")]
    plan = spark.createDataFrame(rows, "group_id string, step long, action string, source string, target string")
    done = carry_out(plan, str(tmp_path / "out"), keep_going=False)
    assert [(g, n, e is None) for g, n, e in done] == [("1", 1, True), ("2", 0, False)] and (tmp_path / "c").exists()
    done = carry_out(plan.where("group_id > 1"), str(tmp_path / "out"))
    assert [(g, n, e is None) for g, n, e in done] == [("2", 0, False), ("3", 1, True)] and (tmp_path / "out/x/c").exists() and (tmp_path / "b").exists()


def test_images_are_not_fetched_twice(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mkv").write_text("v")
    asked = str(tmp_path / "asked")

    def image(url, trusted):  # runs in a worker
        with open(asked, "a") as f:
            f.write(f"{url} {trusted}\n")
        return b"image"

    monkeypatch.setattr(cli, "fetch", image)
    monkeypatch.setattr(cli, "SOURCES", [registry.Source("s", ("https://i.example/",), lambda name, path=None: {"title": "T", "thumb": {"@aspect": None, "@preview": "https://i.example/p.png", "$text": "https://i.example/a.jpg"}})])
    monkeypatch.chdir(tmp_path)
    (tmp_path / "pagequarry.toml").write_text("save-images = true\noutput = '{title}'\npriority-details = ['s', 'nobody']\n")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/T-poster.jpg").write_text("old")
    assert cli.main(["dir", "--apply", str(tmp_path / "out"), str(tmp_path / "in")]) == 0
    assert open(asked).read().splitlines() == ["https://i.example/p.png ['https://i.example/']"]
    assert (tmp_path / "out/T-poster.jpg").read_text() == "old" and (tmp_path / "out/T-poster-preview.png").read_text() == "image"


def test_unknown_aliases_are_told(spark, caplog, monkeypatch):
    monkeypatch.setattr(cli, "SOURCES", [registry.Source("s", (), len)])
    with caplog.at_level("WARNING"):
        cli.warn_unknown(spark, resolve({}, "dir", {"priority_images": ["s"], "priority_details": ["x", "s", "y", "x"]}))
    assert [r.getMessage() for r in caplog.records] == ["priority of details names sources that there are not: x, y"]


def test_throttle_and_task_in_runs(spark, tmp_path):
    """Runs of one source pause between each other; what they log names their task."""
    import time

    from pagequarry.sources import tasklog

    def run(name, path=None):
        import io
        import logging
        import time

        from pagequarry.sources.tasklog import log

        out = io.StringIO()
        handler = logging.StreamHandler(out)
        logging.getLogger("pagequarry.source").addHandler(handler)
        log.warning("at work")
        logging.getLogger("pagequarry.source").removeHandler(handler)
        return {"title": out.getvalue().strip(), "plot": str(time.time())}

    names = spark.createDataFrame([(f"e{k}", f"n{k}", None) for k in range(3)], "entity_id string, name string, path string").coalesce(1)
    rows = registry.run_sources(names, [registry.Source("slow", (), run)], None, throttle_ms=700, kind="dir").collect()
    at = sorted(float(r.movie.plot) for r in rows)
    assert sorted(r.movie.title for r in rows) == [f"[dir e{k}] at work" for k in range(3)] and all(b - a > 0.55 for a, b in zip(at, at[1:]))
    names = spark.createDataFrame([(f"e{k}", f"n{k}", None) for k in range(8)], "entity_id string, name string, path string").repartition(8)
    rows = registry.run_sources(names, [registry.Source("slow", (), run)], None, throttle_ms=400, workers=4).collect()
    at = sorted(float(r.movie.plot) for r in rows)  # of four workers, as near as of one
    assert len(at) == 8 and all(b - a > 0.38 for a, b in zip(at, at[1:]))
    with tasklog.task(7, "name"):
        assert tasklog.log.process("x", {}) == ("[name 7] x", {"extra": {"task_id": "7", "task_type": "name"}})
    began = time.monotonic()
    registry.run_sources(names, [registry.Source("slow", (), run)], None).collect()
    assert time.monotonic() - began < 30


def test_fetch_over_a_local_server():
    import http.server
    import threading

    from pagequarry.errors import NotEnabled, RequestRefused, SourceError

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            if self.path.startswith("/moved"):
                self.send_response(302)
                self.send_header("Location", self.path.partition("?")[2])
                return self.end_headers()
            self.send_response(404 if self.path == "/none" else 429 if self.path == "/slow" else 200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.answer(f"{self.path} {self.headers['User-Agent']} {self.headers.get('X-A')} é".encode())

        def do_POST(self):
            self.answer(b"got " + self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        trusted = [base + "/"]
        assert registry.fetch_text(base + "/x?y", trusted, {"X-A": "1"}) == f"/x?y {registry.USER_AGENT} 1 é"
        assert registry.fetch(base + "/p", trusted, {"headers": {"X-A": "1"}, "version": "1.1"}, post=b"\x00body") == b"got \x00body"
        assert registry.fetch_text(base + "/moved?" + base + "/z", trusted).startswith("/z ")
        for path, why in (("/none", "404, check"), ("/slow", "429, too many")):
            with pytest.raises(SourceError, match=why):
                registry.fetch(base + path, trusted)
        for url, why in ((base + "/moved?http://other.example/", "redirect, untrusted"), ("https://other.example/", "untrusted"), ("ftp://a/b", "scheme"), ("nothing", "invalid"), ("http://", "host")):
            with pytest.raises(RequestRefused, match=why):
                registry.fetch(url, trusted)
        with pytest.raises(NotEnabled):
            registry.fetch(base + "/", trusted, {"version": "2"})
        token = registry.CHECKING.set(True)
        with pytest.raises(NotEnabled, match="checked"):
            registry.fetch(base + "/", trusted)
        registry.CHECKING.reset(token)
    finally:
        server.shutdown()


def test_cookies_are_checked():
    from pagequarry.errors import NotEnabled, SourceError
    from pagequarry.sources import browser

    assert browser.cookies([]) == [] and browser.cookies([{"name": "a", "value": "", "expires": 3, "other": 1}]) == [browser.Cookie("a", "", expires=3.0)]
    for bad, why in (
        ("x", "must be a list, not str"), ({"name": "a"}, "must be a list, not dict"), ([1], "cookie 1 must be a table, not int"), ([{"name": "a", "value": "b"}, {"value": "b"}], "cookie 2 has no name"), ([{"name": "a"}], "has no value"),
        ([{"name": 1, "value": "b"}], "name must be a text, not int"), ([{"name": "a", "value": "b", "secure": 1}], "secure must be a truth value, not int"), ([{"name": "a", "value": "b", "expires": True}], "expires must be a number, not bool"),
    ):
        with pytest.raises(SourceError, match=why):
            browser.cookies(bad)
    assert list(browser.told([{"session": True, "name": "a"}])[0]) == ["name", "value", "domain", "path", "expires", "secure", "http_only", "session"]
    with pytest.raises(NotEnabled):
        browser.session()


def test_addresses_alike_with_and_without_spark(spark):
    from pyspark.sql import functions as F

    from pagequarry.functions.urls import check_request, why_refused

    rules = ["https://*.example.com/en/", "https://m.example.net/*/25", "http://plain.example:8080", "https://u.example:443/a"]
    urls = [
        "https://a.example.com/en/x", "https://example.com/en/", "https://a.b.example.com/en/", "HTTPS://A.EXAMPLE.com:443/en/?q", "https://a.example.com:444/en/", "https://m.example.net/x/25", "https://m.example.net/x/y/25", "http://plain.example:8080", "http://plain.example/",
        "https://me@u.example/abc", "https://u.example:/a", "ftp://a/", "http:///x", "x", "", None, "https://m.example.net//25", "http://plain.example:8080.evil.example/",
    ]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", check_request(F.col("u"), rules).alias("w")).collect()
    assert [(r.u, r.w) for r in rows] == [(u, why_refused(u, rules)) for u in urls]
