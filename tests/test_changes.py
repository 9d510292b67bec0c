"""The directory source: changes once each, also over replays, killed queries and restarts."""

import os
import time

import pytest

from pagequarry.streaming.changes import DirectoryChanges, Reader, Share


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_replays_tell_the_same(tmp_path):
    root = str(tmp_path / "in")
    a, b = put(root, "a.mkv", "1"), put(root, "d/b.mkv", "22")
    r = Reader({"root": root, "listings": str(tmp_path / "seen"), "tasks": "3", "tick_ms": "1000"})
    told = lambda s, e: sorted(x[:3] for k in range(3) for x in r.read(Share(k, s, e)))
    assert told(0, 5) == [(a, "startup", 1), (b, "startup", 2)]
    os.remove(a)
    c = put(root, "c.mkv", "3")
    assert told(0, 5) == [(a, "startup", 1), (b, "startup", 2)]  # as before, whatever has happened since
    put(root, "d/b.mkv", "4444")
    assert told(5, 6) == [(a, "remove", None), (c, "create", 1), (b, "modify", 4)] == told(5, 6)
    r.commit({"tick": 6})
    assert os.listdir(tmp_path / "seen") == ["6"] and told(6, 7) == []
    flat = Reader({"root": root, "listings": str(tmp_path / "flat"), "depth": "0", "tasks": "1"})
    assert [x[0] for x in flat.read(Share(0, 0, 1))] == [c]
    with pytest.raises(NotADirectoryError):
        Reader({"root": str(tmp_path / "no"), "listings": ""}).latestOffset()


def test_a_killed_query_goes_on(spark, tmp_path):
    spark.dataSource.register(DirectoryChanges)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(root, "a.mkv", "1")
    broken = [True]

    def keep(batch, n):
        if broken and n == 1:
            broken.clear()
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/{n}")

    def run(wanted):
        source = spark.readStream.format("directory_changes").option("root", root).option("listings", str(tmp_path / "seen")).option("tasks", 2).load()
        query = source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
        until = time.time() + 60
        try:
            while query.isActive and time.time() < until and not wanted <= got():
                time.sleep(0.5)
        finally:
            query.stop()

    def got():
        parts = [f"{out}/{n}" for n in (os.listdir(out) if os.path.isdir(out) else ()) if os.path.exists(f"{out}/{n}/_SUCCESS")]
        return {(os.path.basename(r.path), r.kind) for r in spark.read.parquet(*parts).collect()} if parts else set()

    try:
        run({("never", "")})  # ends when the second batch fails
    except Exception:
        pass
    assert not broken
    put(root, "b.mkv", "2")
    os.remove(os.path.join(root, "a.mkv"))
    want = {("a.mkv", "startup"), ("a.mkv", "remove"), ("b.mkv", "create")}
    run(want)
    rows = [r for n in os.listdir(out) for r in spark.read.parquet(f"{out}/{n}").collect()]
    assert sorted((os.path.basename(r.path), r.kind) for r in rows) == sorted(want)
