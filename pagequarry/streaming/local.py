"""Watching a directory: its changes as a log of events, and a plan for each group that settles.

A lister compares the directory with what it last saw and appends what changed to a log
of small files; outcomes of plans are appended to the same log. The log is a file
stream, so state, retries and restarts are those of the engine: with a state folder
that stays, a restart goes on where the last run ended.
"""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import ConfigError
from ..plans.library import plan_library
from ..sources.files import existing_below, scan_files
from ..sources.registry import Source, fetch, trusted_union
from ..sources.tables import shared_folder
from .watch import TICK_MS, ready_groups, relevant, start, watch

log = logging.getLogger("pagequarry.watch")
EVENT = "path string, kind string, length long, at_ms long"


class EventLog:
    """A folder of files with one event a line; a file appears whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def append(self, events: list[tuple]) -> None:
        if events:
            name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
            with open(os.path.join(self.folder, f".{name}"), "w", encoding="utf-8") as f:
                f.writelines(json.dumps(dict(zip(("path", "kind", "length", "at_ms"), e))) + "\n" for e in events)
            os.rename(os.path.join(self.folder, f".{name}"), os.path.join(self.folder, name))

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(EVENT).json(self.folder)


class Lister:
    """Tells what changed below a root since it last looked; what it saw is kept in a file, if there is one."""

    def __init__(self, root: str, max_depth: int = -1, memory: str | None = None):
        self.root, self.max_depth, self.memory, self.first = root, max_depth, memory, True
        self.known: dict[str, list] = {}
        if memory and os.path.exists(memory):
            with open(memory, encoding="utf-8") as f:
                self.known = json.load(f)

    def _files(self, folder: str, depth: int = 0) -> Iterator[tuple[str, list]]:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if self.max_depth < 0 or depth < self.max_depth:
                            yield from self._files(e.path, depth + 1)
                    elif e.is_file():
                        s = e.stat()
                        yield e.path, [s.st_size, s.st_mtime_ns]
                except FileNotFoundError:
                    continue  # gone since it was listed
                except OSError as err:
                    log.info("cannot look at %s: %s", e.path, err)

    def look(self) -> list[tuple]:
        """Events (path, kind, length, at_ms): startup for all files at the first look, then create, modify, remove."""
        if not os.path.isdir(self.root):
            raise ConfigError(f"not a directory any more: {self.root}")
        now, seen = int(time.time() * 1000), dict(self._files(self.root))
        kind = lambda p: "startup" if self.first else "create" if p not in self.known else "modify"
        events = [(p, kind(p), v[0], now) for p, v in seen.items() if self.first or self.known.get(p) != v]
        events += [(p, "remove", None, now) for p in self.known if p not in seen]
        if self.memory and (events or self.first):
            with open(self.memory + ".new", "w", encoding="utf-8") as f:
                json.dump(seen, f)
            os.replace(self.memory + ".new", self.memory)
        self.known, self.first = seen, False
        return events


def in_use(path: str) -> bool:
    """Whether the file is gone or another process has locked it."""
    try:
        import fcntl

        with open(path, "rb") as f:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            fcntl.flock(f, fcntl.LOCK_UN)
        return False
    except ImportError:
        return False
    except OSError:
        return True


def _state_folder(spark: SparkSession, folder: str | None) -> str:
    if folder:
        return os.path.abspath(folder)
    where = shared_folder(spark)
    if not where.startswith(("file:", "/")):
        raise ConfigError("the log of a watched directory needs a folder that the driver can write to; name one by --state")
    return os.path.join(re.sub(r"^file:/*(?=/)", "", where), f"watch-{uuid.uuid4().hex}")


def watch_directory(spark: SparkSession, root: str, sources: list[Source], settings: Settings, apply_root: str | None, seconds: float | None = None, state: str | None = None, enough: Callable[[], bool] | None = None) -> int:
    """Prints (or carries out) the steps for groups as they become ready; runs until stopped, or for some seconds.

    Files that are there at the start are ready at once. A file that another process has
    locked is looked at again after a tick; a group that fails is reported and tried
    again later, and the others go on. Errors of single files are logged; that the
    root is gone ends the watch, as enough() does when it holds. state: a folder for the log, the listing and the stream's
    checkpoint; without one they are temporary.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held = _state_folder(spark, state)
    events, lister = EventLog(os.path.join(held, "events")), Lister(root, settings.max_depth, os.path.join(held, "listing.json"))

    def handle(statuses: DataFrame, _: int) -> None:
        due = [r.path for r in statuses.where("status = 'ready'").select("path").distinct().toLocalIterator()]
        now = lambda: int(time.time() * 1000)
        busy = {p for p in due if in_use(p)}
        events.append([(p, "busy", None, now()) for p in busy])
        ready = [(p, "ready") for p in due if p not in busy]
        if not ready:
            return
        files = scan_files(spark, root, settings.max_depth)
        groups = ready_groups(spark.createDataFrame(ready, "path string, status string"), files)
        near = files.join(groups.select(F.explode("parts.path").alias("path")).distinct(), "path", "left_semi")
        done = plan_library(near, sources, settings, listed=files, existing=existing_below(spark, apply_root) if apply_root else None)
        parts = {r.group_id: list(r.paths) for r in done.groups.select("group_id", F.col("parts.path").alias("paths")).toLocalIterator()}
        failed = {r.group_id: r.error for r in done.failures.toLocalIterator()}
        try:
            if apply_root:
                from ..plans.effects import carry_out

                trusted = trusted_union(sources)
                results = carry_out(done.actions, apply_root, done.records, lambda url: fetch(url, trusted))
                for group, steps, error in results:
                    print(json.dumps({"group": group, "steps": steps, "error": error}))
                    if error:
                        failed[group] = error
            else:
                for r in done.actions.orderBy("group_id", "step").toJSON().toLocalIterator():
                    print(r)
        except Exception as e:  # a plan that cannot be begun fails all its groups
            failed |= {g: failed.get(g, str(e)) for g in parts}
        for group, error in failed.items():
            print(f"{group}: {error}")
        events.append([(p, "failed" if g in failed else "done", None, now()) for g, paths in parts.items() for p in paths])

    stop, wrong = threading.Event(), []

    def poll() -> None:
        while not stop.is_set():
            try:
                events.append(lister.look())
            except ConfigError as e:
                wrong.append(e)
                return
            except OSError as e:
                log.info("cannot list %s: %s", root, e)
            stop.wait(TICK_MS / 1000)

    events.append(lister.look())
    poller = threading.Thread(target=poll, daemon=True)
    query = start(watch(relevant(events.stream(spark), root, settings.max_depth)), os.path.join(held, "checkpoint"), handle)
    poller.start()
    until = None if seconds is None else time.monotonic() + seconds
    try:
        while query.isActive and not wrong and (until is None or time.monotonic() < until) and not (enough and enough()):
            query.awaitTermination(1)
    finally:
        stop.set()
        poller.join()
        if query.isActive:
            query.stop()
    if wrong:
        raise wrong[0]
    return 0
