"""Changes of a directory as a streaming source with offsets.

An offset is a tick of the clock. For a micro-batch between two ticks each task lists its
share of the tree and compares it with its listing of the first tick; the listing of the
second is written once, under its tick's name. A batch that runs again, after a lost task or a restart,
finds that listing and tells the same changes, so each is told once. The driver
keeps nothing; listings that no batch can ask for any more are deleted.

    spark.dataSource.register(DirectoryChanges)
    spark.readStream.format("directory_changes").option("root", ...).option("listings", ...).load()

Options: root; listings, a folder that all workers and restarts share; depth (-1: all);
tasks (8): shares of the tree, by a hash of what lies directly under the root; tick_ms.
Rows are path, kind (startup for all that the first tick finds, then create, modify, remove), length
and at_ms, the tick's time.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .watch import TICK_MS

EVENT = "path string, kind string, length long, at_ms long"


@dataclass
class Share(InputPartition):
    """One task's share of the tree between two ticks."""

    bucket: int
    start: int
    end: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.listings = options["root"], options["listings"]
        self.depth, self.tasks, self.tick = int(options.get("depth", -1)), int(options.get("tasks", 8)), int(options.get("tick_ms", TICK_MS))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"not a directory any more: {self.root}")
        return {"tick": int(time.time() * 1000) // self.tick}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(b, start["tick"], end["tick"]) for b in range(self.tasks)]

    def _at(self, tick: int, bucket: int) -> str:
        return os.path.join(self.listings, str(tick), f"{bucket}.json")

    def _seen(self, tick: int, bucket: int) -> dict | None:
        try:
            with open(self._at(tick, bucket), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _files(self, folder: str, depth: int, bucket: int | None) -> Iterator[tuple[str, list]]:
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    if bucket is not None and zlib.crc32(os.fsencode(e.name)) % self.tasks != bucket:
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if self.depth < 0 or depth < self.depth:
                            yield from self._files(e.path, depth + 1, None)
                    elif e.is_file():
                        s = e.stat()
                        yield e.path, [s.st_size, s.st_mtime_ns]
        except FileNotFoundError:
            return  # gone since it was listed; the next tick tells

    def _listed(self, tick: int, bucket: int) -> dict:
        """The listing of a tick: the one that stands, or else what is there now, which then stands."""
        if (seen := self._seen(tick, bucket)) is not None:
            return seen
        at, own = self._at(tick, bucket), f"{self._at(tick, bucket)}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(own, "w", encoding="utf-8") as f:
            json.dump(dict(self._files(self.root, 0, bucket)), f)
        try:
            os.link(own, at)  # fails if another attempt was first
        except FileExistsError:
            pass
        finally:
            os.unlink(own)
        return self._seen(tick, bucket)

    def read(self, partition: Share) -> Iterator[tuple]:
        before = self._seen(partition.start, partition.bucket) if partition.start else None
        after = self._listed(partition.end, partition.bucket)
        known, when = before or {}, partition.end * self.tick
        for path, value in sorted(after.items()):
            if known.get(path) != value:
                yield path, "startup" if before is None else "modify" if path in known else "create", value[0], when
        for path in sorted(known.keys() - after.keys()):
            yield path, "remove", None, when

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.listings) if os.path.isdir(self.listings) else ():
            if name.isdigit() and int(name) < end["tick"]:
                shutil.rmtree(os.path.join(self.listings, name), ignore_errors=True)


class DirectoryChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)
