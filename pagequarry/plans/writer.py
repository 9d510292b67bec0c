"""Plans carried out by Spark's tasks in two phases, a group at a time.

Targets are checked by joins. In the first phase each group's records and images are
written beside their targets under names of their own, and sources are looked at; what
went well is stored. In the second the groups that are staged in full move into place step by step;
a step that fails takes back those before it, so a group is there in full or not at
all. Both phases can run again after a lost task: staged names depend on the group and step only,
and a step whose result stands is not done twice. No step, record or outcome passes
the driver. A file in the shared folder stops the rest of a phase after a failure, if so wanted:
groups that have begun or are staged end, no other begins.
"""

from __future__ import annotations

import errno
import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, NotEnabled, PlanError
from ..sources.tables import shared_folder, stored
from .output import conflicts

_STEP = "step long, action string, source string, target string, nfo string"


def _staged(group: str, step: int, target: str) -> str:
    name = hashlib.sha256(f"{group}\0{step}".encode()).hexdigest()[:32]
    return os.path.join(os.path.dirname(target), f".{name}.staged")


def _free(path: str) -> None:
    """Raises if the file is not there or another process has locked it."""
    with open(path, "rb") as f:
        try:
            import fcntl

            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except ImportError:
            return
        except BlockingIOError:
            raise PlanError(f"{path}: in use") from None


def _rename(source: str, target: str) -> None:
    """To a place that must be free, across devices if need be."""
    if os.path.lexists(target):
        raise PlanError(f"{target}: exists")
    try:
        os.rename(source, target)
    except OSError as e:
        if e.errno != errno.EXDEV:
            raise
        shutil.copy2(source, target)
        os.unlink(source)


def _stage(group: str, steps: list[dict], fetch: Callable[[str], bytes] | None) -> None:
    made, coming = [], {s["target"] for s in steps}
    try:
        for s in steps:
            os.makedirs(os.path.dirname(s["target"]), exist_ok=True)
            if s["action"] == "move":
                if not (os.path.lexists(s["target"]) and not os.path.lexists(s["source"])):  # else it is done already
                    _free(s["source"])
            elif s["action"] in ("write", "fetch"):
                if s["action"] == "fetch" and fetch is None:
                    raise NotEnabled(f"fetching {s['source']} needs a network")
                body = (s["nfo"] or "").encode() if s["action"] == "write" else fetch(s["source"])
                made.append(_staged(group, s["step"], s["target"]))
                with open(made[-1], "wb") as f:
                    f.write(body)
            elif s["source"] not in coming and not os.path.lexists(s["source"]):
                raise FileNotFoundError(f"{s['source']}: not there")
    except BaseException:
        for path in made:
            if os.path.lexists(path):
                os.unlink(path)
        raise


def _unstage(group: str, steps: list[dict]) -> None:
    for s in steps:
        if s["action"] in ("write", "fetch") and os.path.lexists(path := _staged(group, s["step"], s["target"])):
            os.unlink(path)


def _place(group: str, steps: list[dict]) -> None:
    """Moves a staged group into place, or leaves everything as it was."""
    back: list[tuple[str, str | None]] = []
    try:
        for s in steps:
            target = s["target"]
            source = _staged(group, s["step"], target) if s["action"] in ("write", "fetch") else s["source"]
            if s["action"] in ("move", "write", "fetch"):
                if source != target and not (os.path.lexists(target) and not os.path.lexists(source)):
                    _rename(source, target)
                back.append((target, source))
                continue
            same = os.path.lexists(target) and os.path.lexists(source) and os.path.samefile(source, target)
            if not same:
                if os.path.lexists(target):
                    raise PlanError(f"{target}: exists")
                (os.link if s["action"] == "hardlink" else os.symlink)(source, target)
            back.append((target, None))
    except BaseException:
        for target, source in reversed(back):
            if source is None:
                os.unlink(target)
            elif source != target:
                os.rename(target, source)
        _unstage(group, steps)
        raise


def _local(path: str) -> str:
    if not path.startswith(("file:", "/")):
        raise ConfigError("plans are carried out in folders that workers can write to; set spark.checkpoint.dir to one")
    return re.sub(r"^file:/*(?=/)", "", path)


def carry_out_groups(plan: DataFrame, root: str, existing: DataFrame, records: DataFrame | None = None, fetch: Callable[[str], bytes] | None = None, id_col: str = "group_id", keep_going: bool = True, workers: int = 1) -> DataFrame:
    """Does a plan: id, steps (how many were done) and error of each group that was begun.

    plan: id, step, action, source, target; existing: path of files that are there, as
    targets are written; records: id and nfo, the text of each group. Targets must be new, named once and
    below root, else nothing is begun. workers: how many groups are worked on at a time.
    Repeated rows of a step are a target that is named twice; ids that are null are one group; an empty
    plan does nothing. The outcome is stored, so reading it does nothing again.
    """
    top = os.path.abspath(root) + os.sep
    wrong = conflicts(plan, existing, id_col)
    outside = plan.where(~F.startswith(_absolute(F.col("target"), top), F.lit(top)) | F.col("target").rlike(r"(^|/)\.\.(/|$)"))
    wrong = wrong.select("target", "reason").unionByName(outside.select("target", F.lit(f"outside {root}").alias("reason")))
    if found := wrong.orderBy("target").limit(5).collect():
        raise PlanError("; ".join(f"{r.target}: {r.reason}" for r in found))
    steps = plan.select(id_col, "step", "action", F.when(F.col("action").isin("move", "fetch"), F.col("source")).otherwise(_absolute(F.col("source"), top)).alias("source"), _absolute(F.col("target"), top).alias("target"))
    if records is None:
        steps = steps.withColumn("nfo", F.lit(None).cast("string"))
    else:
        texts = steps.where("action = 'write'").join(records.select(id_col, "nfo"), id_col, "left")
        steps = steps.where("action <> 'write'").withColumn("nfo", F.lit(None).cast("string")).unionByName(texts)
    kind = plan.schema[id_col].dataType
    steps = stored(steps)  # files that have moved must not change the plan
    flags = os.path.join(_local(shared_folder(plan.sparkSession)), f"stopped-{uuid.uuid4().hex}")

    def phase(name: str, rows: DataFrame, does: Callable[[str, list[dict]], None]) -> DataFrame:
        flag = f"{flags}-{name}"

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            each = (row for batch in batches for row in batch.to_pylist())
            for group, own in groupby(each, lambda r: r[id_col]):
                own = list(own)
                if os.path.exists(flag):  # the rest is read, as its rows come anyway, but not begun
                    _unstage(str(group), own)
                    continue
                error = None
                try:
                    does(str(group), own)
                except Exception as e:
                    error = str(e)
                    if not keep_going:
                        os.makedirs(os.path.dirname(flag), exist_ok=True)
                        open(flag, "w").close()
                yield pa.RecordBatch.from_arrays([pa.array([group], batch_type), pa.array([0 if error else len(own)], pa.int64()), pa.array([error], pa.string())], [id_col, "steps", "error"])

        from pyspark.sql.pandas.types import to_arrow_type

        batch_type = to_arrow_type(kind)
        schema = T.StructType([T.StructField(id_col, kind), T.StructField("steps", T.LongType()), T.StructField("error", T.StringType())])
        return stored(rows.repartition(workers, id_col).sortWithinPartitions(id_col, "step").mapInArrow(run, schema))

    staged = phase("stage", steps, lambda group, own: _stage(group, own, fetch))
    ready = steps.join(staged.where("error is null").select(id_col), steps[id_col].eqNullSafe(staged[id_col]), "left_semi")
    done = phase("place", ready, _place)
    return stored(staged.where("error is not null").unionByName(done))


def _absolute(path, top: str):
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(top), path))
