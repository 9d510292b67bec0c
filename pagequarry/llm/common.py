"""Shared pieces: tables in the shared folder, Arrow batch mapping, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_TEMPORARY: dict[str, str] = {}  # the folder of each application that has no other


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder if all of
    Spark runs in one process; on a cluster executors would not share it, so that is an error."""
    own = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _TEMPORARY.get(own)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _TEMPORARY[own] = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
    return found.rstrip("/")


_WRITTEN: dict[str, set[str]] = {}  # tables of each application that still stand
_COLLECTED: ContextVar[list | None] = ContextVar("collected", default=None)


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """The list of tables that materialize() writes inside, so that they can be discarded."""
    made: list[DataFrame] = []
    token = _COLLECTED.set(made)
    try:
        yield made
    finally:
        _COLLECTED.reset(token)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: it cuts the
    lineage, is computed once, and outlives any executor. The table stands until
    discard() or discard_all(), as results that read it may be used at any time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagequarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagequarry_path = path
    if (made := _COLLECTED.get()) is not None:
        made.append(out)
    return out


BROADCAST_ROWS = 500_000  # of narrow rows that may be broadcast, some hundred bytes each in memory


def small_side(table: DataFrame) -> DataFrame:
    """A written table of narrow rows as a side of a join: broadcast if a count shows that it is small, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._pagequarry_path)


def discard_all(spark: SparkSession) -> None:
    """Deletes all tables that materialize() wrote for this application; call it when the results are used up."""
    for path in list(_WRITTEN.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


BATCH_BYTES = 4_000_000  # of rows sent to a Python worker at once, however long the texts
READ_ROWS = 512  # that a scan decodes at once, as texts are long


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session that scans and sends long texts in small batches, bounded by bytes as well as rows."""
    for name, most, default in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, 2**31 - 1), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS, 4096)):
        if int(df.sparkSession.conf.get(name, str(default))) > most:
            df.sparkSession.conf.set(name, str(most))
    return df


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where f gives the new columns of each batch as lists or arrays."""
    fields = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                cols = [out[x.name] if isinstance(out[x.name], (pa.Array, pa.ChunkedArray)) else pa.array(out[x.name], x.type) for x in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(x.type) if c.type != x.type else c for c, x in zip(cols, arrow)], schema=arrow)

    return bounded(df).mapInArrow(run, schema)


def apart(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span touches none of the given ones, by bisection, so that many of either cost no square."""
    spans = sorted(spans)
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or ends[k - 1] <= start

    return free


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def id_type(df: DataFrame, id_col: str) -> str:
    """The type that an operator returns ids in: long for numbers, else their own (a struct as a row key)."""
    own = df.select(id_col).schema[0].dataType
    return "long" if isinstance(own, (T.NumericType, T.NullType)) else own.simpleString()


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, so no other name can clash."""
    return df.select(F.col(id_col).cast(id_type(df, id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of each node that has an edge.

    edges: columns u and v (long); self loops, nulls and repeated rows are ignored.
    Alternates the large-star and small-star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond", until the edge set stays. Each step is a
    min aggregation (combined before the shuffle) and a join. The minima are dealt anew
    before the join, so both its sides are exchanges and Spark can split the rows of a
    node that has very many neighbours; no task has to read them all. The edges are written once a round. Returns node, component.
    """

    def turned(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(turned(edges.select("u", "v")))
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = turned(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("rebalance"), "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(turned(small.unionByName(least.select("u", F.col("m").alias("v")))))
        discard(before)
        now = mark(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
