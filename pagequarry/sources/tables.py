"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError

DEALT_BYTES = 32 << 10  # of a table, as Spark estimates it, for each task
DEALT_TASKS = 16  # for each core, at most


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one a temporary folder if all of Spark runs in one process; on
    a cluster, whose executors would not share it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="pagequarry-")


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt anew to at least as many tasks as there are cores, more for more rows.

    A small file of short rows is read by the few tasks that its row groups allow. What costs far more for each
    row than moving it, as parsing does or many expressions, goes to all cores this way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, min(DEALT_TASKS * cores, size // DEALT_BYTES)))


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: it is computed once, and lost executors read it again. The table stands until its folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
