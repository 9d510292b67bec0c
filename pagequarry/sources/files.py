"""Listings of directories as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.text import is_video


def depth_under(path: Column, root: str) -> Column:
    """Directories between the root and the file; negative for files elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.size(F.split(F.substr(path, F.lit(len(top) + 1)), "/")) - 1).otherwise(-1)


def scan_files(spark: SparkSession, root: str, max_depth: int = -1) -> DataFrame:
    """path, length and modified of the files under a directory; no content is read.

    max_depth: 0 for the root alone, -1 for all. Links to files are listed as files.
    """
    if max_depth < -1:
        raise ConfigError(f"depth must be -1 or more, not {max_depth}")
    if "://" not in root and not os.path.isdir(root):
        raise ConfigError(f"not a directory: {root}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), r"^file:/*(?=/)", "") if "://" not in root else F.col("path")
    rows = files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"))
    deep = depth_under(F.col("path"), root)
    return rows.where(deep >= 0) if max_depth < 0 else rows.where((deep >= 0) & (deep <= max_depth))


def scan_videos(spark: SparkSession, root: str, max_depth: int = -1) -> DataFrame:
    return scan_files(spark, root, max_depth).where(is_video(F.col("path")))


def existing_below(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below the root, relative to it and absolute, as targets may be either."""
    top = os.path.abspath(root).rstrip("/") + "/"
    found = existing_targets(spark, [top])
    return found.unionByName(found.select(F.substr("path", F.lit(len(top) + 1)).alias("path")))


def existing_targets(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path of every file under the roots that exist."""
    out = spark.createDataFrame([], "path string")
    for r in roots:
        if "://" in r or os.path.isdir(r):
            out = out.unionByName(scan_files(spark, r).select("path"))
    return out
