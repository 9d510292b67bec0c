"""Split video files and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, file_stem, is_video, parent_dir

SPLIT = r"(?i)^(.+?)(?U:[\s._-]*)(cd|disc|disk|part|pt)(?U:[\s._-]*)0*([1-9]\d{0,2})\z"
MARKER = r"(?i)(?:^|[ ._\-\[(]|(?U:\s))(?:cd|disc|disk|part|pt)(?U:[\s._-]*)0*[1-9]\d{0,2}(?:\z|[ ._\-\])]|(?U:\s))"


def split_part(stem: Column) -> Column:
    """struct(base, index) of a stem such as Movie-CD2; null if it is no part."""
    base = F.regexp_replace(F.regexp_extract(stem, SPLIT, 1), r"^[ ._-]+|[ ._-]+\z", "")
    return F.when(stem.rlike(SPLIT) & (base != ""), F.struct(base.alias("base"), F.regexp_extract(stem, SPLIT, 3).cast("int").alias("index")))


def has_split_marker(stem: Column) -> Column:
    return stem.rlike(MARKER)


def group_key(base: Column) -> Column:
    """Letters and digits in lower case, or the ASCII lower-cased base if it has none."""
    plain = F.lower(F.regexp_replace(base, r"[^\p{IsAlphabetic}\p{N}]", ""))
    return F.when(plain == "", ascii_lower(base)).otherwise(plain)


def group_video_inputs(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Groups of split parts; any other file is its own group.

    Returns group_id (the first part's path), input_stem and parts: array of
    struct(path, input_stem, output_suffix) by part number, then path. A lone part
    keeps its whole stem and no suffix. Paths compare by components. One shuffle, on
    the directory and the key of the base name; a group is as large as the files of
    one title in one directory.
    """
    path = F.col("path")
    rows = files.select(F.col(path_col).alias("path")).where(is_video(path)).distinct().withColumn("stem", file_stem(path)).withColumn("part", split_part(F.col("stem")))
    rows = rows.withColumn("dir", F.when(F.col("part").isNotNull(), parent_dir(path)).otherwise(path)).withColumn("key", F.coalesce(group_key(F.col("part.base")), F.lit("")))
    part = F.struct(F.coalesce(F.col("part.index"), F.lit(0)).alias("index"), F.split("path", "/").alias("order"), "path", "stem", F.col("part.base").alias("base"))
    grouped = rows.groupBy("dir", "key").agg(F.array_sort(F.collect_list(part)).alias("p"))
    alone, first = F.size("p") == 1, F.get("p", F.lit(0))
    suffix = lambda x: F.when(alone | x["base"].isNull(), "").otherwise(F.format_string(".part%02d", x["index"]))
    parts = F.transform("p", lambda x: F.struct(x["path"].alias("path"), x["stem"].alias("input_stem"), suffix(x).alias("output_suffix")))
    stem = F.when(alone, first["stem"]).otherwise(F.coalesce(first["base"], first["stem"]))
    return grouped.select(first["path"].alias("group_id"), stem.alias("input_stem"), parts.alias("parts"))


def group_video_paths(files: DataFrame, path_col: str = "path") -> DataFrame:
    """group_id and the paths of each group, in order."""
    return group_video_inputs(files, path_col).select("group_id", F.transform("parts", lambda p: p["path"]).alias("paths"))


def group_of(files: DataFrame, wanted: DataFrame, path_col: str = "path") -> DataFrame:
    """Groups that hold one of the wanted paths, from a listing of their directories."""
    dirs = wanted.select(parent_dir(F.col(path_col)).alias("dir")).distinct()
    near = files.select(F.col(path_col).alias("path"), parent_dir(F.col(path_col)).alias("dir")).join(dirs, "dir", "left_semi")
    groups = group_video_inputs(near)
    held = groups.select("group_id", F.explode("parts.path").alias("path")).join(wanted.select(F.col(path_col).alias("path")), "path", "left_semi").select("group_id").distinct()
    return groups.join(held, "group_id", "left_semi")


def path_order(path: Column | str) -> Column:
    """A sort key that compares paths by components, as a directory listing does."""
    return F.split(path, "/")
