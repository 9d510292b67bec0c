"""Reviewable plans: what goes where, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.text import file_extension, file_name, join_path, parent_dir
from ..operators.template import build_name, output_paths

STRATEGIES = ("first", "hard", "soft")


def outputs(movies: DataFrame, template: str, strategy: str = "first", id_col: str = "group_id", movie_col: str = "movie", fallback_col: str = "input_stem") -> DataFrame:
    """Output places of each record: id, output_ord (0 is primary), dir, file_base. Only the first unless linked."""
    if strategy not in STRATEGIES:
        raise PlanError(f"unknown strategy {strategy!r}; expected one of {', '.join(STRATEGIES)}")
    paths = output_paths(template, F.col(movie_col), F.col(fallback_col))
    paths = F.slice(paths, 1, 1) if strategy == "first" else paths
    # There is always a path; from an inner explode Spark would infer a filter, which works out all paths once more.
    rows = movies.select(id_col, F.posexplode_outer(paths).alias("output_ord", "path"))
    return rows.select(id_col, "output_ord", parent_dir(F.col("path")).alias("dir"), file_name(F.col("path")).alias("file_base"))


def _in(base: Column, extension: Column) -> Column:
    return join_path(F.col("dir"), build_name(base, extension))


def targets(places: DataFrame, groups: DataFrame, subtitles: DataFrame, images: DataFrame | None = None, id_col: str = "group_id") -> DataFrame:
    """Target files of each place: id, output_ord, kind (video, subtitle, image, nfo), ord, source, target."""
    base = F.col("file_base")
    parts = groups.select(id_col, F.posexplode("parts").alias("ord", "p"))
    # There is a place for each group, which Spark may take for few rows and broadcast, through the driver.
    all_places = places.hint("merge")
    video = all_places.join(parts, id_col).select(id_col, "output_ord", F.lit("video").alias("kind"), "ord", F.col("p.path").alias("source"), _in(F.concat(base, "p.output_suffix"), file_extension(F.col("p.path"))).alias("target"))
    ranked = subtitles.withColumn("ord", F.row_number().over(Window.partitionBy(id_col).orderBy("sort_key", F.split("path", "/"))) - 1)
    subtitle = all_places.join(ranked, id_col).select(id_col, "output_ord", F.lit("subtitle").alias("kind"), "ord", F.col("path").alias("source"), _in(F.concat(base, "target_base"), file_extension(F.col("path"))).alias("target"))
    nfo = places.select(id_col, "output_ord", F.lit("nfo").alias("kind"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("source"), _in(base, F.lit("nfo")).alias("target"))
    out = video.unionByName(subtitle).unionByName(nfo)
    if images is not None:
        image = all_places.join(images.where("is_first and action = 'fetch'").select(id_col, "ord", "url", "file_name"), id_col)
        out = out.unionByName(image.select(id_col, "output_ord", F.lit("image").alias("kind"), "ord", F.col("url").alias("source"), join_path(F.col("dir"), F.col("file_name")).alias("target")))
    return out


def actions(all_targets: DataFrame, strategy: str = "first", id_col: str = "group_id") -> DataFrame:
    """Steps of the plan: id, step, action, source, target.

    Parts move to the primary place, then subtitles; the record is written there; each
    extra place is linked to the primary one's files, kind by kind.
    """
    rank = F.create_map(*[F.lit(x) for p in (("video", 0), ("subtitle", 1), ("image", 2), ("nfo", 3)) for x in p])[F.col("kind")]
    rows = all_targets.withColumn("rank", rank)
    does = F.when(F.col("kind").isin("video", "subtitle"), "move").when(F.col("kind") == "image", "fetch").otherwise("write")
    primary = rows.where("output_ord = 0")
    done = primary.select(id_col, "output_ord", "rank", "ord", does.alias("action"), "source", "target")
    if strategy != "first":
        linked = rows.where("output_ord > 0").join(primary.select(id_col, "kind", "ord", F.col("target").alias("from")), [id_col, "kind", "ord"])
        done = done.unionByName(linked.select(id_col, "output_ord", "rank", "ord", F.lit(f"{strategy}link").alias("action"), F.col("from").alias("source"), "target"))
    step = F.row_number().over(Window.partitionBy(id_col).orderBy("output_ord", "rank", "ord")) - 1
    return done.select(id_col, step.cast("long").alias("step"), "action", "source", "target")


def without_present(plan: DataFrame, existing: DataFrame, id_col: str = "group_id") -> DataFrame:
    """The plan without fetches of images whose target exists (existing: path); steps are numbered anew."""
    from ..operators.images import images_to_fetch

    fetches = plan.where("action = 'fetch'").select(*plan.columns, F.lit(True).alias("is_first"), parent_dir(F.col("target")).alias("dir"), file_name(F.col("target")).alias("file_name"))
    present = existing.select(parent_dir(F.col("path")).alias("dir"), file_name(F.col("path")).alias("file_name")).distinct()
    left = plan.where("action <> 'fetch'").unionByName(images_to_fetch(fetches, present).select(*plan.columns))
    return left.withColumn("step", F.row_number().over(Window.partitionBy(id_col).orderBy("step")).cast("long") - 1)


def conflicts(plan: DataFrame, existing: DataFrame, id_col: str = "group_id") -> DataFrame:
    """Targets that exist already (existing: path) or that several steps share: id, target, reason.

    A step whose source is its target is none."""
    real = plan.where("source is null or source <> target")
    there = real.join(existing.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select(id_col, "target", F.lit("exists").alias("reason"))
    shared = real.groupBy("target").count().where("count > 1").select("target")
    twice = real.join(shared, "target", "left_semi").select(id_col, "target", F.lit("shared").alias("reason"))
    return there.unionByName(twice).distinct()


def preflight(plan: DataFrame, existing: DataFrame, id_col: str = "group_id") -> None:
    """Raises if the plan has conflicts; names the first few."""
    if found := conflicts(plan, existing, id_col).orderBy("target").limit(5).collect():
        raise PlanError("; ".join(f"{r.target}: {r.reason}" for r in found))
