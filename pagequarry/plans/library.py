"""The whole flow: files to groups, names, records, places and steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import TranslationError
from ..functions.text import format_input_name
from ..operators.images import local_images, movie_images, name_images
from ..operators.mapping import Mapper, map_movies
from ..operators.movie import from_nfo, limit_sources, merge_sources, nfo_output, success_limit, to_nfo
from ..operators.parts import group_of, group_video_inputs
from ..operators.subtitles import match_subtitles
from ..operators.translate import Translate, endpoint, resolve_keys, translate_movies
from ..sources.registry import Source, run_sources
from ..sources.tables import stored
from .output import actions, outputs, targets, without_present


@dataclass
class Planned:
    """groups, records (group_id, movie, nfo), failures (group_id, error) and the steps."""

    groups: DataFrame
    records: DataFrame
    failures: DataFrame
    actions: DataFrame


def resolve_records(names: DataFrame, sources: list[Source], settings: Settings, translate: Translate | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs the sources on names (entity_id, name, path), then merges, maps and translates: (entity_id, movie, nfo), failures, attempts.

    Sources run once: the attempts are written to the shared folder, as runs may fetch.
    """
    configured = bool(settings.priority_details or settings.priority_images)
    limit = success_limit(settings.multi_source, settings.multi_source_max_sources, configured)
    tried = stored(run_sources(names, sources, limit, settings.throttle_ms if settings.throttle else 0, workers=settings.fetch_threads))
    good = limit_sources(tried, limit)
    good = good.withColumn("movie", F.coalesce("movie", from_nfo(F.col("raw_xml"))))
    merged = merge_sources(good, settings.priority_details, settings.priority_images, settings.multi_source)
    raw = good.groupBy("entity_id").agg(F.min_by("raw_xml", "source_ord").alias("raw"))
    rules = []
    for path in settings.node_mapping:
        with open(path, encoding="utf-8") as f:
            rules.append(f.read())
    mapper = Mapper(rules)
    changed: Column = (F.col("n_sources") > 1) | F.lit(bool(mapper.rules))
    out = merged.join(raw, "entity_id").withColumn("movie", map_movies(F.col("movie"), mapper))
    if resolve_keys(settings.translate):
        if not settings.target_lang:
            raise TranslationError("translation needs a target language")
        out = translate_movies(out.withColumn("_changed", changed), settings.translate, settings.target_lang, translate or endpoint(settings.endpoint))
        changed = F.col("_changed") | F.col("changed")
    out = out.select("entity_id", "movie", nfo_output(F.col("raw"), F.col("movie"), changed).alias("nfo"))
    failed = tried.join(good.select("entity_id").distinct(), "entity_id", "left_anti").groupBy("entity_id").agg(F.max_by("error", "source_ord").alias("error"))
    return out, failed, tried


def plan_names(names: DataFrame, sources: list[Source], settings: Settings, translate: Translate | None = None) -> DataFrame:
    return resolve_records(names, sources, settings, translate)[0]


def plan_library(
    files: DataFrame, sources: list[Source], settings: Settings, only: str | None = None, listed: DataFrame | None = None, translate: Translate | None = None, existing: DataFrame | None = None
) -> Planned:
    """Steps for all video groups among the files (path), or for the group of one path. listed: where subtitles
    are sought, if not there. existing: path of each file that is there, as targets are written; images among them are not fetched again."""
    groups = group_video_inputs(files) if only is None else group_of(files, files.sparkSession.createDataFrame([(only,)], "path string"))
    names = groups.select(F.col("group_id").alias("entity_id"), format_input_name("input_stem", settings.input_name_rules).alias("name"), F.col("group_id").alias("path"))
    records, failed, tried = resolve_records(names, sources, settings, translate)
    records = records.withColumnRenamed("entity_id", "group_id").join(groups.select("group_id", "input_stem"), "group_id")
    places = outputs(records, settings.output, settings.multi_folder)
    images = None
    if settings.save_images:
        base = places.where("output_ord = 0").select("group_id", F.col("file_base").alias("base"))
        images = name_images(movie_images(records).join(base, "group_id"))
        records = local_images(records, images).withColumn("nfo", to_nfo(F.col("movie")))
    steps = actions(targets(places, groups, match_subtitles(groups, files if listed is None else listed), images), settings.multi_folder)
    if existing is not None:
        steps = without_present(steps, existing)
    return Planned(groups, records, failed.withColumnRenamed("entity_id", "group_id"), steps)
