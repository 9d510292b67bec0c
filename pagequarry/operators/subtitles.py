"""Which subtitle belongs to which video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.languages import language_prefix
from ..functions.text import ascii_lower, file_name, file_stem, is_subtitle, once, parent_dir
from .parts import has_split_marker

# Words of encodings, which names may leave out.
NOISE = ("x264", "h264", "x265", "h265", "hevc", "hdr", "uhd", "bluray", "bdrip", "brrip", "webrip", "webdl", "remux", "aac", "dts", "ac3", "xvid")


def tokens(stem: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(stem, r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


def is_noise(lower: Column) -> Column:
    return lower.rlike(r"^[0-9]{3,}p\z") | lower.isin(*NOISE)


def is_year(lower: Column) -> Column:
    return lower.rlike(r"^(?:19[0-9]{2}|20[0-9]{2}|2100)\z")


def variants(stem: Column) -> Column:
    """Readings of a stem, each an array of words: all, without encodings, and also without years; no repeats, none empty."""
    low = lambda x: F.lower(x)
    whole = tokens(stem)
    plain = F.filter(whole, lambda x: ~is_noise(low(x)))
    dateless = F.filter(plain, lambda x: ~is_year(low(x)))
    return F.filter(F.array_distinct(F.array(whole, plain, dateless)), lambda v: F.size(v) > 0)


def suffix_text(rest: Column) -> Column:
    """The words left of a subtitle's name as a suffix: its language's tag first, if it begins with a marker."""
    found = language_prefix(F.transform(rest, F.lower))
    left = F.slice(rest, found["consumed"] + 1, F.greatest(F.size(rest) - found["consumed"], F.lit(0)))
    parts = F.concat(F.array_compact(F.array(found["language"])), left)
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit("."), F.array_join(parts, ".")))


def suffix_of(video: Column, subtitle: Column) -> Column:
    """The suffix that the subtitle's readings have beyond the video's, or null if they do not belong together.

    Readings are tried in order. Equal ones need no suffix, nor does a subtitle whose
    words begin the video's and have two characters or more.
    """

    def one(v: Column, s: Column) -> Column:
        lv, ls = F.transform(v, F.lower), F.transform(s, F.lower)
        short = F.char_length(F.array_join(ls, "")) >= 2
        rest = F.slice(s, F.size(v) + 1, F.greatest(F.size(s) - F.size(v), F.lit(0)))
        return (
            F.when(ls == lv, "")
            .when((F.size(ls) > F.size(lv)) & (F.slice(ls, 1, F.size(lv)) == lv), suffix_text(rest))
            .when((F.size(lv) > F.size(ls)) & (F.slice(lv, 1, F.size(ls)) == ls) & short, "")
        )

    return F.get(F.array_compact(F.flatten(F.transform(video, lambda v: F.transform(subtitle, lambda s: one(v, s))))), F.lit(0))


def subtitle_suffix(video_stem: Column, subtitle_stem: Column) -> Column:
    return F.when(video_stem == subtitle_stem, "").otherwise(suffix_of(variants(video_stem), variants(subtitle_stem)))


def _meeting(stem: Column, words: Column, video: bool) -> Column:
    """Keys that two names share if suffix_of() can relate them: all words of one are the first of the other's. Names without words share their stem."""
    lower = F.transform(words, lambda v: F.transform(v, F.lower))
    full = F.transform(lower, lambda v: F.array_join(v, " "))
    firsts = F.flatten(F.transform(lower, lambda v: F.transform(F.sequence(F.lit(1), F.size(v)), lambda k: F.array_join(F.slice(v, 1, k), " "))))
    tagged = lambda sign, of: F.transform(of, lambda x: F.concat(F.lit(sign), x))
    plain = F.when(F.size(words) == 0, F.array(F.concat(F.lit("="), stem))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(plain, tagged("v", full if video else firsts), tagged("s", firsts if video else full)))


def match_subtitles(groups: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """Subtitles of each group in the order of its plan: group_id, path, target_base, sort_key.

    A subtitle is matched to a part first, then to the group; of several only the
    first counts. In split groups a part takes only subtitles with a split marker; a
    group takes only those without. The join is on the directory and on words that
    related names share, so a directory of many files costs its matches, not its pairs.
    """
    path = F.col(path_col)
    subs = files.where(is_subtitle(path)).select(parent_dir(path).alias("dir"), path.alias("path"), file_stem(path).alias("sub_stem")).distinct().withColumn("marked", has_split_marker(F.col("sub_stem")))
    split = F.size("parts") > 1
    part = groups.select("group_id", split.alias("split"), F.posexplode("parts").alias("rank", "p"))
    part = part.select("group_id", "split", F.col("rank"), F.lit(0).alias("level"), parent_dir(F.col("p.path")).alias("dir"), F.col("p.input_stem").alias("stem"), F.col("p.output_suffix").alias("part_base"))
    whole = groups.select("group_id", split.alias("split"), F.lit(0).alias("rank"), F.lit(1).alias("level"), parent_dir(F.col("group_id")).alias("dir"), F.col("input_stem").alias("stem"), F.lit("").alias("part_base"))
    # A name has many keys, so a key goes as its hash and without lists of words; directory and words are compared in full where hashes meet.
    keys = lambda df, stem, video: df.withColumn("word", F.explode_outer(once(variants(F.col(stem)), lambda words: _meeting(F.col(stem), words, video)))).withColumn("key", F.xxhash64("dir", "word")).drop("word")
    fits = F.when(F.col("level") == 0, ~F.col("split") | F.col("marked")).otherwise(~F.col("marked"))
    name = file_name(F.col("path"))
    here = (F.concat("dir", F.lit("/"), name) == F.col("path")) | ((F.col("dir") == "") & (name == F.col("path")))
    # Spark takes the keys of a name for one row of a small file and would broadcast them all, through the driver.
    met = keys(part.unionByName(whole), "stem", True).join(keys(subs, "sub_stem", False).drop("dir").hint("merge"), "key").where(here & fits)
    met = met.select("group_id", "path", "level", "rank", "part_base", subtitle_suffix(F.col("stem"), F.col("sub_stem")).alias("suffix"))
    # A pair that meets by several keys counts once, too; pairs that are none come last, as a filter before would work out suffixes once more.
    first = Window.partitionBy("group_id", "path").orderBy(F.col("suffix").isNull(), "level", "rank")
    met = met.withColumn("n", F.row_number().over(first)).where("n = 1 and suffix is not null")
    low = ascii_lower(file_name(F.col("path")))
    key = F.when(F.col("level") == 0, F.concat(F.lit("0:"), low, F.lit(":"), "part_base")).otherwise(F.concat(F.lit("1:"), low))
    return met.select("group_id", "path", F.concat("part_base", "suffix").alias("target_base"), key.alias("sort_key"))
