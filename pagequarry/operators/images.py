"""Names and fetches of a record's images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import image_action, image_extension

_THUMB = "struct<`@aspect`:string,`@preview`:string,`$text`:string>"


def movie_images(movies: DataFrame, id_col: str = "group_id", movie_col: str = "movie") -> DataFrame:
    """Images of each record in order: id, ord, role, url. Roles are poster, fanart, fanart-2 and so on,
    each followed by its preview."""
    m = F.col(movie_col)
    fan = F.coalesce(m["fanart"]["thumb"], F.array().cast(f"array<{_THUMB}>"))
    number = lambda i: F.when(i == 0, "fanart").otherwise(F.concat(F.lit("fanart-"), (i + 1).cast("string")))
    thumbs = F.concat(F.array(F.struct(F.lit("poster").alias("role"), m["thumb"].alias("t"))), F.transform(fan, lambda t, i: F.struct(number(i).alias("role"), t.alias("t"))))
    both = lambda x: F.array(F.struct(x["role"].alias("role"), x["t"]["$text"].alias("url")), F.struct(F.concat(x["role"], F.lit("-preview")).alias("role"), x["t"]["@preview"].alias("url")))
    return movies.select(id_col, F.posexplode(F.flatten(F.transform(thumbs, both))).alias("ord", "i")).select(id_col, "ord", "i.role", "i.url").where("url is not null and trim(url) <> ''")


def name_images(images: DataFrame, base_col: str = "base", id_col: str = "group_id") -> DataFrame:
    """images: id, ord, role, url and the file base. Adds file_name: one for each distinct address of a
    record, that of its first use; a name that another address has taken gets -1, -2 and so on."""
    per_url = Window.partitionBy(id_col, "url").orderBy("ord")
    own = images.withColumn("first_ord", F.first("ord").over(per_url)).withColumn("first_role", F.first("role").over(per_url))
    own = own.withColumn("stem", F.concat(F.col(base_col), F.lit("-"), "first_role")).withColumn("ext", image_extension(F.col("url")))
    taken = F.dense_rank().over(Window.partitionBy(id_col, "stem", "ext").orderBy("first_ord"))
    name = F.concat("stem", F.when(taken > 1, F.concat(F.lit("-"), (taken - 1).cast("string"))).otherwise(""), F.lit("."), "ext")
    return own.withColumn("file_name", name).withColumn("action", image_action(F.col("url"))).select(*images.columns, "file_name", "action", (F.col("ord") == F.col("first_ord")).alias("is_first"))


def local_images(movies: DataFrame, named: DataFrame, id_col: str = "group_id", movie_col: str = "movie") -> DataFrame:
    """movies with each fetched address replaced by its file's name; other values stay. An address that is
    plain http raises."""
    entry = F.when(F.col("action") == "fetch", F.struct("url", "file_name")).when(F.col("action") == "refuse", F.raise_error(F.concat(F.lit("image over plain http: "), "url")).cast("struct<url:string,file_name:string>"))
    names = named.where("action <> 'keep' and is_first").groupBy(id_col).agg(F.map_from_entries(F.collect_list(entry)).alias("_names"))
    met = movies.join(names, id_col, "left").withColumn("_names", F.coalesce("_names", F.create_map().cast("map<string,string>")))
    local = lambda c: F.coalesce(F.try_element_at(F.col("_names"), c), c)
    thumb = lambda t: F.when(t.isNotNull(), F.struct(t["@aspect"].alias("@aspect"), local(t["@preview"]).alias("@preview"), local(t["$text"]).alias("$text")))
    m = F.col(movie_col)
    fanart = F.when(m["fanart"].isNotNull(), F.struct(F.transform(m["fanart"]["thumb"], thumb).alias("thumb")))
    return met.withColumn(movie_col, m.withField("thumb", thumb(m["thumb"])).withField("fanart", fanart)).select(*movies.columns)


def images_to_fetch(named: DataFrame, present: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Images to fetch once: https addresses whose file is not present (columns dir, file_name) already."""
    return named.where("is_first and action = 'fetch'").join(present.select(F.col("dir").alias(dir_col), "file_name"), [dir_col, "file_name"], "left_anti")
