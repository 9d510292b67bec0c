"""The movie record: schema, merge of ranked sources, value mapping, XML text."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError
from ..functions.text import ascii_lower, blank_to_null, trim_u, union_list

_THUMB = "struct<`@aspect`:string,`@preview`:string,`$text`:string>"
RATINGS = "array<struct<`@name`:string,`@max`:float,`@default`:boolean,value:float,votes:bigint>>"
UNIQUE_IDS = "array<struct<`@type`:string,`@default`:boolean,`$text`:string>>"
ACTORS = "array<struct<name:string,role:string,gender:string,`order`:bigint>>"
MOVIE = (
    "struct<title:string,originaltitle:string,sorttitle:string,year:int,premiered:string,runtime:int,director:string,"
    "credits:array<string>,genre:array<string>,tag:array<string>,plot:string,outline:string,tagline:string,"
    f"ratings:struct<rating:{RATINGS}>,userrating:float,uniqueid:{UNIQUE_IDS},thumb:{_THUMB},fanart:struct<thumb:array<{_THUMB}>>,"
    f"studio:string,country:array<string>,`set`:struct<name:string,overview:string>,actor:{ACTORS},trailer:string,fileinfo:string,dateadded:string>"
)


def struct_type(ddl: str) -> T.DataType:
    """The type that a DDL text names; needs a session, so it is not read on import."""
    return T.DataType.fromDDL(ddl)


STRINGS = ("title", "originaltitle", "sorttitle", "premiered", "director", "plot", "outline", "tagline", "studio", "trailer", "fileinfo", "dateadded")
NUMBERS = ("year", "runtime", "userrating")
LISTS = ("credits", "genre", "tag", "country")


def movie(**fields: Column) -> Column:
    """A record with the given fields; lists are empty and all else is null unless given."""
    out = []
    for f in struct_type(MOVIE).fields:
        empty = F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(None)
        out.append(fields.get(f.name, empty).cast(f.dataType).alias(f.name))
    return F.struct(*out)


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(struct_type(ddl))


# Folds over the lists that sources give, in order, as expressions: an aggregate over the sources and, inside, over what each
# gives. Of what there is so far the first that is the same is filled up; what is new goes to the end.


def _text(value: Column) -> Column:
    """How texts compare; blank ones are none."""
    return ascii_lower(blank_to_null(value))


def _fill(into: Column, source: Column, ddl: str, strings: tuple[str, ...], others: tuple[str, ...] = ()) -> Column:
    def value(k: str) -> Column:
        if k in strings:
            return F.when(_text(into[k]).isNull() & _text(source[k]).isNotNull(), trim_u(source[k])).otherwise(into[k])
        return F.coalesce(into[k], source[k]) if k in others else into[k]

    return F.struct(*[value(f.name).cast(f.dataType).alias(f.name) for f in struct_type(ddl).elementType.fields])


def _first_of(have: Column, fits: Callable[[Column], Column]) -> Column:
    """Place of the first that fits, from 1; 0 if none does."""
    return F.array_position(F.transform(have, lambda x: F.coalesce(fits(x), F.lit(False))), True)


def _met(have: Column, come: Column, place: Callable[[Column, Column], Column], fill: Callable[[Column, Column], Column]) -> Column:
    """What there is with what comes in; place(have, item) tells what an item is the same as."""

    def step(acc: Column, item: Column) -> Column:
        at = place(acc, item)
        filled = F.transform(acc, lambda x, k: F.when(k == at - 1, fill(x, item)).otherwise(x))
        return F.when(at > 0, filled).otherwise(F.concat(acc, F.array(item)))

    return F.aggregate(come, have, step)


def _folded(lists: Column, ddl: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    none = F.array().cast(struct_type(ddl))
    return F.aggregate(F.coalesce(lists, F.array(none)), start.cast(struct_type(ddl)), step)


def fold_ratings(lists: Column) -> Column:
    """Ratings of one name are one; without any so far all are taken as they are."""
    same = lambda acc, r: _first_of(acc, lambda x: _text(x["@name"]).eqNullSafe(_text(r["@name"])))
    fill = lambda x, r: _fill(x, r, RATINGS, ("@name",), ("@max", "@default", "value", "votes"))
    return _folded(lists, RATINGS, F.lit(None), lambda have, come: F.when(have.isNull(), come).when(come.isNull(), have).otherwise(_met(have, come, same, fill)))


def fold_unique_ids(lists: Column) -> Column:
    key = lambda x: (_text(x["@type"]), _text(x["$text"]))
    same = lambda acc, u: _first_of(acc, lambda x: key(x)[0].eqNullSafe(key(u)[0]) & key(x)[1].eqNullSafe(key(u)[1]))
    fill = lambda x, u: _fill(x, u, UNIQUE_IDS, ("@type", "$text"), ("@default",))
    return _folded(lists, UNIQUE_IDS, F.array(), lambda have, come: F.when(come.isNull(), have).otherwise(_met(have, come, same, fill)))


def fold_actors(lists: Column) -> Column:
    """Actors of one name and order are one, else those of one name; after each source all are numbered anew."""

    def same(acc: Column, a: Column) -> Column:
        named = lambda x: _text(x["name"]).eqNullSafe(_text(a["name"]))
        both = _first_of(acc, lambda x: named(x) & x["order"].eqNullSafe(a["order"]))
        return F.when(both > 0, both).when(_text(a["name"]).isNotNull(), _first_of(acc, named)).otherwise(F.lit(0).cast("long"))

    fill = lambda x, a: _fill(x, a, ACTORS, ("role", "gender", "name"), ("order",))
    number = lambda x, k: F.struct(x["name"].alias("name"), x["role"].alias("role"), x["gender"].alias("gender"), (k + 1).cast("long").alias("order"))
    return _folded(lists, ACTORS, F.array(), lambda have, come: F.transform(F.when(come.isNull(), have).otherwise(_met(have, come, same, fill)), number))


def _filled(t: Column) -> Column:
    return _text(t["$text"]).isNotNull() | _text(t["@preview"]).isNotNull() | _text(t["@aspect"]).isNotNull()


def fanarts(lists: Column) -> Column:
    """One list of thumbs from a list for each source, in order; for sources whose images may mix.

    Thumbs with anything in them; those of one address or preview are one, and an empty place is filled.
    """
    kind = f"array<{_THUMB}>"

    def same(acc: Column, t: Column) -> Column:
        value, preview, aspect = (_text(t[k]) for k in ("$text", "@preview", "@aspect"))

        def fits(x: Column) -> Column:
            v, p, a = (_text(x[k]) for k in ("$text", "@preview", "@aspect"))
            one = F.coalesce(v == value, F.lit(False)) | F.coalesce(p == preview, F.lit(False))
            alike = F.coalesce(a == aspect, F.lit(False))
            return one | (v.isNull() & p.isNull() & (aspect.isNull() | alike)) | (value.isNull() & preview.isNull() & alike)

        return _first_of(acc, fits)

    def step(have: Column, come: Column) -> Column:
        come = F.filter(F.coalesce(come, F.array().cast(struct_type(kind))), _filled)
        more = F.filter(_met(have, come, same, lambda x, t: _fill(x, t, kind, ("@aspect", "@preview", "$text"))), _filled)
        return F.when(F.size(come) == 0, have).when(have.isNull(), come).otherwise(more)

    return _folded(lists, kind, F.lit(None), step)


def _first(values: Column, ok: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(values, ok), F.lit(0))


def _nonblank(c: Column) -> Column:
    return c.isNotNull() & (trim_u(c) != "")


def merge_details(movies: Column) -> dict[str, Column]:
    """Fields of the record that folds an ordered array of records, images aside."""
    of = lambda name: F.transform(movies, lambda m: m[name])
    out = {n: trim_u(_first(of(n), _nonblank)) for n in STRINGS}
    out |= {n: _first(of(n), lambda v: v.isNotNull()) for n in NUMBERS}
    for n in LISTS:
        out[n] = union_list(F.flatten(F.transform(of(n), lambda v: F.coalesce(v, F.array().cast("array<string>")))))
    sets = F.filter(of("set"), lambda s: s.isNotNull())
    one = F.get(sets, F.lit(0))

    def filled(name: str) -> Column:
        later = _first(F.transform(sets, lambda s: s[name]), _nonblank)
        return F.when(_nonblank(one[name]), one[name]).otherwise(F.coalesce(blank_to_null(later), one[name]))

    out["set"] = F.when(F.size(sets) > 0, F.struct(filled("name").alias("name"), filled("overview").alias("overview")))
    folded = fold_ratings(F.transform(of("ratings"), lambda r: r["rating"]))
    out["ratings"] = F.when(F.exists(of("ratings"), lambda r: r.isNotNull()), F.struct(folded.alias("rating")))
    out["uniqueid"], out["actor"] = fold_unique_ids(of("uniqueid")), fold_actors(of("actor"))
    return out


def has_images(m: Column) -> Column:
    filled = lambda t: _nonblank(t["$text"]) | _nonblank(t["@preview"]) | _nonblank(t["@aspect"])
    return F.coalesce(filled(m["thumb"]), F.lit(False)) | F.coalesce(F.exists(m["fanart"]["thumb"], filled), F.lit(False))


def image_fields(movies: Column) -> dict[str, Column]:
    """Images of the first record that has any, else of the first; never of several."""
    chosen = F.coalesce(_first(movies, has_images), F.get(movies, F.lit(0)))
    filled = lambda t: _nonblank(t["$text"]) | _nonblank(t["@preview"]) | _nonblank(t["@aspect"])
    fan = F.filter(chosen["fanart"]["thumb"], filled)
    return {"thumb": chosen["thumb"], "fanart": F.when(F.size(fan) > 0, F.struct(fan.alias("thumb")))}


def resolve_priority(own: list[str] | None, shared: list[str] | None) -> list[str]:
    """A mode's list of aliases if it has one, else the shared list; trimmed, without blanks or repeats."""
    found = [x.strip() for x in (own or shared or []) if x.strip()]
    return list(dict.fromkeys(found))


def by_priority(sources: Column, aliases: list[str]) -> Column:
    """Sources (alias, movie) in the order of the aliases, the first of each; all in their own order without aliases."""
    if not aliases:
        return sources
    named = F.array(*[F.lit(a) for a in aliases])
    return F.flatten(F.transform(named, lambda a: F.slice(F.filter(sources, lambda s: s["alias"] == a), 1, 1)))


def merge_sources(rows: DataFrame, details: list[str] | None = None, images: list[str] | None = None, multi: bool = True) -> DataFrame:
    """One record for each entity: entity_id, n_sources, movie.

    rows: entity_id, source_ord, alias, movie. Details and images are resolved on their
    own, by their lists of aliases. Lists without multi take only the first source's
    details. One source alone stays as it is. One shuffle on the entity; an entity has
    as many rows as there are sources.
    """
    details, images = resolve_priority(details, None), resolve_priority(images, None)
    configured = bool(details or images)
    grouped = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("source_ord", "alias", F.struct("movie").alias("m")))).alias("s"))
    if not (multi or configured):
        return grouped.select("entity_id", F.size("s").alias("n_sources"), F.get("s", F.lit(0))["m"]["movie"].alias("movie"))
    plain = F.transform("s", lambda x: F.struct(x["alias"].alias("alias"), x["m"]["movie"].alias("movie")))
    grouped = grouped.select("entity_id", F.size("s").alias("n_sources"), plain.alias("s"))
    detail_sources = by_priority(F.col("s"), details)
    if configured and not multi:
        detail_sources = F.slice(detail_sources, 1, 1)
    only = lambda c: F.transform(c, lambda x: x["movie"])
    grouped = grouped.withColumn("d", only(detail_sources)).withColumn("i", only(by_priority(F.col("s"), images)))
    merged = movie(**merge_details(F.col("d")), **image_fields(F.col("i")))
    return grouped.select("entity_id", "n_sources", F.when(F.col("n_sources") == 1, F.get("s", F.lit(0))["movie"]).otherwise(merged).alias("movie"))


def success_limit(multi: bool, most: int = 2, priority: bool = False) -> int | None:
    """How many sources may succeed: all (None) with priorities, one without multi, else most, of which 0 means all."""
    if priority:
        return None
    return (most or None) if multi else 1


def limit_sources(attempts: DataFrame, limit: int | None) -> DataFrame:
    """Attempts that run and succeed: entity_id, source_ord, ok, ... up to the limit for each entity."""
    from pyspark.sql import Window

    done = attempts.where("ok")
    if limit is None:
        return done
    return done.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("source_ord"))).where(F.col("n") <= limit).drop("n")


def require_success(done: DataFrame, attempts: DataFrame) -> DataFrame:
    """Entities of which every attempt failed, with their last error."""
    failed = attempts.join(done.select("entity_id").distinct(), "entity_id", "left_anti")
    return failed.groupBy("entity_id").agg(F.max_by("error", "source_ord").alias("error"))


def first_by_alias(sources: DataFrame) -> DataFrame:
    """sources (alias, ord, ...) with is_duplicate for all but the earliest of each alias.

    The earliest are a partial aggregation, so an alias of very many rows is no burden."""
    first = sources.groupBy("alias").agg(F.min("ord").alias("_first"))
    return sources.join(first, "alias").withColumn("is_duplicate", F.col("ord") > F.col("_first")).drop("_first")


def unknown_aliases(wanted: DataFrame, active: DataFrame) -> DataFrame:
    """Wanted aliases (alias, ord) that no active source has, each once, in order."""
    return wanted.groupBy("alias").agg(F.min("ord").alias("ord")).join(active.select("alias").distinct(), "alias", "left_anti").orderBy("ord")


# XML text

_SCHEMA_OPTIONS = {"rowTag": "movie", "attributePrefix": "@", "valueTag": "$text"}


def from_nfo(xml: Column) -> Column:
    """The record of an XML text; raises if it is malformed, as null texts do not."""
    return F.from_xml(xml, MOVIE, _SCHEMA_OPTIONS | {"mode": "FAILFAST"})


def _number(v: float | int | bool) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if float(v).is_integer() else f"{v:.7g}"


def nfo_text(record: dict) -> str:
    """XML text of a record: two spaces of indent, empty lists and nulls left out."""
    lines: list[str] = []

    def put(name: str, value, depth: int) -> None:
        pad = "  " * depth
        if value is None:
            return
        if isinstance(value, list):
            for v in value:
                put(name, v, depth)
        elif isinstance(value, dict):
            attrs = "".join(f" {k[1:]}={quoteattr(_plain(v))}" for k, v in value.items() if k[0] == "@" and v is not None)
            inner = {k: v for k, v in value.items() if k[0] not in "@$" and v is not None and v != []}
            if value.get("$text") is not None:
                lines.append(f"{pad}<{name}{attrs}>{escape(value['$text'])}</{name}>")
            elif inner:
                lines.append(f"{pad}<{name}{attrs}>")
                for k, v in inner.items():
                    put(k, v, depth + 1)
                lines.append(f"{pad}</{name}>")
            elif attrs or depth == 0:
                lines.append(f"{pad}<{name}{attrs} />")
        else:
            lines.append(f"{pad}<{name}>{escape(_plain(value))}</{name}>")

    put("movie", record, 0)
    return "\n".join(lines)


def _plain(v) -> str:
    return v if isinstance(v, str) else _number(v)


def _told(values: pa.Array) -> bool:
    """Whether any row has a value that is neither null nor an empty list."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        return bool(pc.sum(pc.list_value_length(values)).as_py())
    return values.null_count < len(values)


def nfo_texts(rows: pa.StructArray) -> pa.Array:
    """nfo_text of each record; fields that no row tells are left out before they become Python values, as most are of most records."""
    told = [(f.name, values.to_pylist()) for f, values in zip(rows.type, rows.flatten()) if _told(values)]
    names, columns = [n for n, _ in told], [v for _, v in told]
    records = zip(*columns) if columns else [()] * len(rows)
    return pa.array([nfo_text(dict(zip(names, r))) if ok else None for ok, r in zip(rows.is_valid().to_pylist(), records)], pa.string())


def to_nfo(record: Column) -> Column:
    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return nfo_texts(rows)

    return run(record)


def nfo_output(raw: Column, record: Column, changed: Column) -> Column:
    """A source's own XML byte for byte, unless the record has changed since or there is none."""
    return F.when(raw.isNotNull() & ~changed, raw).otherwise(to_nfo(record))


def decode_output(kind: str, value):
    """A source's answer: a dict is a record, a text is XML, anything else is an error."""
    if isinstance(value, (dict, str)):
        return value
    raise SourceError(f"{kind} gave {type(value).__name__}, expected a record or XML text")
