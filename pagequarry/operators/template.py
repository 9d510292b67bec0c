"""Path templates over movie records, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TemplateError, UnknownFieldError
from ..functions.text import ascii_lower, blank_to_null, number_text, once, sanitize_component, trim_u

SCALARS = ("title", "originaltitle", "sorttitle", "year", "premiered", "runtime", "director", "studio", "tagline", "plot", "outline", "fileinfo", "trailer", "dateadded")
LISTS = ("genre", "tag", "country", "credits")  # in the order in which their values are tried
ACTOR = {"actor": "name", "actor.name": "name", "actor.gender": "gender", "actor.role": "role", "actor.order": "order"}


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class ActorField:
    value: str
    filters: tuple[tuple[str, str], ...] = ()

    def applies(self, actor: Column) -> Column:
        def one(key: str, wanted: str) -> Column:
            return actor["order"] == int(wanted) if key == "order" else ascii_lower(blank_to_null(actor[key])) == ascii_lower(F.lit(wanted))

        return F.coalesce(reduce(Column.__and__, [one(k, v) for k, v in self.filters], F.lit(True)), F.lit(False))

    def of(self, actor: Column) -> Column:
        """The actor's value, null if it has none or a filter does not apply."""
        value = actor["order"].cast("string") if self.value == "order" else blank_to_null(actor[self.value])
        return F.when(self.applies(actor), value)


def _actor_field(field: str, template: str) -> ActorField | None:
    base, bracket, rest = field.partition("[")
    filters = []
    if bracket:
        if not rest.endswith("]") or "[" in rest or "]" in rest[:-1] or not base.strip():
            raise TemplateError(template, f"bad actor filter in {field!r}")
        for item in rest[:-1].split(","):
            key, eq, value = (x.strip() for x in item.partition("="))
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1].strip()
            if not eq or key not in ("name", "gender", "role", "order") or not value or (key == "order" and not value.isdecimal()):
                raise TemplateError(template, f"bad actor filter {item.strip()!r}")
            filters.append((key, value))
    if base.strip() not in ACTOR:
        if filters:
            raise TemplateError(template, f"only actor fields take filters, not {base!r}")
        return None
    return ActorField(ACTOR[base.strip()], tuple(filters))


def parse_template(template: str) -> list[Literal | Field | ActorField]:
    """Literals and fields of a template; {{ and }} stand for the braces."""
    out: list[Literal | Field | ActorField] = []
    at = 0
    while at < len(template):
        c = template[at]
        if template[at : at + 2] in ("{{", "}}"):
            out.append(Literal(c))
            at += 2
        elif c == "}":
            raise TemplateError(template, "unmatched '}'")
        elif c == "{":
            end = template.find("}", at)
            if end < 0:
                raise TemplateError(template, "missing closing '}'")
            name = template[at + 1 : end].strip()
            if not name:
                raise TemplateError(template, "empty field")
            actor = _actor_field(name, template)
            if actor is None and name not in (*SCALARS, *LISTS, "userrating", "set.name", "set.overview", "uniqueid") and not name.startswith("uniqueid."):
                raise UnknownFieldError(template, name)
            out.append(actor or Field(name))
            at = end + 1
        else:
            end = min((x for x in (template.find("{", at), template.find("}", at)) if x >= 0), default=len(template))
            out.append(Literal(template[at:end]))
            at = end
    return out


def field_value(movie: Column, name: str, chosen: dict[str, Column] | None = None) -> Column:
    """A field of the record as text, null where it has none. chosen: the value that stands for a list."""
    if chosen and name in chosen:
        return chosen[name]
    if name == "userrating":
        return number_text(movie["userrating"])
    if name in SCALARS:
        return movie[name].cast("string")
    if name in LISTS:
        return F.when(F.size(movie[name]) > 0, F.array_join(movie[name], ", "))
    if name.startswith("set."):
        return movie["set"][name[4:]]
    ids = movie["uniqueid"]
    if name == "uniqueid":
        default = F.get(F.filter(ids, lambda u: F.coalesce(u["@default"], F.lit(False))), F.lit(0))["$text"]
        return F.coalesce(default, F.get(ids, F.lit(0))["$text"])
    return F.get(F.filter(ids, lambda u: u["@type"] == name.removeprefix("uniqueid.")), F.lit(0))["$text"]


def render(template: str, movie: Column, actor: Column | None = None, chosen: dict[str, Column] | None = None, sanitize: bool = True) -> Column:
    """The rendered text, null if an actor's value is missing; other missing values leave nothing."""
    clean = sanitize_component if sanitize else (lambda c: c)
    pieces = []
    for part in parse_template(template):
        if isinstance(part, Literal):
            pieces.append(F.lit(part.text))
        elif isinstance(part, Field):
            pieces.append(F.coalesce(clean(field_value(movie, part.name, chosen)), F.lit("")))
        else:
            value = part.of(actor) if actor is not None else F.array_join(F.nullif(F.array_compact(F.transform(F.coalesce(movie["actor"], F.array().cast(ACTORS)), part.of)), F.array().cast("array<string>")), ", ")
            pieces.append(F.nullif(clean(value), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


ACTORS = "array<struct<name:string,role:string,gender:string,order:bigint>>"


def resolve_path(rendered: Column, template: str) -> Column:
    """The rendered text as a path: absolute if it begins with /, each segment made safe; raises if one cannot be."""
    bad = lambda why: F.raise_error(F.lit(f"template {template!r}: {why}"))

    def joined(x: Column) -> Column:
        text, parts = x["text"], x["parts"]
        return (
            F.when((text == "") | (F.size(parts) == 0), bad("empty path"))
            .when(F.array_contains(parts, ""), bad("empty segment"))
            .when(F.array_contains(parts, ".") | F.array_contains(parts, ".."), bad("relative segment"))
            .otherwise(F.concat(F.when(F.startswith(text, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/")))
        )

    cut = lambda text: F.struct(text.alias("text"), F.transform(F.filter(F.split(text, "/"), lambda s: s != ""), sanitize_component).alias("parts"))
    return once(once(trim_u(rendered), cut), joined)


def output_paths(template: str, movie: Column, fallback: Column) -> Column:
    """All paths that a record has, in order and without repeats.

    A template with list fields is rendered for every combination of their values:
    actors outermost, then genre, tag, country, credits. Without any path it is rendered
    once over the whole lists, or the fallback is taken.
    """
    parts = parse_template(template)
    lists = [n for n in LISTS if any(isinstance(p, Field) and p.name == n for p in parts)]
    texts = "array<string>"

    def over(names: list[str], actor: Column | None, chosen: dict[str, Column]) -> Column:
        if not names:
            return F.array(render(template, movie, actor, chosen))
        values = F.filter(F.transform(F.coalesce(movie[names[0]], F.array().cast(texts)), trim_u), lambda v: v != "")
        return F.flatten(F.transform(values, lambda v: over(names[1:], actor, chosen | {names[0]: v})))

    if any(isinstance(p, ActorField) for p in parts):
        every = F.flatten(F.transform(F.coalesce(movie["actor"], F.array().cast(ACTORS)), lambda a: over(lists, a, {})))
    else:
        every = over(lists, None, {})
    kept = F.filter(every, lambda r: r.isNotNull() & (trim_u(r) != ""))
    paths = F.array_distinct(F.transform(kept, lambda r: resolve_path(r, template)))
    plain = once(render(template, movie), lambda whole: F.when(whole.isNull() | (trim_u(whole) == ""), fallback).otherwise(whole))
    return once(paths, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(resolve_path(plain, template))))


def build_name(base: Column, extension: Column) -> Column:
    return F.when(extension.isNull(), base).otherwise(F.concat(base, F.lit("."), extension))


def template_fields(template: str) -> list[str]:
    """Names of the fields in a template, as written."""
    parse_template(template)
    return [m[1].strip() for m in re.finditer(r"\{([^{}]+)\}", template.replace("{{", "").replace("}}", ""))]
