"""String primitives as column expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RuleError

# File kinds by extension.
VIDEO_EXTENSIONS = ("mkv", "mp4", "avi", "mov", "m4v", "wmv", "flv", "webm", "ts", "m2ts", "mts", "mpg", "mpeg")
SUBTITLE_EXTENSIONS = ("srt", "ass", "ssa", "vtt", "sub", "idx", "sup")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once for each row however often it is used: it is the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def trim_u(c: Column | str) -> Column:
    """Strips Unicode white space, which trim() does not."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def blank_to_null(c: Column | str) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(trim_u(c), F.lit(""))


def key(c: Column | str) -> Column:
    """How texts are compared: trimmed, ASCII lower case."""
    return ascii_lower(trim_u(c))


def collapse_space(c: Column | str) -> Column:
    return trim_u(F.regexp_replace(c, r"(?U)\s+", " "))


def sanitize_component(c: Column | str) -> Column:
    """A text as one path component: no control characters, reserved ones as _, single spaces, no outer dots."""
    c = F.regexp_replace(c, r"\p{Cc}", "")
    c = F.regexp_replace(c, r'[/\\:*?"<>|]', "_")
    return F.regexp_replace(collapse_space(c), r"^\.+|\.+\z", "")


def file_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def file_extension(path: Column | str) -> Column:
    """What follows the last dot of the name, null without one; a leading dot starts no extension."""
    return F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]*)\z", 1), F.lit(""))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).when(directory == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(directory, F.lit("/"), name))


def is_video(path: Column | str) -> Column:
    return F.coalesce(ascii_lower(file_extension(path)).isin(*VIDEO_EXTENSIONS), F.lit(False))


def is_subtitle(path: Column | str) -> Column:
    return F.coalesce(ascii_lower(file_extension(path)).isin(*SUBTITLE_EXTENSIONS), F.lit(False))


def union_list(*lists: Column) -> Column:
    """Values of all lists in order, trimmed, blanks dropped, equal keys once in their first spelling.

    A struct of key and value is kept for each, so a list is folded in one pass.
    """
    flat = F.filter(F.transform(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), trim_u), lambda x: x.isNotNull() & (x != ""))
    keys = F.transform(flat, ascii_lower)
    return F.filter(flat, lambda x, i: F.array_position(keys, ascii_lower(x)) == i + 1)


def union_list_agg(rows: DataFrame, group: list[str], value: str, order: list[str], name: str = "values") -> DataFrame:
    """union_list() over the rows of each group, in their order: the group's columns and the list.

    Equal keys are reduced to their first row before the lists are gathered, on both sides
    of the first shuffle, so a group of very many rows costs no task more than its distinct
    values.
    """
    text = blank_to_null(F.col(value))
    first = rows.where(text.isNotNull()).groupBy(*group, ascii_lower(text).alias("_key")).agg(F.min(F.struct(*order, text.alias("_value"))).alias("_first"))
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("_first")), lambda x: x["_value"]).alias(name))


def number_text(c: Column) -> Column:
    """A float as text, whole numbers without a fraction."""
    return F.regexp_replace(c.cast("string"), r"\.0\z", "")


# Patterns and replacements of users, whose dialect has Unicode classes, no lookaround and no backreferences.


def user_pattern(pattern: str) -> str:
    """A user's pattern for the JVM; refuses what the dialect lacks."""
    if not pattern:
        raise RuleError(pattern, "pattern cannot be empty")
    body = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?<?[=!]|\\[1-9]|\\k<|\(\?>|[*+?}]\+", body):
        raise RuleError(pattern, "lookaround, backreferences, atomic groups and possessive repeats are not supported")
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\p\{[^}]*\}|\\P\{[^}]*\}|\\z", "x", pattern)))
    except re.error as e:
        raise RuleError(pattern, str(e)) from None
    return "(?U)" + re.sub(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", lambda m: f"(?<{_group(m[1])}>", pattern)


def _group(name: str) -> str:
    return name.replace("_", "U95")


def user_template(pattern: str, template: str) -> str:
    """A replacement where $name takes the longest name, a missing group is empty and $$ is a dollar."""
    names = re.findall(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", pattern)
    groups = len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern)))
    out, at = [], 0
    for m in re.finditer(r"\$\$|\$\{([^}]*)\}|\$([0-9A-Za-z_]+)", template):
        out.append(_literal(template[at : m.start()]))
        at, name = m.end(), m[1] if m[1] is not None else m[2]
        if m[0] == "$$":
            out.append(r"\$")
        elif name.isdigit():
            out.append(f"${int(name)}" if int(name) <= groups else "")
            if at < len(template) and template[at].isdigit():
                out.append("\\" + template[at])
                at += 1
        elif name in names:
            out.append(f"${{{_group(name)}}}")
    return "".join(out) + _literal(template[at:])


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


# Name clean-up

PREFIXES = ("literal:", "regex:", "replace:", "regex-replace:")


def expand_rules(rules: list[str]) -> list[str]:
    """Rules one by one: those without a prefix are cut at commas; blanks go; prefixed ones keep trailing spaces."""
    out = []
    for rule in rules:
        if rule.strip():
            out += [rule.lstrip()] if rule.lstrip().startswith(PREFIXES) else [x.strip() for x in rule.split(",") if x.strip()]
    return out


def _replacement(rest: str, rule: str) -> tuple[str, str]:
    left, arrow, right = rest.partition("=>")
    if not arrow:
        raise RuleError(rule, "missing '=>'")
    if not left.strip():
        raise RuleError(rule, "left side cannot be empty")
    return left.strip(), right


def apply_rule(c: Column, rule: str) -> Column:
    if rule.startswith("regex-replace:"):
        pattern, to = _replacement(rule.removeprefix("regex-replace:"), rule)
        return F.regexp_replace(c, user_pattern(pattern), user_template(pattern, to))
    if rule.startswith("replace:"):
        old, new = _replacement(rule.removeprefix("replace:"), rule)
        return F.replace(c, F.lit(old), F.lit(new))
    if rule.startswith("regex:"):
        return F.regexp_replace(c, user_pattern(rule.removeprefix("regex:").strip()), "")
    literal = rule.removeprefix("literal:").strip()
    return F.replace(c, F.lit(literal), F.lit("")) if literal else c


def format_input_name(c: Column | str, rules: list[str]) -> Column:
    """The name after all rules in order, with single spaces; unchanged without rules; an empty result raises."""
    steps, c = expand_rules(rules), F.col(c) if isinstance(c, str) else c
    if not steps:
        return c
    out = collapse_space(reduce(apply_rule, steps, c))
    return F.when(out == "", F.raise_error(F.concat(F.lit("name rules leave nothing of "), c))).otherwise(out)
