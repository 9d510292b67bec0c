"""Value mapping by rules of CSV lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MappingError
from ..functions.text import key, trim_u
from .movie import LISTS, MOVIE, STRINGS, _arrow

BROADCAST_BYTES = 64_000_000  # of rules; larger sets are joined by shuffle


def parse_line(line: str) -> list[str]:
    """Trimmed values of a line. Quotes may open anywhere, two stand for one; an open quote is an error."""
    values, held, quoted, at = [], [], False, 0
    while at < len(line):
        c = line[at]
        if c == '"':
            if quoted and line[at + 1 : at + 2] == '"':
                held.append(c)
                at += 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            values.append("".join(held).strip())
            held.clear()
        else:
            held.append(c)
        at += 1
    if quoted:
        raise MappingError("unterminated quoted value")
    return [*values, "".join(held).strip()]


def parse_rules(text: str) -> list[tuple[str, str, str]]:
    """(node, from, to) of each rule, keys normalised, in order. Only the first data line may be a header:
    node,to,from... (as without one) or node,from,to."""
    out, legacy, first = [], False, True
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            cells = parse_line(line)
        except MappingError as e:
            raise MappingError(f"line {number}: {e}") from None
        if len(cells) < 3:
            raise MappingError(f"line {number}: expected at least 3 columns")
        if first:
            first, low = False, [(_text(c) or "") for c in cells]
            if low[0] == "node" and low[1] == "to" and low[2].startswith("from"):
                continue
            if low[0] == "node" and low[1:3] == ["from", "to"]:
                legacy = True
                continue
        if legacy and len(cells) != 3:
            raise MappingError(f"line {number}: expected 3 columns")
        node, to, froms = (cells[0], cells[2], cells[1:2]) if legacy else (cells[0], cells[1], cells[2:])
        if not node or not all(froms):
            raise MappingError(f"line {number}: node and from values must be non-empty")
        out += [(_text(node), _text(f), to) for f in froms]
    return out


def rules_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Rules of all files: node_key, from_key, to_value. Later lines and files override."""
    rows = [(n, f, t, k) for k, (n, f, t) in enumerate(r for text in texts for r in parse_rules(text))]
    df = spark.createDataFrame(rows, "node_key string, from_key string, to_value string, rule_ord long")
    return df.groupBy("node_key", "from_key").agg(F.max_by("to_value", "rule_ord").alias("to_value"))


def map_column(df: DataFrame, column: str, rules: DataFrame, node: str, size_bytes: int | None = None) -> DataFrame:
    """The column mapped by the rules of a node: a hit gives its value, a miss the trimmed value, an empty result null.

    size_bytes: of the rules, if known; they are broadcast only below BROADCAST_BYTES.
    """
    own = rules.where(F.col("node_key") == (_text(node) or "")).select(F.col("from_key").alias("_key"), F.col("to_value").alias("_to"))
    own = F.broadcast(own) if size_bytes is not None and size_bytes <= BROADCAST_BYTES else own
    met = df.withColumn("_key", key(F.col(column))).join(own, "_key", "left")
    return met.withColumn(column, F.nullif(F.coalesce("_to", trim_u(F.col(column))), F.lit(""))).select(*df.columns)


class Mapper:
    """Rules in memory, for nested records."""

    def __init__(self, texts: list[str]):
        self.rules: dict[str, dict[str, str]] = {}
        for text in texts:
            for node, old, new in parse_rules(text):
                self.rules.setdefault(node, {})[old] = new

    def value(self, value: str | None, *nodes: str) -> str | None:
        if value is None:
            return None
        for n in nodes:
            found = self.rules.get(n, {}).get(_text(value) or "")
            if found is not None:
                return found or None
        return value.strip() or None

    def movie(self, m: dict) -> dict:
        """The record mapped; not even trimmed without rules."""
        if not self.rules:
            return m
        out = dict(m)
        for n in STRINGS:
            out[n] = self.value(m[n], n)
        for n in LISTS:
            kept: dict[str | None, str] = {}
            for v in m[n] or []:
                if v is not None and (mapped := self.value(v, n)):
                    kept.setdefault(_text(mapped), mapped)
            out[n] = list(kept.values())
        if m["set"]:
            out["set"] = {k: self.value(m["set"][k], f"set.{k}") for k in ("name", "overview")}
        actors: list[dict] = []
        for a in m["actor"] or []:
            a = dict(a, name=self.value(a["name"], "actor", "actor.name"), role=self.value(a["role"], "actor.role"), gender=self.value(a["gender"], "actor.gender"))
            same = next((x for x in actors if _text(a["name"]) and _text(x["name"]) == _text(a["name"])), None)
            if same is None:
                actors.append(a)
            else:
                _fill(same, a, ("name", "role", "gender"), ("order",))
        out["actor"] = [dict(a, order=k) for k, a in enumerate(actors, 1)]
        return out


def _text(value: str | None) -> str | None:
    """How texts compare; blank ones are none."""
    value = (value or "").strip()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value) or None


def _fill(into: dict, source: dict, strings: tuple[str, ...], others: tuple[str, ...] = ()) -> None:
    for k in strings:
        if _text(into.get(k)) is None and _text(source.get(k)) is not None:
            into[k] = source[k].strip()
    for k in others:
        if into.get(k) is None:
            into[k] = source.get(k)


def map_movies(record: Column, mapper: Mapper) -> Column:
    """Records mapped by the rules, in Arrow batches; unchanged without rules."""
    if not mapper.rules:
        return record
    arrow = _arrow(MOVIE)

    @F.arrow_udf(MOVIE)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if m is None else mapper.movie(m) for m in rows.to_pylist()], arrow)

    return run(record)


def mapping_paths(own: list[str], mode: list[str], shared: list[str]) -> list[str]:
    """Paths of a call, else of its mode, else the shared ones; without repeats."""
    return list(dict.fromkeys(own or mode or shared))
