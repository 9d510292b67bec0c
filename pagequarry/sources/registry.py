"""Sources: functions that give a record for a name, and what they may fetch."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotEnabled, SourceError, status_hint
from ..functions.urls import UrlRule, refuse, why_refused
from ..operators.extract import Spec, extract
from ..operators.movie import MOVIE
from .tasklog import task
from .throttle import Slots

USER_AGENT = "pagequarry/0.1"


@dataclass(frozen=True)
class Source:
    """alias: its name; trusted_urls: patterns of what it may fetch; run: (name, path) to a record, XML text, or None.
    Or fields: a selection for each string field, evaluated by Spark on a page of the name."""

    alias: str
    trusted_urls: tuple[str, ...] = ()
    run: Callable | None = None
    fields: dict[str, Spec] | None = None


def source(alias: str, trusted_urls: list[str], registry: list[Source] | None = None) -> Callable:
    """Registers a function as a source."""

    def add(f: Callable) -> Source:
        made = check(Source(alias, tuple(trusted_urls), f))
        (SOURCES if registry is None else registry).append(made)
        return made

    return add


SOURCES: list[Source] = []


def check(s: Source) -> Source:
    """The source with its alias trimmed; raises if its contract is broken. Nothing is run."""
    if not isinstance(s.alias, str) or not s.alias.strip():
        raise SourceError("a source needs a non-empty alias")
    if not isinstance(s.trusted_urls, (list, tuple)) or not all(isinstance(u, str) for u in s.trusted_urls):
        raise SourceError(f"{s.alias}: trusted_urls must be a list of texts")
    for u in s.trusted_urls:
        UrlRule.parse(u)
    if not callable(s.run) and not s.fields:
        raise SourceError(f"{s.alias}: no run function")
    return Source(s.alias.strip(), tuple(s.trusted_urls), s.run, s.fields)


def trusted_union(sources: list[Source]) -> list[str]:
    """Patterns of all sources, each once, in order."""
    return list(dict.fromkeys(u for s in sources for u in s.trusted_urls))


def listing(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """ord, alias, trusted_urls, has_run, duplicate_alias_ignored of each source."""
    rows, seen = [], set()
    for k, s in enumerate(sources):
        rows.append((k, s.alias.strip(), list(s.trusted_urls), callable(s.run) or bool(s.fields), s.alias.strip() in seen))
        seen.add(s.alias.strip())
    return spark.createDataFrame(rows, "ord int, alias string, trusted_urls array<string>, has_run boolean, duplicate_alias_ignored boolean")


def counts(listed: DataFrame) -> DataFrame:
    """total, active and ignored sources of a listing."""
    ignored = F.sum(F.col("duplicate_alias_ignored").cast("long"))
    return listed.agg(F.count("*").alias("total"), (F.count("*") - ignored).alias("active"), ignored.alias("ignored"))


ATTEMPT = f"source_ord int, alias string, ok boolean, error string, raw_xml string, movie {MOVIE}"


def run_sources(names: DataFrame, sources: list[Source], limit: int | None, throttle_ms: int = 0, kind: str = "batch", workers: int = 1) -> DataFrame:
    """Runs function sources on every name (entity_id, name, path), in order, until the limit of successes.

    One row for each attempt: entity_id and ATTEMPT. A failure is a row with its error, so
    one entity never stops another. A record or XML text is a success; None is an error.
    throttle_ms: the pause between runs of one source, however many workers there are, about; 0
    for none. workers: how many names are worked on at a time; with a pause or several workers the
    names are dealt to so many partitions. What a source logs names its entity and the kind of task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..operators.movie import decode_output

    seen: dict[str, Source] = {}
    for s in map(check, sources):
        seen.setdefault(s.alias, s)
    active = list(seen.values())
    if not active:
        raise SourceError("no sources are configured")
    schema = T.StructType([names.schema["entity_id"], *T.DataType.fromDDL(ATTEMPT).fields])
    empty = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in T.DataType.fromDDL(MOVIE).fields}

    def run(batches):
        arrow, slots = to_arrow_schema(schema), Slots(throttle_ms, TaskContext.get().partitionId() % workers, workers)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                done = 0
                for k, s in enumerate(active):
                    if limit is not None and done >= limit:
                        break
                    out = {"entity_id": row["entity_id"], "source_ord": k, "alias": s.alias, "ok": True, "error": None, "raw_xml": None, "movie": None}
                    try:
                        args = (row["name"], row["path"]) if row.get("path") else (row["name"],)
                        with task(row["entity_id"], kind):
                            got = decode_output(s.alias, slots.run(s.alias, s.run, *args))
                        out |= {"raw_xml": got} if isinstance(got, str) else {"movie": empty | got}
                        done += 1
                    except Exception as e:
                        out |= {"ok": False, "error": str(e)}
                    rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    rows = names.select("entity_id", "name", "path")
    return (rows.repartition(workers) if workers > 1 or throttle_ms else rows).mapInArrow(run, schema)


def run_selections(pages: DataFrame, s: Source, id_col: str, html_col: str) -> DataFrame:
    """A source of selections on pages: entity_id and a struct of its fields, in one pass."""
    return pages.select(F.col(id_col).alias("entity_id"), extract(F.col(html_col), s.fields).alias("fields"))


# Fetching


@dataclass(frozen=True)
class Request:
    """Options of a fetch, validated: headers and the protocol version."""

    headers: tuple[tuple[str, str], ...] = ()
    version: str | None = None

    @classmethod
    def of(cls, options: dict | None) -> Request:
        """From a dict with headers and version, or of headers alone."""
        options = dict(options or {})
        nested = isinstance(options.get("headers"), dict) or "version" in options
        headers = options.get("headers", {}) if nested else options
        if not all(isinstance(k, str) and isinstance(v, str) for k, v in headers.items()):
            raise SourceError("headers must be texts")
        version = options.get("version") if nested else None
        # Spellings of protocol versions.
        known = {"1": "1.1", "1.0": "1.0", "1.1": "1.1", "http/1.0": "1.0", "http/1": "1.1", "http/1.1": "1.1", "2": "2", "2.0": "2", "h2": "2", "http/2": "2", "http/2.0": "2"}
        if version is not None and str(version).strip().lower() not in known:
            raise SourceError(f"unknown protocol version {version!r}")
        return cls(tuple(headers.items()), known[str(version).strip().lower()] if version is not None else None)


CHECKING: ContextVar[bool] = ContextVar("checking", default=False)  # while a source is only being looked at


def fetch(url: str, trusted: list[str], options: dict | None = None, post: bytes | None = None, timeout: float = 30.0) -> bytes:
    """The bytes of a trusted address, by GET, or by POST of some bytes; raises for any status but 2xx.

    Redirects have to be trusted, too. Protocol version 2 has no client here and raises, as
    does any fetch while a source is only being checked. For pages that are in a table already use lookup().
    """
    request = Request.of(options)
    if CHECKING.get():
        raise NotEnabled("no fetches while a source is only being checked")
    if request.version == "2":
        raise NotEnabled("protocol version 2 is not enabled")

    class Redirects(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            if why := why_refused(newurl, trusted):
                raise refuse(f"redirect, {why}", newurl)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    if why := why_refused(url, trusted):
        raise refuse(why, url)
    asked = urllib.request.Request(url, data=post, headers={"User-Agent": USER_AGENT, **dict(request.headers)})
    try:
        with urllib.request.build_opener(urllib.request.ProxyHandler({}), Redirects).open(asked, timeout=timeout) as answer:
            if not 200 <= answer.status < 300:
                raise SourceError(f"{url}: status {answer.status}, {status_hint(answer.status)}")
            return answer.read()
    except urllib.error.HTTPError as e:
        raise SourceError(f"{url}: status {e.code}, {status_hint(e.code)}") from None
    except OSError as e:
        raise SourceError(f"{url}: {e}") from None


def fetch_text(url: str, trusted: list[str], options: dict | None = None, post: bytes | None = None, timeout: float = 30.0) -> str:
    """As fetch(), read as UTF-8."""
    return fetch(url, trusted, options, post, timeout).decode("utf-8", "replace")


def lookup(wanted: DataFrame, pages: DataFrame, trusted: list[str]) -> DataFrame:
    """Pages (url, html) for wanted addresses (url): refused is why one may not be had, html its page if it may."""
    from ..functions.urls import check_request

    checked = wanted.withColumn("refused", check_request(F.col("url"), trusted))
    return checked.join(pages.select("url", "html").dropDuplicates(["url"]), "url", "left").withColumn("html", F.when(F.col("refused").isNull(), F.col("html")))
