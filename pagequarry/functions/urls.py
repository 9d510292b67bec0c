"""Trusted-address rules and small functions of addresses."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestRefused, UrlRuleError
from .text import ascii_lower, file_name

_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)")
_PORTS = {"http": 80, "https": 443}


@dataclass(frozen=True)
class UrlRule:
    """An allowed scheme, host (exact, or any one label before a suffix), port, and path prefix or glob."""

    scheme: str
    host: str
    wildcard: bool
    port: int | None
    path: str

    @classmethod
    def parse(cls, text: str) -> UrlRule:
        m = _URL.match(text.strip())
        if not m or m[1].lower() not in _PORTS or not m[2]:
            raise UrlRuleError(f"not an http or https pattern: {text!r}")
        scheme, authority, path = m[1].lower(), m[2], m[3] or "/"
        wildcard = authority.startswith("*.")
        if wildcard and "@" in authority:
            raise UrlRuleError(f"no user information with a host wildcard: {text!r}")
        host, _, port = (authority[2:] if wildcard else authority.rpartition("@")[2]).partition(":")
        if not host or "*" in host or (port and not port.isdigit()):
            raise UrlRuleError(f"bad host: {text!r}")
        number = int(port) if port else None
        return cls(scheme, host.lower(), wildcard, None if number == _PORTS[scheme] else number, path)

    def allows(self, url: str) -> bool:
        """As matches(), for one address without Spark."""
        if not (m := _URL.match(url)):
            return False
        authority, path = m[2].rpartition("@")[2], m[3] or "/"
        host, port = (g.lower() if g else None for g in re.fullmatch(r"(.*?)(?::([0-9]*))?", authority, re.S).groups())
        number = int(port) if port else None
        number = None if number == _PORTS.get(m[1].lower()) else number
        host = host or ""
        host_fits = bool(re.fullmatch(r"[^.]+\." + re.escape(self.host), host)) if self.wildcard else host == self.host
        if "*" in self.path:
            path_fits = bool(re.fullmatch("[^/]*".join(map(re.escape, self.path.split("*"))), path))
        else:
            path_fits = path.startswith(self.path)
        return m[1].lower() == self.scheme and host_fits and number == self.port and path_fits

    def matches(self, url: Column) -> Column:
        scheme, host, port, path = url_parts(url)
        host_fits = host.rlike(rf"^[^.]+\.{re.escape(self.host)}\z") if self.wildcard else host == self.host
        if "*" in self.path:
            path_fits = path.rlike("^" + "[^/]*".join(map(re.escape, self.path.split("*"))) + r"\z")
        else:
            path_fits = F.startswith(path, F.lit(self.path))
        return F.coalesce((scheme == self.scheme) & host_fits & port.eqNullSafe(F.lit(self.port)) & path_fits, F.lit(False))


def url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, host, port (null if the scheme's own) and path of an address."""
    part = lambda k: F.regexp_extract(url, _URL.pattern, k)
    scheme, authority = ascii_lower(part(1)), F.regexp_replace(part(2), r"^.*@", "")
    port = F.nullif(F.regexp_extract(authority, r":([0-9]+)\z", 1), F.lit("")).cast("int")
    own = F.when(scheme == "http", 80).when(scheme == "https", 443)
    return scheme, ascii_lower(F.regexp_replace(authority, r":[0-9]*\z", "")), F.when(~port.eqNullSafe(own), port), F.when(part(3) == "", "/").otherwise(part(3))


def is_trusted(url: Column, rules: list[str]) -> Column:
    return reduce(Column.__or__, [UrlRule.parse(r).matches(url) for r in rules], F.lit(False))


def check_request(url: Column, rules: list[str]) -> Column:
    """Why a request is refused: invalid, scheme, host or untrusted; null if it may go."""
    scheme, host, _, _ = url_parts(url)
    return F.when(url.isNull() | (scheme == ""), "invalid").when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(~is_trusted(url, rules), "untrusted")


def why_refused(url: str | None, rules: list[str]) -> str | None:
    """As check_request(), for one address without Spark."""
    m = _URL.match(url or "")
    if not m:
        return "invalid"
    if m[1].lower() not in _PORTS:
        return "scheme"
    if not re.sub(r":[0-9]*\Z", "", m[2].rpartition("@")[2]):
        return "host"
    return None if any(UrlRule.parse(r).allows(url) for r in rules) else "untrusted"


def require_request(url: Column, rules: list[str]) -> Column:
    """The address, or an error that says why it is refused."""
    why = check_request(url, rules)
    return F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("refused, "), why, F.lit(": "), F.coalesce(url, F.lit("null"))))).otherwise(url)


def refuse(why: str, url: str) -> RequestRefused:
    return RequestRefused(f"{why}: {url}")


def image_extension(url: Column) -> Column:
    """Extension of an image's address in lower case, jpg unless it is 1 to 8 letters or digits."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*", ""), r"(?s)\?.*", "")
    found = ascii_lower(F.regexp_extract(file_name(bare), r"\.([A-Za-z0-9]{1,8})\z", 1))
    return F.when(found == "", "jpg").otherwise(found)


def image_action(url: Column) -> Column:
    """fetch for https, refuse for http, keep for anything else."""
    low = ascii_lower(url)
    return F.when(F.startswith(low, F.lit("https://")), "fetch").when(F.startswith(low, F.lit("http://")), "refuse").otherwise("keep")
