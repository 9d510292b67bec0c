"""What a browser session would be given, checked; there is no browser here."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import NotEnabled, SourceError


@dataclass(frozen=True)
class Cookie:
    name: str
    value: str
    url: str | None = None
    domain: str | None = None
    path: str | None = None
    secure: bool | None = None
    http_only: bool | None = None
    expires: float | None = None


# Of each field: the types it may have, and what they are called.
_FIELDS = {
    **dict.fromkeys(("name", "value", "url", "domain", "path"), (str, "a text")),
    **dict.fromkeys(("secure", "http_only"), (bool, "a truth value")),
    "expires": ((int, float), "a number"),
}


def cookies(value: object) -> list[Cookie]:
    """Cookies from a list of dicts; raises with the place, from 1, and the field that is wrong. Other fields are left alone."""
    if not isinstance(value, (list, tuple)):
        raise SourceError(f"cookies must be a list, not {type(value).__name__}")
    out = []
    for at, entry in enumerate(value, 1):
        if not isinstance(entry, dict):
            raise SourceError(f"cookie {at} must be a table, not {type(entry).__name__}")
        for name in ("name", "value"):
            if entry.get(name) is None:
                raise SourceError(f"cookie {at} has no {name}")
        for name, (kind, told) in _FIELDS.items():
            own = entry.get(name)
            if own is not None and (not isinstance(own, kind) or kind is not bool and isinstance(own, bool)):
                raise SourceError(f"cookie {at}: {name} must be {told}, not {type(own).__name__}")
        expires = entry.get("expires")
        out.append(Cookie(*(entry.get(n) for n in ("name", "value", "url", "domain", "path", "secure", "http_only")), None if expires is None else float(expires)))
    return out


def told(found: list[dict]) -> list[dict]:
    """Cookies of a session as a source sees them: all fields, in one order."""
    return [{n: c.get(n) for n in ("name", "value", "domain", "path", "expires", "secure", "http_only", "session")} for c in found]


def session(*_, **__):
    raise NotEnabled("browser sessions are not enabled")
