"""What can go wrong, each as an exception of its own."""

from __future__ import annotations


class QuarryError(Exception):
    """Base of all errors that this package raises."""

    exit_code = 1


class RuleError(QuarryError):
    """A name rule that cannot be used."""

    def __init__(self, rule: str, reason: str):
        super().__init__(f"name rule {rule!r}: {reason}")
        self.rule, self.reason = rule, reason


class TemplateError(QuarryError):
    """A path template that cannot be used."""

    def __init__(self, template: str, reason: str):
        super().__init__(f"template {template!r}: {reason}")
        self.template, self.reason = template, reason


class UnknownFieldError(TemplateError):
    def __init__(self, template: str, field: str):
        super().__init__(template, f"unknown field {field!r}")
        self.field = field


class QueryError(QuarryError):
    """A selector or path that does not parse: kind, place and a snippet with a caret."""

    def __init__(self, kind: str, query: str, at: int, detail: str = ""):
        before = query[:at]
        self.kind, self.query, self.at = kind, query, at
        self.line, self.column = before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1
        text = query.split("\n")[self.line - 1] if query else ""
        super().__init__(f"{kind} at line {self.line}, column {self.column}{': ' + detail if detail else ''}\n{text}\n{' ' * (self.column - 1)}^")


class UnsupportedXPath(QuarryError):
    """A construct that is grammatical but outside what is evaluated."""

    FEATURES = ("expression", "axis", "node test", "kind test", "predicate", "function", "operator", "postfix step")
    HINT = "use the supported axes, node tests and predicates, or filter the result instead"

    def __init__(self, feature: str, detail: str):
        super().__init__(f"unsupported XPath {feature}: {detail}; {self.HINT}")
        self.feature, self.detail = feature, detail


class HtmlParseError(QuarryError):
    """A document that has parse errors where none are allowed."""

    def __init__(self, errors: list[str]):
        more = f"; ...and {len(errors) - 5} more" if len(errors) > 5 else ""
        super().__init__("; ".join(errors[:5]) + more)
        self.errors = errors


class MappingError(QuarryError):
    """A mapping file that cannot be read."""


class ConfigError(QuarryError):
    """A configuration with unknown keys or values of the wrong kind."""


class SourceError(QuarryError):
    """A source that breaks its contract, or gave nothing."""


class UrlRuleError(QuarryError):
    """An address pattern that cannot be used."""


class RequestRefused(QuarryError):
    """An address that is invalid, of another scheme, or not trusted."""


class NotEnabled(QuarryError):
    """A feature that needs a network or a browser."""


class TranslationError(QuarryError):
    """A translation that cannot be set up, or whose answer has the wrong shape."""


class PlanError(QuarryError):
    """A plan that would overwrite something or write outside its root."""


class NfoError(QuarryError):
    """A record that is not well-formed."""


def status_hint(status: int) -> str:
    """What an HTTP status suggests."""
    if status in (401, 403):
        return "access denied: check cookies, headers or region"
    if status == 429:
        return "too many requests: slow down or wait"
    return "server error: try again later" if 500 <= status <= 599 else "check the address and the request"


def script_frame(trace: str) -> str | None:
    """The first line of a script trace that names a place in a script."""
    return next((x.strip() for x in trace.splitlines() if ".lua:" in x or "[string" in x), None)
