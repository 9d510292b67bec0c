"""XPath: the executable part of the language, checked when parsed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import QueryError, UnsupportedXPath
from ..html.tree import Tree, ascii_lower

AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling")
OTHER_AXES = ("attribute", "namespace", "following", "preceding")
KINDS = ("node", "document-node", "element", "text", "comment", "processing-instruction")
OTHER_KINDS = ("attribute", "schema-element", "schema-attribute", "namespace-node", "item")
FUNCTIONS = ("contains", "starts-with")
NAMESPACES = {"": "", "html": "html", "xhtml": "html", "svg": "svg", "math": "math", "mathml": "math"}
WORDS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_TOKEN = re.compile(
    r"""\s*(?:\(:.*?:\)\s*)*(?:(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<op>::|//|\.\.|!=|<=|>=|\|\||<<|>>|=>|:=|[/@.()\[\],=<>|*+!?:$-])|(?P<name>[^\W\d][\w.-]*))""",
    re.S,
)
_F64 = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|infinity|nan)", re.I | re.A)


@dataclass
class Step:
    axis: str
    test: tuple  # ("name", namespace or None, local or None) or ("kind", kind, name or None)
    predicates: list[tuple] = field(default_factory=list)


@dataclass
class Path:
    """rooted: from the document whatever the context. attribute: the name of a lone attribute step ("*" for any)."""

    rooted: bool
    steps: list[Step]
    attribute: str | None = None


class _Parser:
    def __init__(self, query: str):
        self.q, self.tokens, at = query, [], 0
        while query[at:].strip():
            m = _TOKEN.match(query, at)
            if not m:
                raise QueryError("unexpected token", query, at + len(query[at:]) - len(query[at:].lstrip()))
            kind = m.lastgroup
            self.tokens.append((kind, m[kind], m.start(kind)))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        """The text of a token that is no string, else empty."""
        t = self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("", "", len(self.q))
        return "" if t[0] == "string" else t[1]

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else ""

    def place(self) -> int:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.q)

    def fail(self, kind: str = "") -> QueryError:
        return QueryError(kind or ("unexpected token" if self.at < len(self.tokens) else "unexpected end"), self.q, self.place())

    def accept(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise self.fail()

    def whole(self) -> Path:
        if not self.tokens:
            raise QueryError("empty path", self.q, 0)
        if self.kind() in ("string", "number") or self.peek() in ("(", "-", "+") or self.kind() == "name" and self.peek(1) == "(" and self.peek() not in KINDS + OTHER_KINDS:
            raise UnsupportedXPath("expression", f"only paths can be selected, not {self.q!r}")
        path = self.path()
        if path.attribute is not None:
            raise UnsupportedXPath("axis", "attribute")
        if self.at < len(self.tokens):
            if self.peek() in ("|", "union", "intersect", "except", ",", "or", "and", "=", "!=", "<", ">", "<=", ">=", "+", "-", "||", "=>", "to", "div", "mod", *WORDS):
                raise UnsupportedXPath("expression", f"{self.peek()!r} outside a predicate")
            if self.peek() in ("(", "?", "["):
                raise UnsupportedXPath("postfix step", self.peek())
            raise self.fail()
        return path

    def path(self) -> Path:
        steps: list[Step] = []
        rooted = self.peek() in ("/", "//")
        if self.accept("/"):
            if not self.begins_step():
                return Path(True, [])
        elif self.accept("//"):
            steps.append(Step("descendant-or-self", ("kind", "node", None)))
        while True:
            step = self.step()
            if isinstance(step, str):
                if rooted or steps or self.peek() in ("/", "//", "["):
                    raise UnsupportedXPath("axis", "attribute")
                return Path(False, [], step)
            steps.append(step)
            if self.accept("//"):
                steps.append(Step("descendant-or-self", ("kind", "node", None)))
            elif not self.accept("/"):
                return Path(rooted, steps)

    def begins_step(self) -> bool:
        return self.kind() == "name" or self.peek() in ("@", ".", "..", "*")

    def step(self) -> Step | str:
        if self.accept(".."):
            out = Step("parent", ("kind", "node", None))
        elif self.accept("."):
            out = Step("self", ("kind", "node", None))
        elif self.accept("@"):
            if self.accept("*"):
                return "*"
            if self.kind() != "name":
                raise self.fail()
            self.at += 1
            name = self.tokens[self.at - 1][1]
            if self.accept(":"):
                name = self.peek()
                self.at += 1
            return name
        else:
            axis = "child"
            if self.kind() == "name" and self.peek(1) == "::":
                axis = self.peek()
                self.at += 2
                if axis in OTHER_AXES:
                    raise UnsupportedXPath("axis", axis)
                if axis not in AXES:
                    self.at -= 2
                    raise self.fail("unknown axis")
            elif self.peek() == "(" or self.kind() in ("string", "number"):
                raise UnsupportedXPath("postfix step", self.peek() or self.tokens[self.at][1])
            out = Step(axis, self.test())
        while self.accept("["):
            out.predicates.append(self.predicate())
            self.expect("]")
        return out

    def test(self) -> tuple:
        if self.accept("*"):
            if self.accept(":"):
                if self.kind() != "name":
                    raise self.fail()
                self.at += 1
                return "name", None, self.tokens[self.at - 1][1]
            return "name", None, None
        if self.kind() != "name":
            raise self.fail()
        name = self.peek()
        self.at += 1
        if self.peek() == "(":
            if name in OTHER_KINDS:
                raise UnsupportedXPath("kind test", f"{name}()")
            if name not in KINDS:
                raise UnsupportedXPath("postfix step", f"{name}()")
            self.at += 1
            inner = None
            if not self.accept(")"):
                if name not in ("element", "processing-instruction"):
                    raise UnsupportedXPath("kind test", f"{name}() with an argument")
                inner = None if self.peek() == "*" else self.tokens[self.at][1].strip("\"'")
                self.at += 1
                self.expect(")")
            return "kind", name, inner
        if self.peek() == ":" and (self.kind(1) == "name" or self.peek(1) == "*"):
            if name not in NAMESPACES:
                self.at -= 1
                raise self.fail("unknown prefix")
            self.at += 2
            local = self.tokens[self.at - 1][1]
            return "name", NAMESPACES[name], None if local == "*" else local
        return "name", None, name

    def predicate(self) -> tuple:
        if self.kind() == "number" and self.peek().isdigit() and self.peek(1) == "]":
            self.at += 1
            return "position", int(self.tokens[self.at - 1][1])
        if self.kind() == "name" and self.peek(1) == "(" and self.peek() in FUNCTIONS:
            name = self.peek()
            self.at += 2
            left = self.operand()
            self.expect(",")
            right = self.operand()
            self.expect(")")
            if self.peek() != "]":
                raise UnsupportedXPath("function", f"{name}() within an expression")
            return "call", name, left, right
        return self.either()

    def either(self) -> tuple:
        left = self.both()
        while self.peek() == "or":
            self.at += 1
            left = "or", left, self.both()
        return left

    def both(self) -> tuple:
        left = self.comparison()
        while self.peek() == "and":
            self.at += 1
            left = "and", left, self.comparison()
        return left

    def comparison(self) -> tuple:
        left = self.operand()
        op = self.peek()
        if op in ("=", "!=", "<", "<=", ">", ">=") or op in WORDS and self.kind() == "name":
            self.at += 1
            return "compare", WORDS.get(op, op), left, self.operand()
        if op in ("+", "-", "*", "|", "||", "<<", ">>", "=>", "div", "mod", "idiv", "to", "is", "union", "intersect", "except"):
            raise UnsupportedXPath("operator", op)
        return left

    def operand(self) -> tuple:
        kind = self.kind()
        if kind == "string":
            self.at += 1
            text = self.tokens[self.at - 1][1]
            return "string", text[1:-1].replace(text[0] * 2, text[0])
        if kind == "number":
            self.at += 1
            return "number", float(self.tokens[self.at - 1][1])
        if self.accept("("):
            if self.accept(")"):
                return "string", ""
            inner = self.either()
            if self.peek() == ",":
                raise UnsupportedXPath("expression", "sequence")
            self.expect(")")
            return ("truth", inner) if inner[0] in ("or", "and", "compare") else inner
        if self.peek() in ("-", "+", "!", "?", "$"):
            raise UnsupportedXPath("operator", self.peek())
        if kind == "name" and self.peek(1) == "(" and self.peek() not in KINDS + OTHER_KINDS:
            raise UnsupportedXPath("function", f"{self.peek()}()")
        return "path", self.path()


@dataclass
class XPath:
    query: str
    path: Path


def parse_xpath(query: str) -> XPath:
    """The parsed path. QueryError if it is none; UnsupportedXPath, at once, if it holds what is not evaluated."""
    return XPath(query, _Parser(query).whole())


class _Evaluator:
    def __init__(self, tree: Tree):
        self.tree = tree

    def path(self, path: Path, context: int) -> list[int]:
        nodes = [0] if path.rooted else [context]
        for step in path.steps:
            if len(nodes) == 1:
                nodes = self.step(step, nodes[0])
            elif step.axis == "child":  # children of different nodes differ
                kids = self.tree.children
                nodes = [m for n in nodes if kids[n] for m in self.step(step, n)]
            else:
                nodes = list(dict.fromkeys(m for n in nodes for m in self.step(step, n)))
        return nodes

    def step(self, step: Step, node: int) -> list[int]:
        found = self.tested(self.axis(step.axis, node), step.test)
        for p in step.predicates:
            if p[0] == "position":
                found = found[p[1] - 1 : p[1]] if p[1] > 0 else []
            else:
                found = [n for n in found if self.truth(self.value(p, n))]
        return found

    def axis(self, axis: str, node: int):
        t = self.tree
        if axis == "child":
            return t.children[node]
        if axis in ("descendant", "descendant-or-self"):
            return t.walk(node, axis != "descendant")
        if axis == "self":
            return [node]
        if axis in ("following-sibling", "preceding-sibling"):
            own = t.siblings(node)
            at = own.index(node)
            return own[at + 1 :] if axis[0] == "f" else own[:at][::-1]
        up, p = [node] if axis == "ancestor-or-self" else [], t.parent[node]
        while p is not None:
            up.append(p)
            if axis == "parent":
                break
            p = t.parent[p]
        return up

    def tested(self, nodes, test: tuple) -> list[int]:
        if test[:2] == ("kind", "node"):
            return list(nodes)
        if test[0] == "name" and not test[1] and test[2] is not None:
            kind, name, local, low = self.tree.kind, self.tree.name, test[2], ascii_lower(test[2])
            return [n for n in nodes if kind[n] == "element" and (name[n] == local or ascii_lower(name[n]) == low)]
        return [n for n in nodes if self.test(n, test)]

    def test(self, node: int, test: tuple) -> bool:
        t = self.tree
        if test[0] == "name":
            _, ns, local = test
            return t.kind[node] == "element" and (not ns or t.ns[node] == ns) and (local is None or ascii_lower(t.name[node]) == ascii_lower(local))
        _, kind, name = test
        if kind == "node":
            return True
        if kind == "document-node":
            return t.kind[node] == "document"
        return t.kind[node] == kind.replace("-", "_") and (name is None or ascii_lower(t.name[node] or "") == ascii_lower(name))

    def value(self, e: tuple, node: int) -> tuple:
        kind = e[0]
        if kind in ("string", "number"):
            return e
        if kind == "path":
            path = e[1]
            if path.attribute == "*":
                return "attribute", "" if self.tree.attrs[node] else None
            if path.attribute is not None:
                return "attribute", self.tree.attr(node, path.attribute) if self.tree.kind[node] == "element" else None
            return "nodes", self.path(path, node)
        if kind == "truth":
            return "number", float(self.truth(self.value(e[1], node)))
        if kind in ("and", "or"):
            a, b = self.truth(self.value(e[1], node)), self.truth(self.value(e[2], node))
            return "number", float(a and b if kind == "and" else a or b)
        if kind == "call":
            a, b = self.text(self.value(e[2], node)), self.text(self.value(e[3], node))
            return "number", float(b in a if e[1] == "contains" else a.startswith(b))
        _, op, left, right = e
        a, b = self.value(left, node), self.value(right, node)
        if op in ("=", "!="):
            return "number", float((self.text(a) == self.text(b)) == (op == "="))
        x, y = self.number(a), self.number(b)
        return "number", float({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])

    def truth(self, v: tuple) -> bool:
        return v[1] is not None if v[0] == "attribute" else bool(v[1])

    def text(self, v: tuple) -> str:
        """The first node's text, an absent attribute's is empty, whole numbers have no fraction."""
        if v[0] == "nodes":
            return self.string(v[1][0]) if v[1] else ""
        if v[0] == "number":
            return str(int(v[1])) if v[1].is_integer() else repr(v[1])
        return v[1] or ""

    def number(self, v: tuple) -> float:
        if v[0] == "number":
            return v[1]
        text = self.text(v)
        if not _F64.fullmatch(text):
            raise UnsupportedXPath("predicate", f"{text!r} is no number")
        return float(text)

    def string(self, node: int) -> str:
        kind = self.tree.kind[node]
        if kind in ("element", "document"):
            return self.tree.text_content(node)
        return self.tree.text[node] or ""


def find_xpath(tree: Tree, xpath: XPath, node: int | None = None) -> list[int]:
    """Nodes in the order in which the steps find them, each once; never sorted."""
    return _Evaluator(tree).path(xpath.path, 0 if node is None else node)
