"""CSS selectors: parsed once, matched on trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import QueryError
from ..html.tree import HTML, Tree, ascii_lower, tokens

_IDENT = re.compile(r"-?(?:[A-Za-z_\u0080-\U0010FFFF]|\\[^\n])(?:[\w\u0080-\U0010FFFF-]|\\[^\n])*|--(?:[\w\u0080-\U0010FFFF-]|\\[^\n])*", re.A)
_HASH = re.compile(r"(?:[\w\u0080-\U0010FFFF-]|\\[^\n])+", re.A)
_SPACE = re.compile(r"(?:[ \t\n\f\r]|/\*.*?\*/)*", re.S)
_STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'', re.S)
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I | re.A)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|(.))", re.S)
# Attributes whose values HTML compares without case.
CASELESS = frozenset(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame hreflang "
    "http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape target text type valign "
    "valuetype vlink".split()
)
STRUCTURAL = ("root", "empty", "first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "scope")
NTH = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
LISTS = ("is", "where", "not", "has")


@dataclass
class Compound:
    """Simple selectors of one element, and how the one before it stands to it."""

    tests: list[tuple] = field(default_factory=list)
    combinator: str = ""  # to the compound before: " ", ">", "+", "~"


@dataclass
class Selector:
    """A list of complex selectors, each a list of compounds from left to right."""

    query: str
    alternatives: list[list[Compound]]

    def to_css(self) -> str:
        return ", ".join("".join(_shown(c) for c in x) for x in self.alternatives)


def _shown(c: Compound) -> str:
    out = {"": "", " ": " "}.get(c.combinator, f" {c.combinator} ")
    for kind, *v in c.tests:
        if kind == "type":
            out += v[0]
        elif kind == "id":
            out += "#" + v[0]
        elif kind == "class":
            out += "." + v[0]
        elif kind == "attr":
            out += f"[{'*|' * v[4]}{v[0]}{v[1]}{'"' + v[2] + '"' if v[1] else ''}]"
        elif kind == "nth":
            out += f":{v[0]}({v[1]}n{v[2]:+d})"
        elif kind == "list":
            out += f":{v[0]}({', '.join(''.join(map(_shown, x)) for x in v[1])})"
        else:
            out += f":{v[0]}"
    return out or "*"


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: (chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "�") if m[1] else m[2], text)


class _Parser:
    def __init__(self, query: str):
        self.q, self.at = query, 0

    def fail(self, kind: str, detail: str = "") -> QueryError:
        return QueryError(kind, self.q, self.at, detail)

    def skip(self) -> bool:
        m = _SPACE.match(self.q, self.at)
        self.at = m.end()
        return bool(m[0])

    def peek(self, n: int = 1) -> str:
        return self.q[self.at : self.at + n]

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.q, self.at)
        if m and m.end() > self.at:
            self.at = m.end()
            return m
        return None

    def ident(self) -> str:
        m = self.take(_IDENT)
        if not m:
            raise self.fail("unexpected token" if self.peek() else "unexpected end", repr(self.peek()) if self.peek() else "")
        return _plain(m[0])

    def list(self, end: str = "", relative: bool = False) -> list[list[Compound]]:
        out = []
        while True:
            out.append(self.complex(end, relative))
            self.skip()
            if self.peek() == ",":
                self.at += 1
                continue
            if self.peek() == end:
                self.at += len(end)
                return out
            raise self.fail("unexpected token" if self.peek() else "unexpected end", repr(self.peek()))

    def complex(self, end: str, relative: bool) -> list[Compound]:
        self.skip()
        combinator, out = "", []
        if relative:
            combinator = " "
            if self.peek() and self.peek() in ">+~":
                combinator = self.peek()
                self.at += 1
                self.skip()
        while True:
            compound = self.compound()
            compound.combinator = combinator
            out.append(compound)
            spaced = self.skip()
            c = self.peek()
            if c and c in ">+~":
                combinator = c
                self.at += 1
                self.skip()
            elif not c or c == "," or c == end:
                return out
            elif spaced:
                combinator = " "
            else:
                raise self.fail("unexpected token", repr(c))

    def compound(self) -> Compound:
        out = Compound()
        if self.peek() == "*" or _IDENT.match(self.q, self.at) or self.peek() == "|":
            name = "*" if self.peek() == "*" else "" if self.peek() == "|" else self.ident()
            self.at += name == "*"
            if self.peek() == "|" and self.peek(2) != "|=":
                if name not in ("*", ""):
                    raise self.fail("unknown namespace", repr(name))
                self.at += 1
                name = "*" if self.peek() == "*" else self.ident()
                self.at += name == "*"
            out.tests.append(("type", name))
        while c := self.peek():
            if c == "#":
                self.at += 1
                m = self.take(_HASH)
                if not m or not _IDENT.fullmatch(m[0]):
                    raise self.fail("bad id")
                out.tests.append(("id", _plain(m[0])))
            elif c == ".":
                self.at += 1
                if not _IDENT.match(self.q, self.at):
                    raise self.fail("bad class")
                out.tests.append(("class", self.ident()))
            elif c == "[":
                out.tests.append(self.attribute())
            elif c == ":":
                out.tests.append(self.pseudo())
            else:
                break
        if not out.tests:
            raise self.fail("unexpected token" if self.peek() else "empty selector", repr(self.peek()) if self.peek() else "")
        return out

    def attribute(self) -> tuple:
        self.at += 1
        self.skip()
        spaces = self.peek(2) == "*|"  # attributes of any namespace, else of none
        if spaces:
            self.at += 2
        elif self.peek() == "|":
            self.at += 1
        name = self.ident()
        self.skip()
        if self.peek() == "]":
            self.at += 1
            return "attr", name, "", "", "", spaces
        m = self.take(re.compile(r"[~|^$*]?="))
        if not m:
            raise self.fail("bad attribute", repr(self.peek()))
        self.skip()
        s = self.take(_STRING)
        value = _plain(s[1] if s[1] is not None else s[2]) if s else "" if _STRING.match(self.q, self.at) else self.ident()
        if not s and _STRING.match(self.q, self.at):
            self.at = _STRING.match(self.q, self.at).end()
        self.skip()
        flag = self.take(re.compile(r"[iIsS]"))
        self.skip()
        if self.peek() != "]":
            raise self.fail("bad attribute", repr(self.peek()))
        self.at += 1
        return "attr", name, m[0], value, flag[0].lower() if flag else "", spaces

    def pseudo(self) -> tuple:
        start = self.at
        self.at += 1
        if self.peek() == ":":
            raise self.fail("unsupported pseudo-element")
        name = ascii_lower(self.ident())
        if self.peek() == "(":
            self.at += 1
            if name in LISTS:
                return "list", name, self.list(")", relative=name == "has")
            if name in NTH:
                m = _NTH.match(self.q, self.at)
                if not m or self.q[m.end() : m.end() + 1] != ")":
                    raise self.fail("bad nth expression")
                self.at = m.end() + 1
                if m[1]:
                    return "nth", name, 2, int(m[1].lower() == "odd")
                if m[5]:
                    return "nth", name, 0, int(m[5])
                step = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
                return "nth", name, step, int((m[3] or "+") + (m[4] or "0"))
        elif name in STRUCTURAL:
            return "pseudo", name
        self.at = start
        raise self.fail("unsupported pseudo-class", repr(name))


def parse_css(query: str) -> Selector:
    """The parsed selector; raises QueryError. Pseudo-elements and all pseudo-classes but the structural ones are errors."""
    return Selector(query, _Parser(query).list())


class Matcher:
    """A selector on one tree; :scope is the scope element, if there is one."""

    def __init__(self, tree: Tree, scope: int | None = None):
        self.tree, self.scope, self.fold = tree, scope, tree.quirks == "quirks"
        self.where: dict[int, dict[int, int]] = {}

    def elements(self, node: int) -> list[int]:
        """Element children of the node's parent."""
        return [n for n in self.tree.siblings(node) if self.tree.kind[n] == "element"]

    def index(self, node: int) -> int:
        p = self.tree.parent[node]
        key = -1 if p is None else p
        if key not in self.where:
            self.where[key] = {n: k for k, n in enumerate(self.elements(node))}
        return self.where[key][node]

    def matches(self, node: int, alternatives: list[list[Compound]]) -> bool:
        return any(self.ends(node, x, len(x) - 1) for x in alternatives)

    def ends(self, node: int, compounds: list[Compound], k: int, anchor: int | None = None) -> bool:
        """Whether the node is the subject of the first k + 1 compounds; anchor: what the first is relative to."""
        if not all(self.holds(node, t) for t in compounds[k].tests):
            return False
        how = compounds[k].combinator
        if k == 0:
            return anchor is None or any(n == anchor for n in self.before(node, how))
        return any(self.ends(n, compounds, k - 1, anchor) for n in self.before(node, how))

    def before(self, node: int, combinator: str):
        t = self.tree
        if combinator in (" ", ">"):
            p = t.parent[node]
            while p is not None and t.kind[p] == "element":
                yield p
                if combinator == ">":
                    return
                p = t.parent[p]
        else:
            own = self.elements(node)
            at = self.index(node)
            yield from own[at - 1 : at] if combinator == "+" and at else own[:at][::-1] if combinator == "~" else ()

    def holds(self, node: int, test: tuple) -> bool:
        t, kind = self.tree, test[0]
        if kind == "type":
            return test[1] == "*" or t.name[node] == (ascii_lower(test[1]) if t.ns[node] == HTML else test[1])
        if kind == "id":
            own = t.attr(node, "id")
            return own is not None and (own == test[1] or self.fold and ascii_lower(own) == ascii_lower(test[1]))
        if kind == "class":
            own = tokens(t.attr(node, "class") or "")
            return test[1] in own or self.fold and ascii_lower(test[1]) in map(ascii_lower, own)
        if kind == "attr":
            name = ascii_lower(test[1]) if t.ns[node] == HTML else test[1]
            return any(n == name and (test[5] or not ns) and self.value_fits(node, v, test) for n, ns, v in t.attrs[node])
        if kind == "nth":
            return self.nth(node, *test[1:])
        if kind == "list":
            if test[1] == "not":
                return not self.matches(node, test[2])
            if test[1] != "has":
                return self.matches(node, test[2])
            return any(self.has(node, x) for x in test[2])
        name = test[1]
        if name == "root":
            p = t.parent[node]
            return p is not None and t.kind[p] == "document"
        if name == "scope":
            return node == self.scope
        if name == "empty":
            return not any(t.kind[c] == "element" or t.kind[c] == "text" and t.text[c] for c in t.children[node])
        side = {"first": ("",), "last": ("-last",), "only": ("", "-last")}[name.partition("-")[0]]
        return all(self.nth(node, f"nth{s}-{'of-type' if name.endswith('of-type') else 'child'}", 0, 1) for s in side)

    def value_fits(self, node: int, value: str, test: tuple) -> bool:
        _, name, op, wanted, flag, _ = test
        if not op:
            return True
        if flag == "i" or not flag and ascii_lower(name) in CASELESS and self.tree.ns[node] == HTML:
            value, wanted = ascii_lower(value), ascii_lower(wanted)
        if op == "=":
            return value == wanted
        if op == "~=":
            return wanted in tokens(value) and wanted != ""
        if op == "|=":
            return value == wanted or value.startswith(wanted + "-")
        return wanted != "" and {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](wanted)

    def nth(self, node: int, kind: str, step: int, offset: int) -> bool:
        if kind.endswith("of-type"):
            same = [n for n in self.elements(node) if (self.tree.name[n], self.tree.ns[n]) == (self.tree.name[node], self.tree.ns[node])]
            at, n = same.index(node), len(same)
        else:
            at = self.index(node)
            n = len(self.where[-1 if self.tree.parent[node] is None else self.tree.parent[node]])
        place = n - at if "-last-" in kind else at + 1
        gap = place - offset
        return gap == 0 if step == 0 else gap % step == 0 and gap // step >= 0

    def has(self, node: int, compounds: list[Compound]) -> bool:
        first = compounds[0].combinator
        if first in (" ", ">"):
            pool = self.tree.walk(node, False)
        else:
            own = self.elements(node)
            pool = (n for s in own[self.index(node) + 1 :] for n in self.tree.walk(s))
        return any(self.tree.kind[n] == "element" and self.ends(n, compounds, len(compounds) - 1, node) for n in pool)


def find_css(tree: Tree, selector: Selector, node: int | None = None) -> list[int]:
    """Matching elements in document order, the start node included. Ancestors beyond it are seen."""
    start = 0 if node is None else node
    scope = tree.root_element() if start == 0 else start if tree.kind[start] == "element" else None
    m = Matcher(tree, scope)
    kind, name = tree.kind, tree.name
    wanted = [next((ascii_lower(t[1]) for t in x[-1].tests if t[0] == "type" and t[1] != "*"), None) for x in selector.alternatives]
    if None not in wanted:  # a cheap test of names first
        return [n for n in tree.walk(start) if kind[n] == "element" and (name[n] in wanted or ascii_lower(name[n]) in wanted) and m.matches(n, selector.alternatives)]
    return [n for n in tree.walk(start) if kind[n] == "element" and m.matches(n, selector.alternatives)]


def simple_test(selector: Selector) -> list[tuple] | None:
    """Tests of a selector of one compound, None for others."""
    one = selector.alternatives
    return one[0][0].tests if len(one) == 1 and len(one[0]) == 1 else None


