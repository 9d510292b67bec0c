"""HTML parsing by the published algorithm of the HTML standard: tokens, then tree construction."""

from __future__ import annotations

import re

from ..errors import HtmlParseError
from .entities import decode
from .tree import HTML, MATH, SVG, Tree, ascii_lower

# Sets of element names that the standard defines.
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta "
    "nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th "
    "thead title tr track ul wbr xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, frozenset(("html", "table", "template"))
MATH_SCOPE = frozenset("mi mo mn ms mtext annotation-xml".split())
SVG_SCOPE = frozenset("foreignObject desc title".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IMPLIED_ALL = IMPLIED | frozenset("caption colgroup tbody td tfoot th thead tr".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split()
)
CLOSED_BLOCKS = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike "
    "sub sup table tt u ul var".split()
)
RAW = {"title": "rcdata", "textarea": "rcdata", "style": "raw", "xmp": "raw", "iframe": "raw", "noembed": "raw", "noframes": "raw", "noscript": "raw", "script": "script"}
SVG_NAMES = {
    x.lower(): x
    for x in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite "
        "feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge "
        "feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    ).split()
}
SVG_ATTRS = {
    x.lower(): x
    for x in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits "
        "kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits "
        "numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX "
        "refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles "
        "surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    ).split()
}
QUIRKY = (
    "+//silmaril//dtd html pro v0r11 19970101//", "-//as//dtd html 3.0 aswedit + extensions//", "-//advasoft ltd//dtd html 3.0 aswedit + extensions//", "-//ietf//dtd html",
    "-//metrius//dtd metrius presentational//", "-//microsoft//dtd internet explorer", "-//netscape comm. corp.//dtd", "-//o'reilly and associates//dtd html",
    "-//softquad", "-//spyglass//dtd html 2.0 extended//", "-//sq//dtd html 2.0 hotmetal", "-//sun microsystems corp.//dtd hotjava", "-//w3c//dtd html 3", "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//", "-//w3c//dtd html experimental", "-//w3c//dtd w3 html", "-//w3o//dtd w3 html", "-//webtechs//dtd mozilla html",
)

_SPACE = " \t\n\f\r"
_TAG_OPEN = re.compile(r"<(?=[A-Za-z/!?])")
_NAME = re.compile(r"[^\t\n\f />]*")
_ATTR_NAME = re.compile(r"=?[^\t\n\f />=]*")
_BLANKS = re.compile(r"[\t\n\f ]*")
_GAP = re.compile(r"[\t\n\f /]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
_PLAIN_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)>")
_PLAIN_ATTR = re.compile(r'[\t\n\f ]+([a-z][a-z0-9:_-]*)="([^"&\0]*)"')  # without references and capitals


class _Tokens:
    """The tokenizer: a place in the text; the tree builder says how to read on."""

    def __init__(self, text: str, errors: list[str]):
        self.text, self.at, self.errors = text, 0, errors

    def next(self) -> tuple | None:
        """char, start, end, comment or doctype; None at the end."""
        text, at = self.text, self.at
        if at >= len(text):
            return None
        if text[at] != "<" or not _TAG_OPEN.match(text, at):
            m = _TAG_OPEN.search(text, at + 1)
            self.at = m.start() if m else len(text)
            return "char", decode(text[at : self.at], errors=self.errors)
        if m := _PLAIN_TAG.match(text, at):
            self.at = m.end()
            return "end" if m[1] else "start", m[2], [], False
        c = text[at + 1]
        if c == "!":
            return self._declaration()
        if c == "?":
            self.errors.append("processing instruction in HTML")
            return self._bogus(at + 1)
        if c == "/":
            after = text[at + 2 : at + 3]
            if after == ">":
                self.errors.append("end tag without a name")
                self.at = at + 3
                return self.next()
            if not (after.isascii() and after.isalpha()):
                if not after:
                    self.at = len(text)
                    return "char", "</"
                self.errors.append("bad end tag")
                return self._bogus(at + 2)
            return self._tag(at + 2, "end")
        return self._tag(at + 1, "start")

    def _bogus(self, start: int) -> tuple:
        end = self.text.find(">", start)
        self.at = len(self.text) if end < 0 else end + 1
        return "comment", self.text[start : len(self.text) if end < 0 else end].replace("\0", "�")

    def _declaration(self) -> tuple:
        text, at = self.text, self.at
        if text.startswith("<!--", at):
            start = at + 4
            for short in (">", "->"):
                if text.startswith(short, start):
                    self.errors.append("comment closed early")
                    self.at = start + len(short)
                    return "comment", ""
            m = re.compile("--!?>").search(text, start)
            if not m:
                self.errors.append("comment without an end")
                self.at = len(text)
                return "comment", re.sub("--?!?$", "", text[start:]).replace("\0", "�")
            self.at = m.end()
            return "comment", text[start : m.start()].replace("\0", "�")
        if text[at + 2 : at + 9].lower() == "doctype":
            end = text.find(">", at)
            body = text[at + 9 : len(text) if end < 0 else end]
            self.at = len(text) if end < 0 else end + 1
            m = re.match(r"""\s*([^\s>]*)\s*(?:(public)\s*(?:"([^"]*)"|'([^']*)')?\s*(?:"([^"]*)"|'([^']*)')?|(system)\s*(?:"([^"]*)"|'([^']*)')?)?""", body, re.I)
            public, system = (m[3] if m[3] is not None else m[4]), next((g for g in (m[5], m[6], m[8], m[9]) if g is not None), None)
            bad = end < 0 or not m[1] or bool(m[2] and public is None) or bool(m[7] and system is None) or (not m[2] and not m[7] and bool(body[m.end() :].strip()))
            return "doctype", ascii_lower(m[1]), public, system, bad
        if text.startswith("<![CDATA[", at) and self.cdata:
            end = text.find("]]>", at)
            start, stop = at + 9, len(text) if end < 0 else end
            self.at = len(text) if end < 0 else end + 3
            return "char", text[start:stop]
        self.errors.append("bad declaration")
        return self._bogus(at + 2)

    cdata = False

    def _tag(self, start: int, kind: str) -> tuple | None:
        text, n = self.text, len(self.text)
        m = _NAME.match(text, start)
        name, at = ascii_lower(m[0]).replace("\0", "�"), m.end()
        attrs: list[tuple[str, str, str]] = []
        seen: set[str] = set()
        closing = False
        while True:
            if m := _PLAIN_ATTR.match(text, at):
                at = m.end()
                if m[1] in seen:
                    self.errors.append("duplicate attribute")
                else:
                    seen.add(m[1])
                    attrs.append((m[1], "", m[2]))
                continue
            m = _GAP.match(text, at)
            closing, at = m[0].endswith("/"), m.end()
            if at >= n:
                self.errors.append("end of file in a tag")
                self.at = n
                return None
            if text[at] == ">":
                self.at = at + 1
                break
            m = _ATTR_NAME.match(text, at)
            key, at = ascii_lower(m[0]).replace("\0", "�"), m.end()
            value, after = "", _BLANKS.match(text, at).end()
            if after < n and text[after] == "=":
                at = _BLANKS.match(text, after + 1).end()
                quote = text[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = text.find(quote, at + 1)
                    if end < 0:
                        self.errors.append("end of file in a tag")
                        self.at = n
                        return None
                    value, at = text[at + 1 : end], end + 1
                else:
                    m = _UNQUOTED.match(text, at)
                    value, at = m[0], m.end()
                    if not value:
                        self.errors.append("attribute without a value")
            if key in seen:
                self.errors.append("duplicate attribute")
            else:
                seen.add(key)
                attrs.append((key, "", decode(value, True).replace("\0", "�")))
        if kind == "end" and (attrs or closing):
            self.errors.append("end tag with attributes")
        return kind, name, attrs, closing

    def raw(self, name: str, kind: str) -> str:
        """Text up to the end tag of name, which stays to be read."""
        text, at, pattern = self.text, self.at, re.compile(rf"</{re.escape(name)}(?=[\t\n\f />])", re.I)
        if kind == "script":
            end = self._script_end(pattern)
        else:
            m = pattern.search(text, at)
            end = m.start() if m else len(text)
        self.at = end
        found = text[at:end].replace("\0", "�")
        return decode(found, errors=self.errors) if kind == "rcdata" else found

    def _script_end(self, pattern: re.Pattern) -> int:
        """A script in a comment in a script hides the inner script's end tag."""
        text, at = self.text, self.at
        step = re.compile(r"<!--|-->|<script(?=[\t\n\f />])|</script(?=[\t\n\f />])", re.I)
        escaped = double = False
        while m := step.search(text, at):
            word, at = m[0].lower(), m.end()
            if word == "<!--":
                escaped = True
                at -= 2  # the dashes may close it as well
            elif word == "-->":
                escaped = double = False
            elif word == "<script":
                double = escaped
            elif double:
                double = False
            else:
                return m.start()
        return len(text)


class _Open(list):
    """The stack of open elements, which knows where each name is open last, so that
    questions about scopes cost no walk over deeply nested elements."""

    def __init__(self, tree: Tree):
        super().__init__()
        self.tree = tree
        self.names: dict[str | None, dict[str | None, list[int]]] = {HTML: {}, MATH: {}, SVG: {}}  # by namespace
        self.lower: dict[str, list[int]] = {}
        self.html: list[int] = []
        self.special: list[int] = []
        self.walls: list[int] = []  # special ones that also end the search for an open list item
        self.held: set[int] = set()

    def _enter(self, at: int, node: int) -> None:
        ns, name = self.tree.ns[node], self.tree.name[node]
        for where, key in ((self.names.setdefault(ns, {}), name), (self.lower, ascii_lower(name or ""))):
            if (places := where.get(key)) is None:
                where[key] = [at]
            else:
                places.append(at)
        if ns == HTML:
            self.html.append(at)
        self.held.add(node)
        if is_special(ns, name):
            self.special.append(at)
            if ns != HTML or name not in ("address", "div", "p"):
                self.walls.append(at)

    def _rebuild(self) -> None:
        self.names, self.lower, self.html, self.special, self.walls, self.held = {HTML: {}, MATH: {}, SVG: {}}, {}, [], [], [], set()
        for at, node in enumerate(self):
            self._enter(at, node)

    def append(self, node: int) -> None:
        self._enter(len(self), node)
        super().append(node)

    def pop(self) -> int:
        node, at = super().pop(), len(self)
        name = self.tree.name[node]
        self.names[self.tree.ns[node]][name].pop()
        self.lower[ascii_lower(name or "")].pop()
        self.held.discard(node)
        for places in (self.html, self.special, self.walls):
            if places and places[-1] == at:
                places.pop()
        return node

    def __contains__(self, node: object) -> bool:
        return node in self.held

    def __delitem__(self, at) -> None:
        if isinstance(at, slice) and at.stop is None and at.step is None:
            while len(self) > at.start:
                self.pop()
        else:
            super().__delitem__(at)
            self._rebuild()

    def __setitem__(self, at, node) -> None:
        super().__setitem__(at, node)
        self._rebuild()

    def insert(self, at: int, node: int) -> None:
        super().insert(at, node)
        self._rebuild()

    def remove(self, node: int) -> None:
        if self and self[-1] == node:
            self.pop()
        else:
            super().remove(node)
            self._rebuild()

    def place(self, node: int) -> int:
        """Where the node is, -1 if it is not open."""
        if node not in self.held:
            return -1
        return next(at for at in reversed(self.names[self.tree.ns[node]][self.tree.name[node]]) if self[at] == node)

    def last(self, names, ns: str = HTML) -> int:
        """The highest place of an element of one of the names, -1 without one."""
        best, of = -1, self.names[ns].get
        for n in names:
            if (places := of(n)) and places[-1] > best:
                best = places[-1]
        return best

    def within(self, names, stop: frozenset, foreign: bool = True) -> bool:
        """Whether one of the names is open above all elements that bound the scope."""
        return self.above(self.last(names), stop, foreign)

    def above(self, at: int, stop: frozenset, foreign: bool = True) -> bool:
        if at < 0 or at < self.last(stop):
            return False
        return not foreign or len(self.html) == len(self) or max(self.last(MATH_SCOPE, MATH), self.last(SVG_SCOPE, SVG)) <= at


def is_special(ns: str | None, name: str | None) -> bool:
    return ns == HTML and name in SPECIAL or ns == MATH and name in MATH_SCOPE or ns == SVG and name in SVG_SCOPE


class _Builder:
    """Tree construction: the stack of open elements, the list of active formatting elements, the insertion mode."""

    def __init__(self, text: str):
        self.tree = Tree()
        self.tokens = _Tokens(text, self.tree.errors)
        self.stack = _Open(self.tree)
        self.active: list[int | None] = []  # None is a marker
        self.tags: dict[int, tuple] = {}
        self.pushed: dict[tuple, int] = {}  # how many of each have ever been active
        self.mode = self.initial
        self.original = self.mode
        self.templates: list = []
        self.head: int | None = None
        self.form: int | None = None
        self.frameset_ok, self.foster, self.skip_newline = True, False, False
        self.table_text: list[str] = []

    # Helpers

    def error(self, what: str) -> None:
        self.tree.errors.append(what)

    @property
    def current(self) -> int:
        return self.stack[-1]

    def tag(self, node: int) -> str | None:
        """The name of an HTML element."""
        return self.tree.name[node] if self.tree.ns[node] == HTML else None

    def place(self, target: int | None = None) -> tuple[int, int | None]:
        """Parent, and the child to insert before."""
        target = self.current if target is None else target
        if self.foster and self.tag(target) in TABLE_PARTS:
            table = next((k for k in range(len(self.stack) - 1, -1, -1) if self.tag(self.stack[k]) == "table"), None)
            template = next((k for k in range(len(self.stack) - 1, -1, -1) if self.tag(self.stack[k]) == "template"), None)
            if template is not None and (table is None or template > table):
                return self.tree.contents[self.stack[template]], None
            if table is None:
                return self.stack[0], None
            node = self.stack[table]
            if self.tree.parent[node] is not None:
                return self.tree.parent[node], node
            target = self.stack[table - 1]
        return self.tree.contents.get(target, target), None

    def put_text(self, data: str) -> None:
        parent, before = self.place()
        if data and self.tree.kind[parent] != "document" or parent in self.tree.contents.values():
            self.tree.append_text(parent, data, before)

    def put_comment(self, data: str, parent: int | None = None) -> None:
        where, before = self.place() if parent is None else (parent, None)
        self.tree.append(where, self.tree.new("comment", text=data), before)

    def create(self, name: str, attrs, ns: str = HTML) -> int:
        node = self.tree.new("element", name, ns, attrs)
        if ns == HTML and name == "template":
            self.tree.contents[node] = self.tree.new("document")
        return node

    def put(self, name: str, attrs=(), ns: str = HTML, push: bool = True) -> int:
        node = self.create(name, attrs, ns)
        parent, before = self.place()
        self.tree.append(parent, node, before)
        if push:
            self.stack.append(node)
        return node

    def has(self, names, stop: frozenset = SCOPE, foreign: bool = True) -> bool:
        """Whether one of names is open within a scope."""
        return self.stack.within((names,) if isinstance(names, str) else names, stop, foreign)

    def in_button(self, names) -> bool:
        return self.has(names, BUTTON_SCOPE)

    def in_table_scope(self, names) -> bool:
        return self.has(names, TABLE_SCOPE, False)

    def in_select_scope(self, name: str) -> bool:
        for node in reversed(self.stack):
            if self.tag(node) == name:
                return True
            if self.tag(node) not in ("optgroup", "option"):
                return False
        return False

    def pop_until(self, names) -> None:
        names = (names,) if isinstance(names, str) else names
        while self.stack and self.tag(self.stack.pop()) not in names:
            pass

    def implied(self, but: str = "", names: frozenset = IMPLIED) -> None:
        while self.tag(self.current) in names and self.tag(self.current) != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_button("p"):
            self.implied("p")
            if self.tag(self.current) != "p":
                self.error("open elements in a paragraph")
            self.pop_until("p")

    def clear_to(self, *names: str) -> None:
        while self.tag(self.current) not in (*names, "html", "template"):
            self.stack.pop()

    def raw_text(self, name: str, attrs) -> None:
        """An element whose text is read at once."""
        self.put(name, attrs)
        data = self.tokens.raw(name, RAW[name])
        if name == "textarea" and data.startswith("\n"):
            data = data[1:]
        if data:
            self.put_text(data)
        if self.tokens.at >= len(self.tokens.text):
            self.error("end of file in raw text")
            self.stack.pop()
            return
        self.tokens.next()
        self.stack.pop()

    def reset_mode(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            name, last = self.tag(self.stack[k]), k == 0
            if name == "select":
                self.mode = self.in_select
                for above in reversed(self.stack[:k]):
                    if self.tag(above) == "template":
                        break
                    if self.tag(above) == "table":
                        self.mode = self.in_select_in_table
                        break
                return
            if name in ("td", "th") and not last:
                self.mode = self.in_cell
            elif name == "tr":
                self.mode = self.in_row
            elif name in ("tbody", "thead", "tfoot"):
                self.mode = self.in_table_body
            elif name == "caption":
                self.mode = self.in_caption
            elif name == "colgroup":
                self.mode = self.in_column_group
            elif name == "table":
                self.mode = self.in_table
            elif name == "template":
                self.mode = self.templates[-1]
            elif name == "head" and not last:
                self.mode = self.in_head
            elif name == "body" or last and name != "html":
                self.mode = self.in_body
            elif name == "frameset":
                self.mode = self.in_frameset
            elif name == "html":
                self.mode = self.before_head if self.head is None else self.after_head
            else:
                continue
            return

    # Active formatting elements

    def push_active(self, node: int, token: tuple) -> None:
        """At most three alike since the last marker."""
        alike, key = [], (token[1], tuple(sorted(token[2])))
        self.pushed[key] = self.pushed.get(key, 0) + 1
        for k in range(len(self.active) - 1, -1, -1) if self.pushed[key] > 3 else ():
            if self.active[k] is None:
                break
            other = self.tags[self.active[k]]
            if other[1] == key[0] and tuple(sorted(other[2])) == key[1]:
                alike.append(k)
        if len(alike) >= 3:
            del self.active[alike[-1]]
        self.active.append(node)
        self.tags[node] = token

    def reconstruct(self) -> None:
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for at in range(k, len(self.active)):
            token = self.tags[self.active[at]]
            node = self.put(token[1], token[2])
            self.tags[node] = token
            self.active[at] = node

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def active_named(self, name: str) -> int | None:
        for node in reversed(self.active):
            if node is None:
                return None
            if self.tree.name[node] == name:
                return node
        return None

    def adopt(self, name: str, token: tuple) -> None:
        """The adoption agency algorithm."""
        if self.tag(self.current) == name and self.current not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            formatting = self.active_named(name)
            if formatting is None:
                self.any_other_end(name)
                return
            if formatting not in self.stack:
                self.error("misnested formatting")
                self.active.remove(formatting)
                return
            if not self.has_node(formatting):
                self.error("misnested formatting")
                return
            if formatting != self.current:
                self.error("misnested formatting")
            at = self.stack.index(formatting)
            furthest = next((n for n in self.stack[at:] if self.special(n)), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(formatting)
                return
            ancestor, bookmark = self.stack[at - 1], self.active.index(formatting)
            k, last, inner = self.stack.index(furthest), furthest, 0
            while True:
                inner += 1
                k -= 1
                node = self.stack[k]
                if node == formatting:
                    break
                if inner > 3 and node in self.active:
                    bookmark -= self.active.index(node) < bookmark
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[k]
                    continue
                own = self.tags[node]
                new = self.create(own[1], own[2])
                self.tags[new] = own
                self.active[self.active.index(node)] = new
                self.stack[k] = new
                if last == furthest:
                    bookmark = self.active.index(new) + 1
                self.tree.append(new, last)
                last = new
            parent, before = self.place(ancestor)
            self.tree.append(parent, last, before)
            own = self.tags[formatting]
            new = self.create(own[1], own[2])
            self.tags[new] = own
            for child in list(self.tree.children[furthest]):
                self.tree.append(new, child)
            self.tree.append(furthest, new)
            here = self.active.index(formatting)
            bookmark -= here < bookmark
            self.active.remove(formatting)
            self.active.insert(bookmark, new)
            self.stack.remove(formatting)
            self.stack.insert(self.stack.index(furthest) + 1, new)

    def has_node(self, node: int) -> bool:
        return self.stack.above(self.stack.place(node), SCOPE)

    def special(self, node: int) -> bool:
        return is_special(self.tree.ns[node], self.tree.name[node])

    def any_other_end(self, name: str) -> None:
        at = self.stack.last((name,))
        if at < (self.stack.special[-1] if self.stack.special else 0):
            self.error(f"unexpected end tag {name}")
            return
        self.implied(name)
        if at != len(self.stack) - 1:
            self.error(f"unexpected end tag {name}")
        del self.stack[at:]

    # The loop

    def run(self) -> Tree:
        while True:
            here = self.stack[-1] if self.stack else None
            self.tokens.cdata = here is not None and self.tree.ns[here] != HTML
            token = self.tokens.next()
            if token is None:
                if self.tokens.at < len(self.tokens.text):
                    continue
                self.process(("eof",))
                return self.tree
            if token[0] == "char":
                data = token[1]
                if self.skip_newline:
                    data = data.removeprefix("\n")
                self.skip_newline = False
                if data:
                    self.process(("char", data))
                continue
            self.skip_newline = False
            self.process(token)

    def process(self, token: tuple) -> None:
        kind = token[0]
        if self.stack and kind != "eof":
            node = self.current
            ns, name = self.tree.ns[node], self.tree.name[node]
            if ns != HTML:
                text_point = ns == MATH and name in ("mi", "mo", "mn", "ms", "mtext")
                html_point = ns == SVG and name in SVG_SCOPE or ns == MATH and name == "annotation-xml" and ascii_lower(self.tree.attr(node, "encoding") or "") in ("text/html", "application/xhtml+xml")
                ok = (
                    text_point and (kind == "char" or kind == "start" and token[1] not in ("mglyph", "malignmark"))
                    or ns == MATH and name == "annotation-xml" and kind == "start" and token[1] == "svg"
                    or html_point and kind in ("start", "char")
                )
                if not ok:
                    return self.foreign(token)
        self.mode(token)

    def spaces_first(self, token: tuple) -> tuple[str, tuple | None]:
        """Leading white space of characters, and the token with the rest."""
        if token[0] != "char":
            return "", token
        rest = token[1].lstrip(_SPACE)
        return token[1][: len(token[1]) - len(rest)], ("char", rest) if rest else None

    # Insertion modes

    def initial(self, token: tuple) -> None:
        _, token = self.spaces_first(token)
        if token is None:
            return
        if token[0] == "comment":
            return self.put_comment(token[1], 0)
        if token[0] == "doctype":
            _, name, public, system, bad = token
            low, sys_low = (public or "").lower(), (system or "").lower()
            if name != "html" or public is not None or system not in (None, "about:legacy-compat"):
                self.error("unknown doctype")
            self.tree.append(0, self.tree.new("doctype", name, ids=(public or "", system or "")))
            if bad or name != "html" or low.startswith(QUIRKY) or low in ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html") or sys_low == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or (system is None and low.startswith(("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//"))):
                self.tree.quirks = "quirks"
            elif low.startswith(("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//", "-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")):
                self.tree.quirks = "limited-quirks"
            self.mode = self.before_html
            return
        self.error("missing doctype")
        self.tree.quirks = "quirks"
        self.mode = self.before_html
        self.mode(token)

    def before_html(self, token: tuple) -> None:
        _, token = self.spaces_first(token)
        if token is None:
            return
        if token[0] == "comment":
            return self.put_comment(token[1], 0)
        if token[0] == "doctype" or token[0] == "end" and token[1] not in ("head", "body", "html", "br"):
            return self.error(f"unexpected {token[0]}")
        node = self.create("html", token[2] if token[:2] == ("start", "html") else ())
        self.tree.append(0, node)
        self.stack.append(node)
        self.mode = self.before_head
        if token[:2] != ("start", "html"):
            self.mode(token)

    def before_head(self, token: tuple) -> None:
        _, token = self.spaces_first(token)
        if token is None:
            return
        if token[0] == "comment":
            return self.put_comment(token[1])
        if token[:2] == ("start", "html"):
            return self.in_body(token)
        if token[0] == "doctype" or token[0] == "end" and token[1] not in ("head", "body", "html", "br"):
            return self.error(f"unexpected {token[0]}")
        self.head = self.put("head", token[2] if token[:2] == ("start", "head") else ())
        self.mode = self.in_head
        if token[:2] != ("start", "head"):
            self.mode(token)

    def in_head(self, token: tuple) -> None:
        spaces, token = self.spaces_first(token)
        self.put_text(spaces)
        if token is None:
            return
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "comment":
            return self.put_comment(name)
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start":
            if name == "html":
                return self.in_body(token)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.put(name, token[2], push=False)
                return
            if name in ("title", "noframes", "style", "script", "noscript"):
                return self.raw_text(name, token[2])
            if name == "template":
                self.put(name, token[2])
                self.active.append(None)
                self.frameset_ok = False
                self.mode = self.in_template
                self.templates.append(self.in_template)
                return
            if name == "head":
                return self.error("unexpected head")
        if kind == "end":
            if name == "head":
                self.stack.pop()
                self.mode = self.after_head
                return
            if name == "template":
                return self.end_template()
            if name not in ("body", "html", "br"):
                return self.error(f"unexpected end tag {name}")
        self.stack.pop()
        self.mode = self.after_head
        self.mode(token)

    def end_template(self) -> None:
        if self.stack.last(("template",)) < 0:
            return self.error("unexpected end tag template")
        self.implied(names=IMPLIED_ALL)
        if self.tag(self.current) != "template":
            self.error("open elements in a template")
        self.pop_until("template")
        self.clear_active()
        self.templates.pop()
        self.reset_mode()

    def after_head(self, token: tuple) -> None:
        spaces, token = self.spaces_first(token)
        self.put_text(spaces)
        if token is None:
            return
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "comment":
            return self.put_comment(name)
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start":
            if name == "html":
                return self.in_body(token)
            if name == "body":
                self.put(name, token[2])
                self.frameset_ok = False
                self.mode = self.in_body
                return
            if name == "frameset":
                self.put(name, token[2])
                self.mode = self.in_frameset
                return
            if name in HEAD_TAGS:
                self.error(f"{name} after the head")
                self.stack.append(self.head)
                self.in_head(token)
                if self.head in self.stack:
                    self.stack.remove(self.head)
                return
            if name == "head":
                return self.error("unexpected head")
        if kind == "end" and name == "template":
            return self.end_template()
        if kind == "end" and name not in ("body", "html", "br"):
            return self.error(f"unexpected end tag {name}")
        self.put("body")
        self.mode = self.in_body
        self.mode(token)

    def in_body(self, token: tuple) -> None:
        kind = token[0]
        if kind == "char":
            data = token[1]
            if "\0" in data:
                self.error("unexpected null character")
                data = data.replace("\0", "")
            if data:
                self.reconstruct()
                self.put_text(data)
                if data.strip(_SPACE):
                    self.frameset_ok = False
        elif kind == "comment":
            self.put_comment(token[1])
        elif kind == "doctype":
            self.error("unexpected doctype")
        elif kind == "start":
            self.body_start(token, token[1], token[2])
        elif kind == "end":
            self.body_end(token, token[1])
        elif self.templates:
            self.in_template(token)

    def body_start(self, token: tuple, name: str, attrs: list) -> None:
        if name == "html":
            self.error("unexpected html")
            if self.stack.last(("template",)) < 0:
                self.add_attrs(self.stack[0], attrs)
        elif name in HEAD_TAGS:
            self.in_head(token)
        elif name == "body":
            self.error("unexpected body")
            if len(self.stack) > 1 and self.tag(self.stack[1]) == "body" and self.stack.last(("template",)) < 0:
                self.frameset_ok = False
                self.add_attrs(self.stack[1], attrs)
        elif name == "frameset":
            self.error("unexpected frameset")
            if len(self.stack) > 1 and self.tag(self.stack[1]) == "body" and self.frameset_ok:
                self.tree.detach(self.stack[1])
                del self.stack[1:]
                self.put(name, attrs)
                self.mode = self.in_frameset
        elif name in BLOCKS:
            self.close_p()
            self.put(name, attrs)
        elif name in HEADINGS:
            self.close_p()
            if self.tag(self.current) in HEADINGS:
                self.error("heading in a heading")
                self.stack.pop()
            self.put(name, attrs)
        elif name in ("pre", "listing"):
            self.close_p()
            self.put(name, attrs)
            self.skip_newline, self.frameset_ok = True, False
        elif name == "form":
            in_template = self.stack.last(("template",)) >= 0
            if self.form is not None and not in_template:
                return self.error("form in a form")
            self.close_p()
            node = self.put(name, attrs)
            if not in_template:
                self.form = node
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            same = ("li",) if name == "li" else ("dd", "dt")
            at = self.stack.last(same)
            if at >= 0 and at == self.stack.walls[-1]:
                own = self.tag(self.stack[at])
                self.implied(own)
                self.pop_until(own)
            self.close_p()
            self.put(name, attrs)
        elif name == "plaintext":
            self.close_p()
            self.put(name, attrs)
            rest = self.tokens.text[self.tokens.at :].replace("\0", "�")
            self.tokens.at = len(self.tokens.text)
            self.put_text(rest)
        elif name == "button":
            if self.has("button"):
                self.error("button in a button")
                self.implied()
                self.pop_until("button")
            self.reconstruct()
            self.put(name, attrs)
            self.frameset_ok = False
        elif name == "a":
            if (old := self.active_named("a")) is not None:
                self.error("link in a link")
                self.adopt("a", token)
                if old in self.active:
                    self.active.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
            self.reconstruct()
            self.push_active(self.put(name, attrs), token)
        elif name in FORMATTING:
            self.reconstruct()
            if name == "nobr" and self.has("nobr"):
                self.error("nobr in a nobr")
                self.adopt("nobr", token)
                self.reconstruct()
            self.push_active(self.put(name, attrs), token)
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.put(name, attrs)
            self.active.append(None)
            self.frameset_ok = False
        elif name == "table":
            if self.tree.quirks != "quirks":
                self.close_p()
            self.put(name, attrs)
            self.frameset_ok = False
            self.mode = self.in_table
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "image", "input"):
            self.reconstruct()
            self.put("img" if name == "image" else name, attrs, push=False)
            if name != "input" or ascii_lower(dict((n, v) for n, _, v in attrs).get("type", "")) != "hidden":
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.put(name, attrs, push=False)
        elif name == "hr":
            self.close_p()
            self.put(name, attrs, push=False)
            self.frameset_ok = False
        elif name == "textarea":
            self.frameset_ok = False
            self.raw_text(name, attrs)
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.frameset_ok = False
            self.raw_text(name, attrs)
        elif name in ("iframe", "noembed", "noscript"):
            self.frameset_ok = self.frameset_ok and name != "iframe"
            self.raw_text(name, attrs)
        elif name == "select":
            self.reconstruct()
            self.put(name, attrs)
            self.frameset_ok = False
            inside = self.mode in (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell)
            self.mode = self.in_select_in_table if inside else self.in_select
        elif name in ("optgroup", "option"):
            if self.tag(self.current) == "option":
                self.stack.pop()
            self.reconstruct()
            self.put(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.implied("rtc" if name in ("rp", "rt") else "")
            self.put(name, attrs)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.put_foreign(token, MATH if name == "math" else SVG)
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.error(f"unexpected {name}")
        else:
            self.reconstruct()
            self.put(name, attrs)

    def add_attrs(self, node: int, attrs: list) -> None:
        have = {n for n, _, _ in self.tree.attrs[node]}
        self.tree.attrs[node] += [a for a in attrs if a[0] not in have]

    def body_end(self, token: tuple, name: str) -> None:
        if name == "template":
            self.end_template()
        elif name in ("body", "html"):
            if not self.has("body"):
                return self.error(f"unexpected end tag {name}")
            self.mode = self.after_body
            if name == "html":
                self.mode(token)
        elif name in CLOSED_BLOCKS:
            if not self.has(name):
                return self.error(f"unexpected end tag {name}")
            self.implied()
            if self.tag(self.current) != name:
                self.error(f"open elements in {name}")
            self.pop_until(name)
        elif name == "form":
            if self.stack.last(("template",)) >= 0:
                if self.has("form"):
                    self.implied()
                    self.pop_until("form")
                return
            node, self.form = self.form, None
            if node is None or not self.has_node(node):
                return self.error("unexpected end tag form")
            self.implied()
            if self.current != node:
                self.error("open elements in form")
            self.stack.remove(node)
        elif name == "p":
            if not self.in_button("p"):
                self.error("unexpected end tag p")
                self.put("p")
            self.close_p()
        elif name == "li":
            if not self.has("li", SCOPE | {"ol", "ul"}):
                return self.error("unexpected end tag li")
            self.implied("li")
            self.pop_until("li")
        elif name in ("dd", "dt"):
            if not self.has(name):
                return self.error(f"unexpected end tag {name}")
            self.implied(name)
            self.pop_until(name)
        elif name in HEADINGS:
            if not self.has(tuple(HEADINGS)):
                return self.error(f"unexpected end tag {name}")
            self.implied()
            if self.tag(self.current) != name:
                self.error(f"open elements in {name}")
            self.pop_until(tuple(HEADINGS))
        elif name in FORMATTING:
            self.adopt(name, token)
        elif name in ("applet", "marquee", "object"):
            if not self.has(name):
                return self.error(f"unexpected end tag {name}")
            self.implied()
            self.pop_until(name)
            self.clear_active()
        elif name == "br":
            self.error("unexpected end tag br")
            self.reconstruct()
            self.put("br", push=False)
            self.frameset_ok = False
        else:
            self.any_other_end(name)

    # Tables

    def in_table(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "char" and self.tag(self.current) in TABLE_PARTS | {"template"}:
            data = name.replace("\0", "")
            if data.strip(_SPACE):
                self.error("text in a table")
                self.fostered(("char", data))
            else:
                self.put_text(data)
            return
        if kind == "comment":
            return self.put_comment(name)
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start":
            attrs = token[2]
            if name in ("caption", "colgroup", "col", "tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to("table")
                if name == "caption":
                    self.active.append(None)
                    self.put(name, attrs)
                    self.mode = self.in_caption
                elif name in ("colgroup", "col"):
                    self.put("colgroup", attrs if name == "colgroup" else ())
                    self.mode = self.in_column_group
                    if name == "col":
                        self.mode(token)
                else:
                    own = name in ("tbody", "tfoot", "thead")
                    self.put(name if own else "tbody", attrs if own else ())
                    self.mode = self.in_table_body
                    if not own:
                        self.mode(token)
                return
            if name == "table":
                self.error("table in a table")
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset_mode()
                    self.process(token)
                return
            if name in ("style", "script", "template"):
                return self.in_head(token)
            if name == "input" and ascii_lower(dict((n, v) for n, _, v in attrs).get("type", "")) == "hidden":
                self.error("input in a table")
                self.put(name, attrs, push=False)
                return
            if name == "form":
                self.error("form in a table")
                if self.form is None and self.stack.last(("template",)) < 0:
                    self.form = self.put(name, attrs)
                    self.stack.pop()
                return
        if kind == "end":
            if name == "table":
                if not self.in_table_scope("table"):
                    return self.error("unexpected end tag table")
                self.pop_until("table")
                return self.reset_mode()
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return self.error(f"unexpected end tag {name}")
            if name == "template":
                return self.end_template()
        if kind == "eof":
            return self.in_body(token)
        self.error("misplaced content in a table")
        self.fostered(token)

    def fostered(self, token: tuple) -> None:
        self.foster = True
        self.in_body(token)
        self.foster = False

    def in_caption(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        opens = kind == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if opens or kind == "end" and name in ("caption", "table"):
            if not self.in_table_scope("caption"):
                return self.error("unexpected tag in a caption")
            self.implied()
            self.pop_until("caption")
            self.clear_active()
            self.mode = self.in_table
            if name != "caption" or opens:
                self.process(token)
            return
        if kind == "end" and name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return self.error(f"unexpected end tag {name}")
        self.in_body(token)

    def in_column_group(self, token: tuple) -> None:
        spaces, token = self.spaces_first(token)
        self.put_text(spaces)
        if token is None:
            return
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "comment":
            return self.put_comment(name)
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start" and name == "html":
            return self.in_body(token)
        if kind == "start" and name == "col":
            self.put(name, token[2], push=False)
            return
        if kind in ("start", "end") and name == "template":
            return self.in_head(token)
        if kind == "end" and name == "col":
            return self.error("unexpected end tag col")
        if kind == "eof":
            return self.in_body(token)
        if self.tag(self.current) != "colgroup":
            return self.error("misplaced content in a column group")
        self.stack.pop()
        self.mode = self.in_table
        if (kind, name) != ("end", "colgroup"):
            self.process(token)

    def in_table_body(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "start" and name in ("tr", "th", "td"):
            self.clear_to("tbody", "tfoot", "thead")
            self.put("tr", token[2] if name == "tr" else ())
            self.mode = self.in_row
            if name != "tr":
                self.mode(token)
            return
        if kind == "end" and name in ("tbody", "tfoot", "thead"):
            if not self.in_table_scope(name):
                return self.error(f"unexpected end tag {name}")
            self.clear_to("tbody", "tfoot", "thead")
            self.stack.pop()
            self.mode = self.in_table
            return
        if kind == "start" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead") or (kind, name) == ("end", "table"):
            if not self.in_table_scope(("tbody", "thead", "tfoot")):
                return self.error(f"unexpected {name}")
            self.clear_to("tbody", "tfoot", "thead")
            self.stack.pop()
            self.mode = self.in_table
            return self.process(token)
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return self.error(f"unexpected end tag {name}")
        self.in_table(token)

    def in_row(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "start" and name in ("th", "td"):
            self.clear_to("tr")
            self.put(name, token[2])
            self.mode = self.in_cell
            self.active.append(None)
            return
        ends = (kind, name) in (("end", "tr"), ("end", "table")) or kind == "end" and name in ("tbody", "tfoot", "thead")
        if ends or kind == "start" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if not self.in_table_scope("tr") or kind == "end" and name not in ("tr", "table") and not self.in_table_scope(name):
                return self.error(f"unexpected {name}")
            self.clear_to("tr")
            self.stack.pop()
            self.mode = self.in_table_body
            if (kind, name) != ("end", "tr"):
                self.process(token)
            return
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return self.error(f"unexpected end tag {name}")
        self.in_table(token)

    def close_cell(self) -> None:
        self.implied()
        if self.tag(self.current) not in ("td", "th"):
            self.error("open elements in a cell")
        self.pop_until(("td", "th"))
        self.clear_active()
        self.mode = self.in_row

    def in_cell(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "end" and name in ("td", "th"):
            if not self.in_table_scope(name):
                return self.error(f"unexpected end tag {name}")
            self.implied()
            if self.tag(self.current) != name:
                self.error("open elements in a cell")
            self.pop_until(name)
            self.clear_active()
            self.mode = self.in_row
            return
        if kind == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if not self.in_table_scope(("td", "th")):
                return self.error(f"unexpected {name}")
            self.close_cell()
            return self.process(token)
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return self.error(f"unexpected end tag {name}")
        if kind == "end" and name in TABLE_PARTS:
            if not self.in_table_scope(name):
                return self.error(f"unexpected end tag {name}")
            self.close_cell()
            return self.process(token)
        self.in_body(token)

    # Select, template, frames

    def in_select(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "char":
            return self.put_text(name.replace("\0", ""))
        if kind == "comment":
            return self.put_comment(name)
        if kind == "start":
            if name == "html":
                return self.in_body(token)
            if name in ("option", "optgroup", "hr"):
                if self.tag(self.current) == "option":
                    self.stack.pop()
                if name != "option" and self.tag(self.current) == "optgroup":
                    self.stack.pop()
                self.put(name, token[2], push=name != "hr")
                return
            if name in ("select", "input", "keygen", "textarea"):
                self.error(f"{name} in a select")
                if self.in_select_scope("select"):
                    self.pop_until("select")
                    self.reset_mode()
                    if name != "select":
                        self.process(token)
                return
            if name in ("script", "template"):
                return self.in_head(token)
        if kind == "end":
            if name == "optgroup":
                if self.tag(self.current) == "option" and len(self.stack) > 1 and self.tag(self.stack[-2]) == "optgroup":
                    self.stack.pop()
                if self.tag(self.current) == "optgroup":
                    self.stack.pop()
                return
            if name == "option" and self.tag(self.current) == "option":
                self.stack.pop()
                return
            if name == "select" and self.in_select_scope("select"):
                self.pop_until("select")
                return self.reset_mode()
            if name == "template":
                return self.end_template()
        if kind == "eof":
            return self.in_body(token)
        self.error("misplaced content in a select")

    def in_select_in_table(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind in ("start", "end") and name in TABLE_PARTS | {"caption", "td", "th"}:
            self.error(f"unexpected {name}")
            if kind == "start" or self.in_table_scope(name):
                self.pop_until("select")
                self.reset_mode()
                self.process(token)
            return
        self.in_select(token)

    def in_template(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind in ("char", "comment", "doctype"):
            return self.in_body(token)
        if kind == "start" and name in HEAD_TAGS or (kind, name) == ("end", "template"):
            return self.in_head(token)
        if kind == "start":
            table = {"caption": self.in_table, "colgroup": self.in_table, "tbody": self.in_table, "tfoot": self.in_table, "thead": self.in_table, "col": self.in_column_group, "tr": self.in_table_body, "td": self.in_row, "th": self.in_row}
            self.templates[-1] = self.mode = table.get(name, self.in_body)
            return self.mode(token)
        if kind == "end":
            return self.error(f"unexpected end tag {name}")
        if self.stack.last(("template",)) >= 0:
            self.error("template without an end")
            self.pop_until("template")
            self.clear_active()
            self.templates.pop()
            self.reset_mode()
            self.process(token)

    def after_body(self, token: tuple) -> None:
        spaces, token = self.spaces_first(token)
        if spaces:
            self.in_body(("char", spaces))
        if token is None:
            return
        if token[0] == "comment":
            return self.put_comment(token[1], self.stack[0])
        if token[0] == "doctype":
            return self.error("unexpected doctype")
        if token[:2] == ("start", "html"):
            return self.in_body(token)
        if token[:2] == ("end", "html"):
            self.mode = self.after_after_body
            return
        if token[0] != "eof":
            self.error("content after the body")
            self.mode = self.in_body
            self.process(token)

    def after_after_body(self, token: tuple) -> None:
        spaces, token = self.spaces_first(token)
        if spaces:
            self.in_body(("char", spaces))
        if token is None:
            return
        if token[0] == "comment":
            return self.put_comment(token[1], 0)
        if token[0] == "doctype" or token[:2] == ("start", "html"):
            return self.in_body(token)
        if token[0] != "eof":
            self.error("content after the document")
            self.mode = self.in_body
            self.process(token)

    def in_frameset(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "char":
            self.put_text("".join(c for c in name if c in _SPACE))
        elif kind == "comment":
            self.put_comment(name)
        elif kind == "start" and name in ("html", "noframes"):
            (self.in_body if name == "html" else self.in_head)(token)
        elif kind == "start" and name == "frameset":
            self.put(name, token[2])
        elif kind == "start" and name == "frame":
            self.put(name, token[2], push=False)
        elif (kind, name) == ("end", "frameset") and len(self.stack) > 1:
            self.stack.pop()
            if self.tag(self.current) != "frameset":
                self.mode = self.after_frameset
        elif kind != "eof":
            self.error("misplaced content in a frameset")

    def after_frameset(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "char":
            self.put_text("".join(c for c in name if c in _SPACE))
        elif kind == "comment":
            self.put_comment(name)
        elif kind == "start" and name in ("html", "noframes"):
            (self.in_body if name == "html" else self.in_head)(token)
        elif kind not in ("eof", "end"):
            self.error("misplaced content after a frameset")

    # Foreign content

    def put_foreign(self, token: tuple, ns: str) -> None:
        _, name, attrs, closing = token
        if ns == SVG:
            name = SVG_NAMES.get(name, name)
        fixed = []
        for n, _, v in attrs:
            prefix, colon, local = n.partition(":")
            if ns == SVG:
                n = SVG_ATTRS.get(n, n)
            elif n == "definitionurl":
                n = "definitionURL"
            fixed.append((local, prefix, v) if colon and prefix in ("xlink", "xml", "xmlns") else (n, "", v))
        self.put(name, fixed, ns, push=not closing)

    def foreign(self, token: tuple) -> None:
        kind = token[0]
        if kind == "char":
            if "\0" in token[1]:
                self.error("unexpected null character")
            self.put_text(token[1].replace("\0", "�"))
            if token[1].strip(_SPACE):
                self.frameset_ok = False
        elif kind == "comment":
            self.put_comment(token[1])
        elif kind == "doctype":
            self.error("unexpected doctype")
        elif kind == "start":
            if token[1] in BREAKOUT or token[1] == "font" and any(n in ("color", "face", "size") for n, _, _ in token[2]):
                self.error(f"{token[1]} in foreign content")
                while self.tree.ns[self.current] != HTML and not (self.tree.ns[self.current] == MATH and self.tree.name[self.current] in MATH_SCOPE - {"annotation-xml"}) and not (self.tree.ns[self.current] == SVG and self.tree.name[self.current] in SVG_SCOPE):
                    self.stack.pop()
                return self.process(token)
            self.put_foreign(token, self.tree.ns[self.current])
        elif kind == "end":
            if token[1] in ("br", "p"):
                self.error(f"{token[1]} in foreign content")
                while self.tree.ns[self.current] != HTML:
                    self.stack.pop()
                return self.process(token)
            places = self.stack.lower.get(token[1])
            if places and places[-1] > self.stack.html[-1]:
                del self.stack[places[-1] :]
            else:
                return self.mode(token)


def parse(html: str | bytes) -> Tree:
    """The tree of a document; what is wrong with it is in tree.errors. Bytes are read as UTF-8."""
    text = html.decode("utf-8", "replace") if isinstance(html, bytes) else html
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    builder = _Builder(text)
    if "\0" in text:
        builder.error("unexpected null character")
    return builder.run()


def parse_checked(html: str | bytes) -> Tree:
    """The tree; raises if anything is wrong with the document."""
    tree = parse(html)
    if tree.errors:
        raise HtmlParseError(tree.errors)
    return tree


def parse_with_errors(html: str | bytes) -> tuple[Tree, list[str]]:
    tree = parse(html)
    return tree, tree.errors
