"""The node arena that a parse fills."""

from __future__ import annotations

HTML, SVG, MATH = "html", "svg", "math"


class Tree:
    """Nodes by id, in the order of their creation; node 0 is the document.

    kind is document, doctype, text, comment, element or processing_instruction.
    Contents of templates hang off documents of their own and are no one's children.
    """

    def __init__(self):
        self.kind: list[str] = []
        self.parent: list[int | None] = []
        self.children: list[list[int]] = []
        self.name: list[str | None] = []
        self.ns: list[str | None] = []
        self.attrs: list[list[tuple[str, str, str]]] = []  # name, namespace, value
        self.text: list[str | None] = []
        self.ids: list[tuple[str, str] | None] = []  # public and system ids of doctypes
        self.contents: dict[int, int] = {}
        self.quirks = "no-quirks"
        self.errors: list[str] = []
        self.new("document")

    def new(self, kind: str, name: str | None = None, ns: str | None = None, attrs=(), text: str | None = None, ids=None) -> int:
        self.kind.append(kind)
        self.parent.append(None)
        self.children.append([])
        self.name.append(name)
        self.ns.append(ns)
        self.attrs.append(list(attrs))
        self.text.append(text)
        self.ids.append(ids)
        return len(self.kind) - 1

    def detach(self, node: int) -> None:
        if (p := self.parent[node]) is not None:
            self.children[p].remove(node)
            self.parent[node] = None

    def append(self, parent: int, node: int, before: int | None = None) -> None:
        self.detach(node)
        own = self.children[parent]
        own.insert(len(own) if before is None else own.index(before), node)
        self.parent[node] = parent

    def append_text(self, parent: int, data: str, before: int | None = None) -> None:
        """Adds text, to the text node just before the place if there is one."""
        own = self.children[parent]
        at = len(own) if before is None else own.index(before)
        if at and self.kind[own[at - 1]] == "text":
            self.text[own[at - 1]] += data
        else:
            self.append(parent, self.new("text", text=data), before)

    # Reading

    def walk(self, node: int, with_self: bool = True):
        """Ids of the subtree in document order."""
        children = self.children
        stack = [node] if with_self else children[node][::-1]
        while stack:
            n = stack.pop()
            yield n
            if own := children[n]:
                stack += own[::-1]

    def root_element(self) -> int | None:
        return next((c for c in self.children[0] if self.kind[c] == "element"), None)

    def text_content(self, node: int) -> str:
        return "".join(self.text[n] for n in self.walk(node) if self.kind[n] == "text")

    def attr(self, node: int, name: str) -> str | None:
        name = ascii_lower(name)
        return next((v for n, _, v in self.attrs[node] if n == name), None)

    def siblings(self, node: int) -> list[int]:
        return self.children[self.parent[node]] if self.parent[node] is not None else [node]

    def by_id(self, value: str) -> int | None:
        """The first created element of a non-empty id."""
        return next((n for n in range(len(self.kind)) if value and self.attr(n, "id") == value), None) if value else None

    def by_tag(self, name: str) -> list[int]:
        name = ascii_lower(name)
        return [n for n in range(len(self.kind)) if self.kind[n] == "element" and self.name[n] == name]

    def by_class(self, name: str) -> list[int] | None:
        """Elements in creation order, once for each mention of the class; None if there is none."""
        found = [n for n in range(len(self.kind)) for c in tokens(self.attr(n, "class") or "") if c == name]
        return found or None


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def tokens(text: str) -> list[str]:
    """What ASCII white space separates."""
    return [t for t in text.replace("\t", " ").replace("\n", " ").replace("\f", " ").replace("\r", " ").split(" ") if t]
