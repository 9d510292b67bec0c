"""Markup of nodes."""

from __future__ import annotations

from .tree import Tree

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _text(data: str) -> str:
    return data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _value(data: str) -> str:
    return data.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _open(tree: Tree, node: int) -> str:
    kind = tree.kind[node]
    if kind == "element":
        return f"<{tree.name[node]}{''.join(f' {n}="{_value(v)}"' for n, _, v in tree.attrs[node])}>"
    if kind == "text":
        return _text(tree.text[node])
    if kind == "comment":
        return f"<!--{tree.text[node]}-->"
    if kind == "doctype":
        public, system = tree.ids[node]
        ids = f' PUBLIC "{public}"' + f' "{system}"' * bool(system) if public else f' SYSTEM "{system}"' if system else ""
        return f"<!DOCTYPE {tree.name[node]}{ids}>"
    if kind == "processing_instruction":
        return f"<?{tree.name[node]}{' ' * bool(tree.text[node])}{tree.text[node]}>"
    return ""


def outer_html(tree: Tree, node: int) -> str:
    """The node and all below it; text is escaped everywhere, also in scripts and styles."""
    out, stack = [], [(node, False)]
    while stack:
        n, done = stack.pop()
        if done:
            out.append(f"</{tree.name[n]}>")
            continue
        out.append(_open(tree, n))
        if tree.kind[n] == "element" and tree.name[n] not in VOID:
            stack.append((n, True))
        if tree.kind[n] != "element" or tree.name[n] not in VOID:
            stack += [(c, False) for c in reversed(tree.children[n])]
    return "".join(out)


def inner_html(tree: Tree, node: int) -> str:
    return "".join(outer_html(tree, c) for c in tree.children[node])
