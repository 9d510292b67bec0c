"""Character references."""

from __future__ import annotations

import re
from html.entities import html5

_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z][A-Za-z0-9]*;?))")
_LONGEST = max(map(len, html5))


def _number(code: int) -> str:
    if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "�"
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return chr(code)


def decode(text: str, in_attribute: bool = False, errors: list[str] | None = None) -> str:
    """The text with references replaced. In attributes an old name without a semicolon
    stays if = or a letter or digit follows."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            if errors is not None and not m[0].endswith(";"):
                errors.append("character reference without a semicolon")
            digits = (m[1] or m[2]).lstrip("0") or "0"
            return _number(int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000)
        name = m[3]
        for n in range(min(len(name), _LONGEST), 0, -1):
            if (found := html5.get(name[:n])) is not None:
                after = name[n : n + 1] or text[m.end() : m.end() + 1]
                if in_attribute and name[n - 1] != ";" and (after == "=" or after.isascii() and after.isalnum()):
                    return m[0]
                if errors is not None and name[n - 1] != ";":
                    errors.append("character reference without a semicolon")
                return found + name[n:]
        return m[0]

    return _REFERENCE.sub(one, text)
