"""HTML to plain text, and character references."""

from __future__ import annotations

import re

from .unicode import WS, WS_CHARS

#: Names that break a line.
BLOCK_TAGS = frozenset(
    "address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

#: Named character references, case-sensitive.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": "\xa0",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "laquo": "«",
    "raquo": "»",
    "deg": "°",
    "plusmn": "±",
    "times": "×",
    "divide": "÷",
    "euro": "€",
    "pound": "£",
    "cent": "¢",
    "sect": "§",
    "para": "¶",
    "middot": "·",
    "bull": "•",
    "AMP": "&",
    "LT": "<",
    "GT": ">",
    "QUOT": '"',
    "COPY": "©",
    "REG": "®",
}

_REFERENCE = re.compile(r"&(?:#(?:([xX])([0-9A-Fa-f]*)|([0-9]*));?|([A-Za-z0-9]{1,12})(;?))")


def _reference(m: re.Match) -> str:
    x, hexadecimal, decimal, name, semicolon = m.groups()
    if name is not None:
        return ENTITIES.get(name, m[0]) if semicolon else m[0]
    digits = hexadecimal if x else decimal
    if not digits:
        return "&#" + ("x" if x else "") + (";" if m[0].endswith(";") else "")
    digits = digits.lstrip("0")
    value = int(digits or "0", 16 if x else 10) if len(digits) <= 8 else 0x110000
    return "\ufffd" if value > 0x10FFFF or 0xD800 <= value < 0xE000 else chr(value)


def decode_entities(text: str) -> str:
    return _REFERENCE.sub(_reference, text) if "&" in text else text


_NAME = re.compile(r"[A-Za-z0-9:_-]*")
_SPACE = re.compile(f"[{WS}]*")
# A tag's rest: quoted parts may hold ``>``; an open quote runs to the end of the text.
_REST = re.compile(r"""(?:[^"'>]+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+""")
_TOKEN = re.compile(r"[<&\n]")
_WHOLE_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^"'>]+|"[^"]*"|'[^']*')*+)>""")
#: How far back, in bytes, newlines are counted.
LOOKBACK = 64
EDGES = "\n \t\r"


class _Lines:
    """Output that never gets more than two newlines in a row from markup or text."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def newline(self) -> None:
        """One more newline, unless two stand within the white space at the end (as far as one looks back)."""
        seen = count = 0
        for part in reversed(self.parts):
            near = part[seen - LOOKBACK :]
            kept = near.rstrip(" \t\n")
            count += near.count("\n", len(kept))
            seen += len(near) - len(kept)
            if kept or count > 1 or seen >= LOOKBACK:
                break
        if count < 2:
            self.parts.append("\n")


def _after(text: str, what: str, at: int) -> int:
    found = text.find(what, at)
    return len(text) if found < 0 else found + len(what)


def _raw_end(text: str, at: int, name: str) -> int:
    """After the end tag of a raw-text element."""
    while (lt := text.find("<", at)) >= 0:
        at = lt + 1
        if text.startswith("/", at):
            m = _NAME.match(text, at + 1)
            at = m.end()
            if m[0].lower() == name:
                return _after(text, ">", at)
    return len(text)


def strip_html(text: str) -> str:
    """Text without tags, comments, scripts and styles; block tags become newlines, references characters."""
    out, at, n = _Lines(), 0, len(text)
    add, search, whole = out.parts.append, _TOKEN.search, _WHOLE_TAG.match
    while at < n:
        m = search(text, at)
        if m is None:
            add(text[at:])
            break
        start = m.start()
        if start > at:
            add(text[at:start])
        at = start
        mark = text[at]
        if mark == "\n":
            out.newline()
            at += 1
            continue
        if mark == "&":
            r = _REFERENCE.match(text, at)
            add(_reference(r) if r else "&")
            at = r.end() if r else at + 1
            continue
        tag = whole(text, at)
        follow = text[at + 1 : at + 2]
        if tag is not None:
            name, at = tag[2].lower(), tag.end()
            if name in BLOCK_TAGS:
                out.newline()
            elif name in ("script", "style") and not tag[1] and not tag[3].rstrip(WS_CHARS).endswith("/"):
                at = _raw_end(text, at, name)
        elif follow == "!":
            at = _after(text, "-->", at + 2) if text.startswith("<!--", at) else _after(text, ">", at + 1)
        elif follow == "?":
            at = _after(text, ">", at + 1)
        elif follow == "/":
            name = _NAME.match(text, _SPACE.match(text, at + 2).end())
            at = min(n, _REST.match(text, name.end()).end() + 1)
            if name[0].lower() in BLOCK_TAGS:
                out.newline()
        elif follow.isascii() and follow.isalpha():
            # The tag never ends: neither does what it hides.
            if _NAME.match(text, at + 1)[0].lower() in BLOCK_TAGS:
                out.newline()
            at = n
        else:
            add("<")
            at += 1
    return "".join(out.parts).strip(EDGES)
