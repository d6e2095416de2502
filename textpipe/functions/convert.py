"""HTML to Markdown."""

from __future__ import annotations

import re

from .html import decode_entities
from .unicode import WS, WS_CHARS

#: Elements set off by blank lines.
PARAGRAPHS = frozenset("address article aside div figcaption figure footer form header main nav p section summary".split())
MAX_INDENT = 4
_NAME = re.compile(r"[A-Za-z0-9:_-]*")
_ASCII_SPACE = re.compile(r"[ \t\n\x0c\r]*")
_REST = re.compile(r"""(?:[^"'>]+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+""")
_WHOLE_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^"'>]+|"[^"]*"|'[^']*')*+)>""")
_ESCAPED = re.compile(r"([\\*_\[\]`|<>])")
_PIECE = re.compile(f"[{WS}]+|[^{WS}]+")
_ATTRIBUTE = re.compile(r"""([A-Za-z0-9:_-]+)[ \t\n\x0c\r]*(?:=[ \t\n\x0c\r]*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\x0c\r/]*))?""")
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")


def attribute(attrs: str, wanted: str) -> str | None:
    """The decoded, trimmed value of the first attribute of that name that has one."""
    for m in _ATTRIBUTE.finditer(attrs):
        if m[2] is not None and m[1].lower() == wanted:
            value = m[2]
            if value[:1] in ("'", '"'):
                value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            return decode_entities(value).strip(WS_CHARS)
    return None


def destination(href: str) -> str | None:
    """A link's target in angle brackets, if its scheme is harmless."""
    href = href.strip(WS_CHARS)
    scheme, colon, _ = href.partition(":")
    if not href or _CONTROL.search(href) or colon and scheme.lower() not in ("http", "https", "mailto"):
        return None
    return "<" + re.sub(r"([>\\])", r"\\\1", href) + ">"


class _Tag:
    def __init__(self, end: int, name: str = "", closing: bool = False, attrs: str = "", alone: bool = False):
        self.end, self.name, self.closing, self.attrs, self.alone = end, name.lower(), closing, attrs, alone


def _tag(text: str, at: int) -> _Tag | None:
    """What stands at a ``<``: a tag, something to drop (no name), or nothing."""
    n = len(text)
    whole = _WHOLE_TAG.match(text, at)
    if whole is not None:
        return _Tag(whole.end(), whole[2], bool(whole[1]), whole[3], whole[3].rstrip(WS_CHARS).endswith("/"))
    if text.startswith("<!--", at):
        found = text.find("-->", at + 4)
        return _Tag(n if found < 0 else found + 3)
    follow = text[at + 1 : at + 2]
    if follow in ("!", "?") and follow:
        found = text.find(">", at + 2)
        return _Tag(n if found < 0 else found + 1)
    closing = follow == "/"
    if not closing and not (follow.isascii() and follow.isalpha()):
        return None
    name = _NAME.match(text, _ASCII_SPACE.match(text, at + 2).end() if closing else at + 1)
    if not name[0]:
        return None
    rest = _REST.match(text, name.end())
    closed = rest.end() < n
    return _Tag(min(n, rest.end() + 1), name[0], closing, rest[0], closed and rest[0].rstrip(WS_CHARS).endswith("/"))


class _Writer:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.space = False
        self.pre = self.code = 0
        self.pre_text: list[str] = []
        self.code_text: list[str] = []
        self.lists: list[int | None] = []
        self.links: list[str | None] = []
        self.first_cell = True

    # Output is a list of non-empty strings, so its end is the last one's.
    def put(self, s: str) -> None:
        if s:
            self.out.append(s)

    def trim(self) -> None:
        while self.out:
            kept = self.out[-1].rstrip(" \t")
            if kept == self.out[-1]:
                return
            self.out.pop()
            if kept:
                self.out.append(kept)
                return

    def flush_space(self) -> None:
        if self.space and self.out and self.out[-1][-1] not in "\n \t[>(":
            self.out.append(" ")
        self.space = False

    def newline(self) -> None:
        self.space = False
        self.trim()
        if self.out and self.out[-1][-1] != "\n":
            self.out.append("\n")

    def blank(self) -> None:
        self.space = False
        self.trim()
        if self.out:
            tail = "".join(self.out[-2:])[-2:]
            self.put("\n" * (2 - (2 if tail == "\n\n" else tail.endswith("\n"))))

    def text(self, raw: str) -> None:
        if not raw:
            return
        text = decode_entities(raw)
        if self.pre:
            self.pre_text.append(text)
            self.space = False
        elif self.code:
            self.code_text.append(text.replace("\n", " ").replace("\r", " "))
        else:
            for piece in _PIECE.findall(text):
                if piece[0] in WS_CHARS:
                    self.space = True
                else:
                    self.flush_space()
                    self.out.append(_ESCAPED.sub(r"\\\1", piece))

    def start(self, tag: str, attrs: str) -> None:
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.blank()
            self.put("#" * int(tag[1]) + " ")
        elif tag in PARAGRAPHS or tag == "table":
            self.blank()
        elif tag == "br":
            self.newline()
        elif tag == "hr":
            self.blank()
            self.put("---")
            self.blank()
        elif tag in ("ul", "ol"):
            self.blank()
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            self.newline()
            self.put("  " * min(max(len(self.lists) - 1, 0), MAX_INDENT))
            if self.lists and self.lists[-1] is not None:
                self.put(f"{self.lists[-1]}. ")
                self.lists[-1] += 1
            else:
                self.put("- ")
        elif tag == "a":
            href = attribute(attrs, "href")
            target = destination(href) if href is not None else None
            if target is not None:
                self.flush_space()
                self.put("[")
            self.links.append(target)
        elif tag in ("strong", "b", "em", "i"):
            self.flush_space()
            self.put("**" if tag in ("strong", "b") else "_")
        elif tag == "code":
            if not self.pre:
                self.flush_space()
                if not self.code:
                    self.code_text = []
                self.code += 1
        elif tag == "pre":
            self.blank()
            if not self.pre:
                self.pre_text = []
            self.pre += 1
        elif tag == "blockquote":
            self.blank()
            self.put("> ")
        elif tag == "tr":
            self.newline()
            self.first_cell = True
        elif tag in ("td", "th"):
            if not self.first_cell:
                self.put("\t")
            self.first_cell = False
        elif tag == "img":
            self.text(attribute(attrs, "alt") or "")

    def end(self, tag: str) -> None:
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" or tag in PARAGRAPHS or tag in ("blockquote", "table"):
            self.blank()
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.blank()
        elif tag == "li":
            self.newline()
        elif tag == "a":
            target = self.links.pop() if self.links else None
            if target is not None:
                self.trim()
                self.put(f"]({target})")
        elif tag in ("strong", "b", "em", "i"):
            self.trim()
            self.put("**" if tag in ("strong", "b") else "_")
        elif tag == "code":
            if not self.pre and self.code:
                self.code -= 1
                if not self.code:
                    body = "".join(self.code_text)
                    fence = _fence(body, 1)
                    edge = " " if body[:1] == "`" or body[-1:] == "`" else ""
                    self.put(fence + edge + body + edge + fence)
                    self.code_text, self.space = [], False
        elif tag == "pre":
            if self.pre:
                self.pre -= 1
                if not self.pre:
                    body = "".join(self.pre_text)
                    fence = _fence(body, 3)
                    self.put(fence + "\n" + body + ("" if body.endswith("\n") else "\n") + fence + "\n\n")
                    self.pre_text, self.space = [], False
        elif tag == "tr":
            self.newline()
            self.first_cell = True


def _fence(body: str, least: int) -> str:
    return "`" * max(least, 1 + max(map(len, re.findall("`+", body)), default=0))


_RAW_CLOSE = {name: re.compile(rf"<\s*+/\s*+{name}(?![A-Za-z0-9])", re.IGNORECASE) for name in ("script", "style")}


def _raw_end(text: str, at: int, name: str) -> int:
    # Only where the name itself follows is a tag read, and one that has no end is the last: nothing is read twice.
    for found in _RAW_CLOSE[name].finditer(text, at):
        lt = found.start()
        tag = _tag(text, lt)
        if tag is not None and tag.closing and tag.name == name:
            return tag.end
        if tag is None and text.find(">", lt) < 0:
            break
    return len(text)


def html_to_markdown(text: str) -> str:
    """Markdown with the headings, lists, links, emphasis, code and tables of an HTML text."""
    out, at = _Writer(), 0
    while at < len(text):
        lt = text.find("<", at)
        if lt < 0:
            out.text(text[at:])
            break
        out.text(text[at:lt])
        tag = _tag(text, lt)
        if tag is None:
            out.text("<")
            at = lt + 1
            continue
        at = tag.end
        if tag.closing:
            out.end(tag.name)
        elif tag.name in ("script", "style"):
            if not tag.alone:
                at = _raw_end(text, at, tag.name)
        elif tag.name:
            out.start(tag.name, tag.attrs)
            if tag.alone:
                out.end(tag.name)
    return "".join(out.out).strip(" \t\n\r")
