"""Markdown to plain text: CommonMark with tables, strikethrough and task lists.

Blocks are recognised line by line on a stack of containers (quotes, lists, items); leaves
keep their lines and are read inline afterwards.  Nothing is rendered: both passes hand
text, breaks and block edges to a writer that joins them.
"""

from __future__ import annotations

import html as _html
import re
import string
import unicodedata

from .html import strip_html

TAB = 4
PUNCTUATION = frozenset(string.punctuation)
_THEMATIC = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_BULLET = re.compile(r"( {0,3})([-+*])(?=[ \t]|$)")
_ORDERED = re.compile(r"( {0,3})([0-9]{1,9})([.)])(?=[ \t]|$)")
_QUOTE = re.compile(r" {0,3}>[ ]?")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TASK = re.compile(r"\[[ xX]\](?=[ \t\n]|$)")
#: Elements that start an HTML block of the sixth kind.
HTML_BLOCKS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
)
_ATTR = r"""(?:[ \t\n]+[A-Za-z_:][A-Za-z0-9_.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^ \t\n"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTR}*[ \t\n]*/?>"
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*[ \t\n]*>"
_INLINE_HTML = re.compile(rf"{_OPEN_TAG}|{_CLOSE_TAG}|<!-->|<!--->|<!--(?s:.*?)-->|<\?(?s:.*?)\?>|<![A-Za-z][^>]*>|<!\[CDATA\[(?s:.*?)\]\]>")
_HTML_STARTS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
)
_HTML_NAME = re.compile(r" {0,3}</?([A-Za-z][A-Za-z0-9]*)(?:[ \t]|/?>|$)")
_HTML_ALONE = re.compile(rf" {{0,3}}(?:{_OPEN_TAG}|{_CLOSE_TAG})[ \t]*$")
_DEFINITION = re.compile(r""" {0,3}\[((?:\\.|[^\[\]\\])+)\]:[ \t]*\n?[ \t]*(<(?:\\.|[^<>\n\\])*>|[^\s<]\S*)(?:(?:[ \t]*\n[ \t]*|[ \t]+)("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t]*(?:\n|$)""")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_PLAIN = re.compile(r"[^\\`*_\[\]!<&~\n]+")


class _Writer:
    """Joins text and block edges; at most two newlines come from edges in a row."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.newlines = 0

    def text(self, s: str) -> None:
        if not s:
            return
        self.parts.append(s)
        kept = s.rstrip(" \t\n")
        n = s[len(kept) :].count("\n")
        self.newlines = min(2, n if kept else self.newlines + n)

    def edge(self) -> None:
        if self.parts and self.newlines < 2:
            self.parts.append("\n")
            self.newlines += 1


# ---------------------------------------------------------------- blocks


class _Block:
    def __init__(self, kind: str, **more):
        self.kind, self.children, self.lines, self.open = kind, [], [], True
        self.__dict__.update(more)


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += TAB - n % TAB
        else:
            break
    return n


def _dedent(line: str, n: int, column: int = 0) -> str:
    """Without up to ``n`` columns of white space; a tab that is cut leaves spaces."""
    at = seen = 0
    while at < len(line) and seen < n:
        if line[at] == " ":
            seen += 1
        elif line[at] == "\t":
            width = TAB - (column + seen) % TAB
            if seen + width > n:
                return " " * (seen + width - n) + line[at + 1 :]
            seen += width
        else:
            break
        at += 1
    return line[at:]


class _Parser:
    def __init__(self, text: str):
        self.root = _Block("document")
        self.definitions: set[str] = set()
        self.stack = [self.root]
        for line in re.split(r"\r\n|\n|\r", text):
            self.line(line)
        self.close_to(1)

    # The stack holds open blocks from the document to the deepest; the last may be a leaf.
    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            block = self.stack.pop()
            if block.kind == "paragraph":
                self.finish_paragraph(block)

    def finish_paragraph(self, block: _Block) -> None:
        text = "\n".join(block.lines)
        while (m := _DEFINITION.match(text)) and m[1].strip():
            self.definitions.add(_label(m[1]))
            text = text[m.end() :]
        block.lines = text.split("\n") if text.strip(" \t\n") else []
        if not block.lines:
            block.kind = "nothing"

    def add(self, block: _Block) -> _Block:
        self.stack[-1].children.append(block)
        self.stack.append(block)
        return block

    def line(self, line: str) -> None:
        leaf = self.stack[-1]
        if len(self.stack) <= 2 and leaf.kind in ("document", "paragraph") and line[:1].isalpha():
            # No construct starts with a letter, and there is no container to go on.
            (leaf if leaf.kind == "paragraph" else self.add(_Block("paragraph"))).lines.append(line)
            return
        depth, blank = 1, not line.strip(" \t")
        # Which containers go on?
        for block in self.stack[1:]:
            if block.kind == "quote":
                m = _QUOTE.match(line)
                if not m and (m := re.match(r" {0,3}>\t", line)):
                    line = "  " + line[m.end() :]
                elif m:
                    line = line[m.end() :]
                else:
                    break
            elif block.kind == "list":
                pass
            elif block.kind == "item":
                if blank and block.children or blank and not block.begun_blank:
                    pass
                elif blank:
                    break
                elif _indent(line) >= block.indent:
                    line = _dedent(line, block.indent)
                else:
                    break
            else:
                break
            depth += 1
            blank = not line.strip(" \t")
        if self.stack[depth - 1].kind == "list":
            depth -= 1  # an item must follow, else the list is over; a sibling item finds it again below
            held_list = self.stack[depth]
        else:
            held_list = None
        lazy_ok = leaf.kind == "paragraph" and depth < len(self.stack) - (1 if held_list is None else 0)
        inside = leaf if leaf.kind in ("fence", "indented", "html", "paragraph", "table") and depth == len(self.stack) - 1 else None
        if inside is not None and inside.kind == "fence":
            m = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*$", line)
            if m and m[1][0] == inside.mark[0] and len(m[1]) >= len(inside.mark):
                self.close_to(depth)
            else:
                inside.lines.append(_dedent(line, inside.offset))
            return
        if inside is not None and inside.kind == "html":
            if inside.until is None and blank:
                self.close_to(depth)
            else:
                inside.lines.append(line)
                if inside.until is not None and inside.until.search(line):
                    self.close_to(depth)
            return
        if inside is not None and inside.kind == "indented":
            if blank or _indent(line) >= TAB:
                inside.lines.append(_dedent(line, TAB))
                return
            self.close_to(depth)
            inside = None
        if inside is not None and inside.kind == "table":
            if not blank and not self.starts_block(line):
                inside.lines.append(line)
                return
            self.close_to(depth)
            inside = None
        # New blocks on what is left of the line.
        paragraph = inside
        while True:
            blank = not line.strip(" \t")
            if blank:
                break
            indent = _indent(line)
            if indent >= TAB:
                if paragraph is None and not lazy_ok:
                    self.close_to(depth)
                    self.add(_Block("indented")).lines.append(_dedent(line, TAB))
                    return
                break
            if (m := _QUOTE.match(line)) is not None:
                self.close_to(depth)
                line = line[m.end() :] if not line[m.end() - 1 :].startswith(">\t") else "  " + line[m.end() + 1 :]
                self.add(_Block("quote"))
                depth += 1
                paragraph, lazy_ok, held_list = None, False, None
                continue
            m = _ATX.match(line)
            if m:
                self.close_to(depth)
                self.add(_Block("heading")).lines.append(re.sub(r"^#+$", "", m[2] or ""))
                self.close_to(depth)
                return
            if (m := _FENCE.match(line)) is not None:
                self.close_to(depth)
                self.add(_Block("fence", mark=m[2], offset=len(m[1])))
                return
            if (until := self.html_start(line, paragraph is not None or lazy_ok)) is not False:
                self.close_to(depth)
                block = self.add(_Block("html", until=until))
                block.lines.append(line)
                if until is not None and until.search(line):
                    self.close_to(depth)
                return
            if paragraph is not None and _SETEXT.match(line):
                self.finish_paragraph(paragraph)
                if paragraph.kind == "paragraph":
                    paragraph.kind = "heading"
                    self.stack.pop()
                    return
                self.stack.pop()
                paragraph = None
            if _THEMATIC.match(line):
                self.close_to(depth)
                self.add(_Block("rule"))
                self.close_to(depth)
                return
            m = _BULLET.match(line) or _ORDERED.match(line)
            if m:
                kind = m[2] if len(m.groups()) == 2 else m[3]
                rest = line[m.end() :]
                empty = not rest.strip(" \t")
                in_paragraph = paragraph is not None
                if in_paragraph and (empty or len(m.groups()) == 3 and m[2] != "1"):
                    break
                spaces = _indent(" " * m.end() + rest) - m.end() if not empty else 1
                if spaces > TAB:
                    spaces = 1
                if held_list is not None and held_list.mark == kind:
                    self.close_to(depth + 1)
                    depth += 1
                else:
                    self.close_to(depth)
                    self.add(_Block("list", mark=kind))
                    depth += 1
                self.add(_Block("item", indent=m.end() + spaces, begun_blank=empty))
                depth += 1
                line = "" if empty else _dedent(rest, spaces, m.end())
                paragraph, lazy_ok, held_list = None, False, None
                continue
            break
        if blank:
            if held_list is not None:
                depth += 1
            self.close_to(max(depth, 1) if paragraph is None else len(self.stack) - 1)
            return
        if paragraph is not None:
            if len(paragraph.lines) >= 1 and self.table_start(paragraph, line):
                return
            paragraph.lines.append(line.lstrip(" \t"))
            return
        if lazy_ok and leaf.kind == "paragraph" and self.stack[-1] is leaf:
            leaf.lines.append(line.lstrip(" \t"))
            return
        self.close_to(depth)
        self.add(_Block("paragraph")).lines.append(line.lstrip(" \t"))

    def starts_block(self, line: str) -> bool:
        return bool(_QUOTE.match(line) or _ATX.match(line) or _FENCE.match(line) or _THEMATIC.match(line) or _BULLET.match(line) or _ORDERED.match(line) or self.html_start(line, True) is not False)

    @staticmethod
    def html_start(line: str, in_paragraph: bool):
        """False, or what ends the HTML block that starts here (None: a blank line)."""
        if "<" not in line:
            return False
        for start, until in _HTML_STARTS:
            if start.match(line):
                return until
        m = _HTML_NAME.match(line)
        if m and m[1].lower() in HTML_BLOCKS:
            return None
        return None if not in_paragraph and _HTML_ALONE.match(line) else False

    def table_start(self, paragraph: _Block, line: str) -> bool:
        if "-" not in line or not _DELIMITERS.match(line) or "|" not in line and ":" not in line and "|" not in paragraph.lines[-1]:
            return False
        head = paragraph.lines[-1]
        if len(_cells(head)) != len(_cells(line)):
            return False
        paragraph.lines.pop()
        self.stack.pop()
        if paragraph.lines:
            self.finish_paragraph(paragraph)
        else:
            paragraph.kind = "nothing"
        self.add(_Block("table", head=head, width=len(_cells(line))))
        return True


def _cells(line: str) -> list[str]:
    line = line.strip(" \t")
    if line.startswith("|"):
        line = line[1:]
    cells = re.split(r"(?<!\\)\|", line)
    if len(cells) > 1 and not cells[-1].strip(" \t"):
        cells.pop()
    return [c.strip(" \t").replace("\\|", "|") for c in cells]


def _label(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text.strip()).casefold()


# ---------------------------------------------------------------- inlines


def _unescape(s: str) -> str:
    return _html.unescape(s) if _ENTITY.fullmatch(s) else s


class _Run:
    """A run of ``*``, ``_`` or ``~`` that may open or close emphasis."""

    def __init__(self, mark: str, n: int, opens: bool, closes: bool, at: int):
        self.mark, self.n, self.full, self.opens, self.closes, self.at, self.live = mark, n, n, opens, closes, at, True


class _Inline:
    """Reads a leaf's text into pieces: ``("text", s)``, ``("soft",)``, ``("hard",)``, ``("html", s)``."""

    def __init__(self, text: str, definitions: set[str]):
        self.text, self.definitions = text, definitions
        self.pieces: list[list[str]] = []
        self.runs: list[_Run] = []
        self.brackets: list[list] = []  # place in pieces, is image, place in text, live, runs before
        self.ticks: dict[int, list[int]] | None = None
        self.read()
        self.emphasis(0)

    def put(self, s: str, kind: str = "text") -> None:
        self.pieces.append([kind, s])

    def read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        while at < n:
            m = _PLAIN.match(text, at)
            if m:
                s = m[0]
                at = m.end()
                if at < n and text[at] == "\n":
                    kept = s.rstrip(" ")
                    self.put(kept)
                    self.put("", "hard" if len(s) - len(kept) >= 2 else "soft")
                    at += 1
                    at += len(text[at:]) - len(text[at:].lstrip(" \t")) if text[at : at + 1] in (" ", "\t") else 0
                else:
                    self.put(s)
                continue
            c = text[at]
            if c == "\n":
                self.put("", "soft")
                at += 1
            elif c == "\\":
                follow = text[at + 1 : at + 2]
                if follow == "\n":
                    self.put("", "hard")
                    at += 2
                elif follow in PUNCTUATION and follow:
                    self.put(follow)
                    at += 2
                else:
                    self.put("\\")
                    at += 1
            elif c == "`":
                at = self.code(at)
            elif c in "*_~":
                at = self.run(at)
            elif c == "!" and text[at + 1 : at + 2] == "[":
                self.brackets.append([len(self.pieces), True, at + 2, True, len(self.runs)])
                self.put("![")
                at += 2
            elif c == "[":
                self.brackets.append([len(self.pieces), False, at + 1, True, len(self.runs)])
                self.put("[")
                at += 1
            elif c == "]":
                at = self.close(at)
            elif c == "<":
                if (m := _AUTOLINK.match(text, at)) is not None:
                    self.put(m[1])
                    at = m.end()
                elif (m := _INLINE_HTML.match(text, at)) is not None:
                    self.put(m[0], "html")
                    at = m.end()
                else:
                    self.put("<")
                    at += 1
            elif c == "&" and (m := _ENTITY.match(text, at)) is not None:
                self.put(_unescape(m[0]))
                at = m.end()
            else:
                self.put(c)
                at += 1

    def code(self, at: int) -> int:
        if self.ticks is None:
            self.ticks = {}
            for m in re.finditer("`+", self.text):
                self.ticks.setdefault(len(m[0]), []).append(m.start())
            for places in self.ticks.values():
                places.reverse()
        n = len(re.compile("`+").match(self.text, at)[0])
        places = self.ticks.get(n, [])
        while places and places[-1] <= at:
            places.pop()
        if not places:
            self.put("`" * n)
            return at + n
        end = places[-1]
        body = self.text[at + n : end].replace("\n", " ")
        if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
            body = body[1:-1]
        self.put(body)
        return end + n

    def run(self, at: int) -> int:
        text, mark = self.text, self.text[at]
        end = at
        while end < len(text) and text[end] == mark:
            end += 1
        before, after = text[at - 1] if at else " ", text[end] if end < len(text) else " "
        space = lambda c: c in "\t\n\x0c\r" or unicodedata.category(c) == "Zs"
        punct = lambda c: c in PUNCTUATION or unicodedata.category(c)[0] in "PS"
        left = not space(after) and (not punct(after) or space(before) or punct(before))
        right = not space(before) and (not punct(before) or space(after) or punct(after))
        opens, closes = left, right
        if mark == "_":
            opens, closes = left and (not right or punct(before)), right and (not left or punct(after))
        if mark != "~" or end - at <= 2:
            self.runs.append(_Run(mark, end - at, opens, closes, len(self.pieces)))
        self.put(text[at:end])
        return end

    def emphasis(self, bottom: int) -> None:
        """Pairs the runs from ``bottom`` on; what pairs use up leaves the text."""
        runs = self.runs[bottom:]
        floor: dict[tuple, int] = {}
        for i, closer in enumerate(runs):
            while closer.closes and closer.n:
                key = (closer.mark, closer.opens, closer.full % 3) if closer.mark != "~" else (closer.mark, closer.full)
                found = None
                for j in range(i - 1, floor.get(key, 0) - 1, -1):
                    o = runs[j]
                    if not o.live or not o.n or not o.opens or o.mark != closer.mark:
                        continue
                    if o.mark == "~":
                        if o.full != closer.full:
                            continue
                    elif (o.closes or closer.opens) and (o.full + closer.full) % 3 == 0 and (o.full % 3 or closer.full % 3):
                        continue
                    found = j
                    break
                if found is None:
                    floor[key] = i
                    break
                o = runs[found]
                used = o.n if o.mark == "~" else 2 if o.n >= 2 and closer.n >= 2 else 1
                o.n -= used
                closer.n -= used
                for k in range(found + 1, i):
                    runs[k].live = False
        for r in runs:
            self.pieces[r.at][1] = r.mark * r.n
        del self.runs[bottom:]

    def close(self, at: int) -> int:
        if not self.brackets:
            self.put("]")
            return at + 1
        place, image, start, live, runs = self.brackets.pop()
        if not live:
            self.put("]")
            return at + 1
        end = self.target(start, at)
        if end is None:
            self.put("]")
            return at + 1
        self.pieces[place][1] = ""
        self.emphasis(runs)
        if not image:
            for b in self.brackets:
                if not b[1]:
                    b[3] = False
        return end

    def target(self, start: int, at: int) -> int | None:
        """Where a link ends whose text ends at ``at``, if it is one."""
        text = self.text
        if text[at + 1 : at + 2] == "(" and (end := _inline_target(text, at + 2)) is not None:
            return end
        if (m := re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(text, at + 1)) is not None:
            label = m[1] if m[1].strip() else text[start:at]
            return m.end() if _label(label) in self.definitions else None
        return at + 1 if self.definitions and _label(text[start:at]) in self.definitions else None


_GAP = re.compile(r"[ \t]*\n?[ \t]*")
_ANGLE = re.compile(r"<(?:\\.|[^<>\n\\])*>")
_TITLE = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)""", re.S)


def _inline_target(text: str, at: int) -> int | None:
    at = _GAP.match(text, at).end()
    m = _ANGLE.match(text, at)
    if m:
        at = m.end()
    else:
        depth = 0
        while at < len(text):
            c = text[at]
            if c == "\\" and text[at + 1 : at + 2] in PUNCTUATION and at + 1 < len(text):
                at += 2
                continue
            if c <= " " or c == "\x7f":
                break
            if c == "(":
                depth += 1
                if depth > 32:
                    return None
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        if depth:
            return None
    gap = _GAP.match(text, at).end()
    if gap > at and (m := _TITLE.match(text, gap)) is not None:
        gap = _GAP.match(text, m.end()).end()
    return gap + 1 if text[gap : gap + 1] == ")" else None


# ---------------------------------------------------------------- output


_MARKS = re.compile(r"[\\`*_~\[\]<&]|  \n")


def _inline(out: _Writer, text: str, definitions: set[str]) -> None:
    if not _MARKS.search(text):
        out.text(re.sub(" ?\n", " ", text))
        return
    for kind, s in _Inline(text, definitions).pieces:
        if kind == "text":
            out.text(s)
        elif kind == "html":
            out.text(strip_html(s))
        elif kind == "soft":
            out.text(" ")
        else:
            out.edge()


def _write(out: _Writer, root: _Block, definitions: set[str]) -> None:
    """Depth first, without recursion: nesting has no bound."""
    todo: list[tuple[_Block, bool, bool]] = [(root, False, True)]
    while todo:
        block, ended, loose = todo.pop()
        kind = block.kind
        if ended:
            out.edge()
            continue
        if kind in ("quote", "list"):
            out.edge()
        if kind in ("document", "quote", "list", "item"):
            if kind != "document":
                todo.append((block, True, loose))
            spread = loose if kind != "list" else block.loose
            for child in reversed(block.children):
                todo.append((child, False, spread if kind in ("list", "item") else True))
        elif kind == "paragraph":
            text = "\n".join(block.lines).rstrip(" \t")
            if getattr(block, "first_in_item", False) and (m := _TASK.match(text)):
                text = text[m.end() :].lstrip(" \t")
            if loose:
                out.edge()
            _inline(out, text, definitions)
            if loose:
                out.edge()
        elif kind == "heading":
            out.edge()
            _inline(out, "\n".join(block.lines).strip(" \t"), definitions)
            out.edge()
        elif kind == "rule":
            out.edge()
        elif kind in ("fence", "indented"):
            lines = block.lines
            if kind == "indented":
                while lines and not lines[-1].strip(" \t"):
                    lines.pop()
            out.edge()
            out.text("".join(line + "\n" for line in lines))
            out.edge()
        elif kind == "html":
            out.edge()
            for line in block.lines:
                out.text(strip_html(line + "\n"))
            out.edge()
        elif kind == "table":
            out.edge()
            for line in [block.head, *block.lines]:
                cells = (_cells(line) + [""] * block.width)[: block.width]
                for k, cell in enumerate(cells):
                    if k:
                        out.text("\t")
                    _inline(out, cell, definitions)
                out.edge()
            out.edge()


def _mark_loose(root: _Block) -> None:
    todo = [root]
    while todo:
        block = todo.pop()
        todo.extend(block.children)
        if block.kind == "item":
            real = [c for c in block.children if c.kind != "nothing"]
            if real and real[0].kind == "paragraph":
                real[0].first_in_item = True
        if block.kind == "list":
            block.loose = getattr(block, "gap", False)


class _Spaced(_Parser):
    """Notes which lists have blank lines between their items or between an item's blocks."""

    def __init__(self, text: str):
        self.was_blank = False
        super().__init__(text)

    def add(self, block: _Block) -> _Block:
        if self.was_blank:
            parent = self.stack[-1]
            if parent.kind == "list":
                parent.gap = bool(parent.children)
            elif parent.kind == "item" and parent.children and len(self.stack) > 1:
                self.stack[-2].gap = True
            self.was_blank = False
        return super().add(block)

    def line(self, line: str) -> None:
        inner = line.lstrip(" \t>")
        blank = not inner
        super().line(line)
        self.was_blank = blank


def strip_markdown(text: str) -> str:
    """Text of a Markdown document, without its marks."""
    if not text:
        return ""
    parser = _Spaced(text)
    _mark_loose(parser.root)
    out = _Writer()
    _write(out, parser.root, parser.definitions)
    return "".join(out.parts).strip("\n \t\r")
