"""Every operation in plain Python on one text: the specification that all Spark paths are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..plans.config import Config, Operation
from .convert import html_to_markdown
from .html import strip_html
from .markdown import strip_markdown
from .unicode import WS, WS_CHARS

#: Query keys that are trackers; a star stands for any rest.
TRACKERS = (
    "utm_*",
    "oly_*",
    "mc_cid",
    "mc_eid",
    "_hsenc",
    "_hsmi",
    "hsctatracking",
    "gclid",
    "gclsrc",
    "dclid",
    "wbraid",
    "gbraid",
    "fbclid",
    "msclkid",
    "yclid",
    "twclid",
    "ttclid",
    "igshid",
    "mkt_tok",
    "vero_id",
    "vero_conv",
    "oicd",
    "icid",
    "s_kwcid",
    "ef_id",
    "_openstat",
    "wickedid",
)
#: Punctuation around a token that is not part of it.
EDGE_PUNCTUATION = "<>()[]{},;:\"'"
BRACKETS = {"square": "[]", "round": "()"}

_TRACKER = re.compile("(?:" + "|".join(re.escape(t[:-1]) + "(?s:.*)" if t.endswith("*") else re.escape(t) for t in TRACKERS) + r")\Z", re.I | re.A)
_TOKEN = re.compile(f"[^{WS}]+")
_LINE_END = re.compile(r"(?<!\r)\r*\n")


# ---------------------------------------------------------------- lines


def split_lines(text: str) -> list[str]:
    return _LINE_END.split(text)


def content_lines(text: str) -> tuple[list[str], bool]:
    """Lines, and whether a newline ends the last."""
    lines = split_lines(text)
    if text.endswith("\n"):
        return lines[:-1], True
    return lines, False


def _emit(lines: list[str], newline: bool) -> str:
    return "\n".join(lines) + ("\n" if newline else "")


def is_blank(line: str) -> bool:
    return not line.strip(WS_CHARS)


def collapse_whitespace(text: str) -> str:
    return re.sub("[ \t]+", " ", text)


def trim_trailing_whitespace(text: str) -> str:
    return "\n".join(line.rstrip(WS_CHARS) for line in text.split("\n"))


def remove_blank_lines(text: str) -> str:
    lines, newline = content_lines(text)
    kept = [x for x in lines if not is_blank(x)]
    return _emit(kept, newline) if kept else ""


def unwrap_lines(text: str) -> str:
    paragraphs: list[list[str]] = [[]]
    for line in split_lines(text):
        line = line.strip(WS_CHARS)
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def lower(text: str) -> str:
    """Lower case character by character, hence without a final form of sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def sort_lines(text: str, descending: bool = False, case_insensitive: bool = False) -> str:
    lines, newline = content_lines(text)
    key = (lambda x: lower(x).encode("utf-8", "surrogatepass")) if case_insensitive else (lambda x: x.encode("utf-8", "surrogatepass"))
    return _emit(sorted(lines, key=key, reverse=descending), newline)


def dedupe_lines(text: str) -> str:
    lines, newline = content_lines(text)
    return _emit(list(dict.fromkeys(lines)), newline)


def prefix_lines(text: str, prefix: str) -> str:
    lines, newline = content_lines(text)
    return _emit([prefix + x if x else x for x in lines], newline)


def suffix_lines(text: str, suffix: str) -> str:
    lines, newline = content_lines(text)
    return _emit([x + suffix if x else x for x in lines], newline)


def join_with(text: str, separator: str) -> str:
    return separator.join(split_lines(text))


def split_on(text: str, delimiter: str) -> str:
    return text.replace(delimiter, "\n") if delimiter else text


# ---------------------------------------------------------------- case


def title(text: str) -> str:
    return _TOKEN.sub(lambda m: m[0][0].upper() + lower(m[0][1:]), text)


def sentence(text: str) -> str:
    out, expecting, ended = [], True, False
    for c in lower(text):
        if ended and c in WS_CHARS:
            expecting = True
        ended = c in ".!?"
        if expecting:
            up = c.upper()
            expecting = up == c
            c = up
        out.append(c)
    return "".join(out)


def change_case(text: str, case: str) -> str:
    return {"upper": str.upper, "lower": lower, "title": title, "sentence": sentence}[case](text)


# ---------------------------------------------------------------- indicators


def core(token: str) -> str:
    return token.strip(EDGE_PUNCTUATION)


def is_email(s: str) -> bool:
    local, at, domain = s.partition("@")
    dot = domain.find(".")
    return bool(local and at) and "@" not in domain and 0 < dot < len(domain) - 1


def is_url(s: str) -> bool:
    return any(s.startswith(p) and len(s) > len(p) for p in ("http://", "https://", "www."))


def is_ipv4(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def is_ipv6(s: str) -> bool:
    return s.count(":") >= 2 and not re.search(r"[^0-9A-Fa-f:]|[0-9A-Fa-f]{5}", s) and s.count("::") <= 1


def is_bare_domain(s: str) -> bool:
    *labels, tld = s.split(".")
    if not labels or not re.fullmatch("[A-Za-z]{2,}", tld):
        return False
    return all(re.fullmatch("[A-Za-z0-9-]+", x) and x[0] != "-" and x[-1] != "-" for x in labels)


def _tokens(text: str, change: Callable[[str], str]) -> str:
    """Each token with its core changed; punctuation around it stays."""

    def one(m: re.Match) -> str:
        token = m[0]
        head = len(token) - len(token.lstrip(EDGE_PUNCTUATION))
        body = core(token)
        return token[:head] + change(body) + token[head + len(body) :] if body else token

    return _TOKEN.sub(one, text)


def extract_emails(text: str) -> str:
    return "\n".join(c for c in map(core, _TOKEN.findall(text)) if is_email(c))


def extract_urls(text: str) -> str:
    return "\n".join(c for c in map(core, _TOKEN.findall(text)) if is_url(c))


def mask_identifiers(text: str, emails: bool = False, ipv4: bool = False, ipv6: bool = False) -> str:
    def mask(c: str) -> str:
        return "[email]" if emails and is_email(c) else "[ipv4]" if ipv4 and is_ipv4(c) else "[ipv6]" if ipv6 and is_ipv6(c) else c

    return _tokens(text, mask)


_DEFANGED = re.compile(r"hxxp|\[(?:://|[.@:])\]|\((?:://|[.@:])\)")


def defang(text: str, style: str = "square") -> str:
    a, b = BRACKETS[style]

    def bracket(s: str, marks: str) -> str:
        return re.sub(f"[{re.escape(marks)}]", lambda m: a + m[0] + b, s)

    def one(token: str) -> str:
        c = token
        if _DEFANGED.search(c):
            return token
        if is_url(c):
            head, sep, rest = c.partition("://")
            if sep:
                return {"http": "hxxp", "https": "hxxps"}.get(head, head) + a + sep + b + bracket(rest, ".")
            return bracket(c, ".")
        if is_email(c):
            return bracket(c, ".@")
        if is_ipv4(c) or is_bare_domain(c):
            return bracket(c, ".")
        return bracket(c, ":") if is_ipv6(c) else c

    return _tokens(text, one)


def refang(text: str) -> str:
    return re.sub(r"\[(://|[.@:])\]|\((://|[.@:])\)|hxxp", lambda m: m[1] or m[2] or "http", text)


def is_tracker(key: str) -> bool:
    return _TRACKER.match(key) is not None


def clean_urls(text: str) -> str:
    def one(c: str) -> str:
        if not is_url(c):
            return c
        rest, hash_, fragment = c.partition("#")
        base, mark, query = rest.partition("?")
        if not mark:
            return c
        kept = [p for p in query.split("&") if p and not is_tracker(p.partition("=")[0])]
        return base + ("?" + "&".join(kept) if kept else "") + hash_ + fragment

    return _tokens(text, one)


OPERATIONS: dict[str, Callable[..., str]] = {
    f.__name__: f
    for f in (strip_html, strip_markdown, html_to_markdown, collapse_whitespace, trim_trailing_whitespace, remove_blank_lines, unwrap_lines, change_case, sort_lines, dedupe_lines, prefix_lines, suffix_lines, join_with, split_on, extract_emails, extract_urls, defang, refang, clean_urls, mask_identifiers)
}


def apply(operation: Operation, text: str) -> str:
    return OPERATIONS[operation.name](text, **dict(operation.params))


def transform(text: str, config: Config) -> str:
    """The whole pipeline, one operation after the other."""
    for operation in config.ordered():
        text = apply(operation, text)
    return text
