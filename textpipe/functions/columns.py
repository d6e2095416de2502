"""Every operation as a Catalyst column, and Arrow batches only where a parser is needed.

Regular expressions keep to what Java matches without recursion: no repeated groups, and
possessive or single-class repetitions, so floods of any length stay linear and shallow.
A null text stays null.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..plans.config import Operation
from . import interpreter
from .interpreter import BRACKETS, EDGE_PUNCTUATION, TRACKERS
from .unicode import WS_CHARS

LINE_END = r"(?<!\r)\r*+\n"
_BLANK = r"(?U)\A\s*+\z"
#: A token with the white space before it, or what white space is left at the end.
_PIECE = r"(?U)(\s*+\S++|\s++)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- lines


_ASCII = " \t\n\x0b\f\r"


def _any(tests: list[Column]) -> Column:
    return reduce(operator.or_, tests)


def _on_spaces(c: Column, passes: Callable[[Column, str], Column]) -> Column:
    """``passes`` with what makes ``\\s`` stand for all white space: nothing for ASCII texts, whose class is a table look-up."""
    return F.when(F.octet_length(c) == F.length(c), passes(c, "")).otherwise(passes(c, "(?U)"))


def line_array(c: Column) -> Column:
    return F.when(c.contains("\r"), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))


def content_array(c: Column) -> Column:
    """Lines without the empty rest after a final newline."""
    body = F.when(c.endswith("\n"), F.left(c, F.length(c) - 1)).otherwise(c)
    return F.when(c.contains("\r"), F.split(F.regexp_replace(c, LINE_END + r"\z", ""), LINE_END, -1)).otherwise(F.split(body, "\n", -1))


def _final(c: Column) -> Column:
    return F.when(c.endswith("\n"), "\n").otherwise("")


def _on_lines(c: Column, change: Callable[[Column], Column]) -> Column:
    return F.concat(F.array_join(change(content_array(c)), "\n"), _final(c))


def is_blank(x: Column) -> Column:
    return x.rlike(_BLANK)


# The first character of each pattern is a class or a newline, and look-behinds come after it: most places fail at once.
_INLINE = {"": r"[ \t\x0B\f\r]", "(?U)": r"[\s&&[^\n]]"}
_TRAILING = {u: rf"{u}{x}(?<!{x}{x}){x}*+(?=\n|\z)" for u, x in _INLINE.items()}


def collapse_whitespace(c: Column) -> Column:
    return F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r"[ \t](?:(?<=\t)|(?=[ \t]))[ \t]*+", " ")).otherwise(c)


def trim_trailing_whitespace(c: Column) -> Column:
    return _on_spaces(c, lambda x, u: F.regexp_replace(x, _TRAILING[u], ""))


def remove_blank_lines(c: Column) -> Column:
    def lines(x: Column) -> Column:
        return let(F.filter(content_array(x), lambda y: ~is_blank(y)), lambda k: F.when(F.size(k) > 0, F.concat(F.array_join(k, "\n"), _final(x))).when(k.isNotNull(), ""))

    def passes(x: Column, u: str) -> Column:
        # Blank lines between others, at the start, and one at the end without a newline of its own.
        between = F.regexp_replace(x, u + r"\n\s*\n", "\n")
        edges = F.regexp_replace(between, u + r"\A\s*\n", "")
        edges = F.regexp_replace(F.regexp_replace(edges, u + rf"\n{_INLINE[u]}++\z", ""), u + r"\A\s++\z", "")
        if u:
            return edges
        return F.when(_any([x.startswith(space) for space in _ASCII] + [x.endswith(space) for space in _ASCII if space != "\n"]), edges).otherwise(between)

    return F.when(c.contains("\r"), lines(c)).otherwise(_on_spaces(c, passes))


def trim_and_filter(c: Column, collapse: bool = False) -> Column:
    """Runs of blanks if asked, trailing white space and blank lines at once; equal to the single steps in that order."""

    def passes(x: Column, u: str) -> Column:
        if collapse:
            x = F.regexp_replace(x, r"[ \t](?:(?<=\t)|(?=[ \t]))[ \t]*+", " ")
        return F.ltrim(F.regexp_replace(F.regexp_replace(x, _TRAILING[u], ""), r"\n{2,}+", "\n"), F.lit("\n"))

    return _on_spaces(c, passes)


def unwrap_lines(c: Column) -> Column:
    def passes(x: Column, u: str) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, _TRAILING[u], ""), u + rf"\n{_INLINE[u]}++", "\n")
        x = F.regexp_replace(F.ltrim(x, F.lit(WS_CHARS)), r"\n(?<!\n\n)\n*+\z", "")
        return F.regexp_replace(F.regexp_replace(x, r"\n(?<!\n\n)(?!\n)", " "), r"\n{3,}+", "\n\n")

    return _on_spaces(c, passes)


def lower(c: Column) -> Column:
    """Lower case without a final form of sigma."""
    return F.when(c.contains("Σ"), F.lower(F.translate(c, "Σ", "σ"))).otherwise(F.lower(c))


def sort_lines(c: Column, descending: bool = False, case_insensitive: bool = False) -> Column:
    if not case_insensitive:
        return _on_lines(c, lambda lines: F.sort_array(lines, not descending))
    sign = -1 if descending else 1
    keyed = lambda lines: F.transform(lines, lambda x, i: F.struct(lower(x).alias("k"), (i * sign).alias("i"), x.alias("x")))
    return _on_lines(c, lambda lines: F.transform(F.sort_array(keyed(lines), not descending), lambda s: s["x"]))


def dedupe_lines(c: Column) -> Column:
    return _on_lines(c, F.array_distinct)


def prefix_lines(c: Column, prefix: str) -> Column:
    return _on_lines(c, lambda lines: F.transform(lines, lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(prefix), x))))


def suffix_lines(c: Column, suffix: str) -> Column:
    return _on_lines(c, lambda lines: F.transform(lines, lambda x: F.when(x == "", x).otherwise(F.concat(x, F.lit(suffix)))))


def join_with(c: Column, separator: str) -> Column:
    return F.array_join(line_array(c), separator)


def split_on(c: Column, delimiter: str) -> Column:
    return F.replace(c, F.lit(delimiter), F.lit("\n"))


# ---------------------------------------------------------------- case


def _words(c: Column, change: Callable[[Column], Column], wanted: str | None = None) -> Column:
    """Each token (of those that match ``wanted``) changed; all else, white space included, stays."""

    def piece(p: Column) -> Column:
        changed = let(F.regexp_replace(p, r"(?U)\A\s++", ""), lambda t: F.concat(F.left(p, F.length(p) - F.length(t)), change(t)))
        return changed if wanted is None else F.when(p.rlike(wanted), changed).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(1)), piece), "")


def title(c: Column) -> Column:
    return _words(c, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), lower(F.substr(w, F.lit(2)))))


def _per_text(f: Callable[[str], str]):
    """An Arrow function.  It is declared as not deterministic so that Catalyst never merges the projections on both sides of it, which would run it twice or nest it where it can't be taken out."""

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run.asNondeterministic()


_sentence = _per_text(interpreter.sentence)


def _kept(c: Column) -> Column:
    """Hides a case conversion from the rule that makes one of two: ``upper(lower(x))`` is not always ``upper(x)``."""
    return F.concat(c, F.lit(""))


def change_case(c: Column, case: str) -> Column:
    return {"upper": lambda x: _kept(F.upper(x)), "lower": lambda x: _kept(lower(x)), "title": title, "sentence": _sentence}[case](c)


# ---------------------------------------------------------------- indicators

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_TRACKER = r"(?i)\A(?:" + "|".join(re.escape(t[:-1]) + "(?s:.*)" if t.endswith("*") else re.escape(t) for t in TRACKERS) + r")\z"
_DEFANGED = r"hxxp|\[(?:://|[.@:])\]|\((?:://|[.@:])\)"


def is_email(k: Column) -> Column:
    return k.rlike(r"(?s)\A[^@]++@[^@.]++\.[^@]+\z")


def is_url(k: Column) -> Column:
    return k.rlike(r"(?s)\A(?:https?://|www\.).")


def is_ipv4(k: Column) -> Column:
    return k.rlike(rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z")


def _without(k: Column, what: str) -> Column:
    return F.length(k) - F.length(F.replace(k, F.lit(what), F.lit("")))


def is_ipv6(k: Column) -> Column:
    return k.rlike(r"\A[0-9a-fA-F:]++\z") & (_without(k, ":") >= 2) & ~k.rlike("[0-9a-fA-F]{5}") & (_without(k, "::") <= 2)


def is_bare_domain(k: Column) -> Column:
    labels = lambda p: F.forall(F.slice(p, 1, F.size(p) - 1), lambda x: x.rlike(r"\A(?!-)[A-Za-z0-9-]++(?<!-)\z"))
    return k.rlike(r"\.[A-Za-z]{2,}+\z") & let(F.split(k, r"\.", -1), lambda p: (F.size(p) >= 2) & labels(p))


def core(t: Column) -> Column:
    return F.trim(t, F.lit(EDGE_PUNCTUATION))


def _tokens(c: Column, wanted: str, change: Callable[[Column], Column], where: Column | None = None) -> Column:
    """Cores of tokens that match ``wanted`` changed, the punctuation around them kept; texts that don't meet ``where`` (default: ``wanted``) stay."""

    def one(t: Column) -> Column:
        return let(F.ltrim(t, F.lit(EDGE_PUNCTUATION)), lambda lt: let(core(t), lambda k: F.concat(F.left(t, F.length(t) - F.length(lt)), change(k), F.substr(lt, F.length(k) + 1))))

    return F.when(c.rlike(wanted) if where is None else where, _words(c, one, wanted)).otherwise(c)


def _extract(c: Column, test: Callable[[Column], Column], mark: str) -> Column:
    cores = F.transform(F.regexp_extract_all(c, F.lit(r"(?U)(\S++)"), F.lit(1)), core)
    return F.when(F.contains(c, F.lit(mark)), F.array_join(F.filter(cores, test), "\n")).otherwise(F.when(c.isNotNull(), ""))


def extract_emails(c: Column) -> Column:
    return _extract(c, is_email, "@")


def extract_urls(c: Column) -> Column:
    cores = F.transform(F.regexp_extract_all(c, F.lit(r"(?U)(\S++)"), F.lit(1)), core)
    return F.when(c.rlike(r"https?://|www\."), F.array_join(F.filter(cores, is_url), "\n")).otherwise(F.when(c.isNotNull(), ""))


def mask_identifiers(c: Column, emails: bool = False, ipv4: bool = False, ipv6: bool = False) -> Column:
    if not (emails or ipv4 or ipv6):
        return c

    def mask(k: Column) -> Column:
        out = None
        for on, test, label in ((emails, is_email, "[email]"), (ipv4, is_ipv4, "[ipv4]"), (ipv6, is_ipv6, "[ipv6]")):
            if on:
                out = F.when(test(k), label) if out is None else out.when(test(k), label)
        return out.otherwise(k)

    return _tokens(c, "[.@:]", mask)


def defang(c: Column, style: str = "square") -> Column:
    a, b = BRACKETS[style]
    dots = lambda k: F.replace(k, F.lit("."), F.lit(f"{a}.{b}"))

    def url(k: Column) -> Column:
        at = F.instr(k, "://")
        head = F.left(k, at - 1)
        mangled = F.when(head == "http", "hxxp").when(head == "https", "hxxps").otherwise(head)
        return F.when(at > 0, F.concat(mangled, F.lit(f"{a}://{b}"), dots(F.substr(k, at + 3)))).otherwise(dots(k))

    def one(k: Column) -> Column:
        return (
            F.when(k.rlike(_DEFANGED), k)
            .when(is_url(k), url(k))
            .when(is_email(k), F.replace(dots(k), F.lit("@"), F.lit(f"{a}@{b}")))
            .when(is_ipv4(k), dots(k))
            .when(is_ipv6(k), F.replace(k, F.lit(":"), F.lit(f"{a}:{b}")))
            .when(is_bare_domain(k), dots(k))
            .otherwise(k)
        )

    return _tokens(c, "[.@:]", one)


def refang(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\[(://|[.@:])\]|\((://|[.@:])\)", "$1$2"), F.lit("hxxp"), F.lit("http"))


def clean_urls(c: Column) -> Column:
    def one(k: Column) -> Column:
        rest = F.regexp_extract(k, r"\A[^#]*+", 0)
        fragment = F.substr(k, F.length(rest) + 1)
        base = F.regexp_extract(rest, r"\A[^?]*+", 0)
        pairs = F.filter(F.split(F.substr(rest, F.length(base) + 2), "&", -1), lambda p: (p != "") & ~F.regexp_extract(p, r"\A[^=]*+", 0).rlike(_TRACKER))
        query = let(pairs, lambda q: F.when(F.size(q) > 0, F.concat(F.lit("?"), F.array_join(q, "&"))).otherwise(""))
        return F.when(is_url(k) & rest.contains("?"), F.concat(base, query, fragment)).otherwise(k)

    # Anchored, and the cheap tests of the whole text apart: nothing scans to the end of a text from each url in it.
    return _tokens(c, r"(?U)\A\s*+[<>()\[\]{},;:\"']*+(?:https?://|www\.)[^?]*+\?", one, c.contains("?") & c.rlike(r"https?://|www\."))


# ---------------------------------------------------------------- markup


_strip_html = _per_text(interpreter.strip_html)
_strip_markdown = _per_text(interpreter.strip_markdown)
_html_to_markdown = _per_text(interpreter.html_to_markdown)


def _gated(c: Column, plain: Column, native: Column, parsed) -> Column:
    """The parser sees only texts that need it: all others reach it as null, and are told by that, so that the test runs once."""
    return F.coalesce(parsed(F.when(~plain, c)), native)


def _edges(c: Column) -> Column:
    """Without the white space around it; trimming walks over the whole text, so it must have something to do."""
    edge = _any([test(space) for space in "\n \t\r" for test in (c.startswith, c.endswith)])
    return F.when(edge, F.trim(c, F.lit("\n \t\r"))).otherwise(c)


def strip_html(c: Column) -> Column:
    # Expressions for whole tags were tried and are exact, but their many passes took longer than the parser.
    return _gated(c, ~c.contains("<") & ~c.contains("&") & ~c.rlike("\n[ \t]*+\n[ \t]*+\n"), _edges(c), _strip_html)


def is_plain_markdown(c: Column) -> Column:
    """Nothing but paragraphs: no mark of any construct, no white space at a line's edge but blanks at its end."""
    # An underscore counts unless it stands between letters or digits.
    mark = ~c.rlike(r"[&<>`*~\[\]()|\\#!\r_](?:(?<!_)|(?<![A-Za-z0-9]_)|(?![A-Za-z0-9]))")
    edges = ~c.startswith(" ") & ~c.startswith("\t") & ~(c.contains("\t") & c.rlike(r"\t *+(?:\n|\z)"))
    # Blanks, a list's mark or a rule, at the start of a line and of the text.
    item, rule = r"(?:[-+]|[0-9]{1,9}\.)(?:[ \t\n]|\z)", r"[-=: ]++(?:\n|\z)"
    first = F.left(c, F.lit(12)).rlike(r"\A" + item) | (F.left(c, F.lit(1)).rlike("[-=:]") & c.rlike(r"\A" + rule))
    return mark & edges & ~first & ~c.rlike(rf"\n(?:[ \t]|{item}|{rule})")


def _paragraphs(c: Column) -> Column:
    """Plain Markdown: lines are joined, unless two or more blanks break them; blanks at a paragraph's end go."""
    body = F.when(c.startswith("\n"), F.ltrim(c, F.lit("\n"))).otherwise(c)
    joined = F.regexp_replace(body, r"\n(?<![\n ]\n)(?=[^\n])", " ")
    # What is left of blanks and newlines: the end of the text, of a paragraph, of a broken line, of a line with one blank.
    more = _any([c.contains("\n\n"), c.contains(" \n"), c.endswith("\n"), c.endswith(" ")])
    return F.when(more, F.regexp_replace(joined, r"(?=[ \n])(?<![ \n])(?: *+\n*+\z| *+(\n\n)\n*+|  ++(\n)|( )\n)", "$1$2$3")).otherwise(joined)


_strip_both = _per_text(lambda text: interpreter.strip_markdown(interpreter.strip_html(text)))


def strip_markdown(c: Column) -> Column:
    return _gated(c, is_plain_markdown(c), _paragraphs(c), _strip_markdown)


def strip_html_and_markdown(c: Column) -> Column:
    """Both with one test and one hand-over: what is plain Markdown has no tags, and its edges go in any case."""
    return _gated(c, is_plain_markdown(c), _paragraphs(c), _strip_both)


def html_to_markdown(c: Column) -> Column:
    spaced = F.trim(F.regexp_replace(c, r"(?U)\s++", " "))
    text = F.regexp_replace(F.regexp_replace(spaced, r"(?<=[\[>(]) ", ""), r"([\\*_\[\]`|>])", r"\\$1")
    return _gated(c, ~c.contains("<") & ~c.contains("&"), text, _html_to_markdown)


OPERATIONS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (strip_html, strip_markdown, html_to_markdown, collapse_whitespace, trim_trailing_whitespace, remove_blank_lines, unwrap_lines, change_case, sort_lines, dedupe_lines, prefix_lines, suffix_lines, join_with, split_on, extract_emails, extract_urls, defang, refang, clean_urls, mask_identifiers)
}
#: Operations that hand some texts to Python.
PARSERS = frozenset({"strip_html", "strip_markdown", "html_to_markdown"})


def apply(operation: Operation, c: Column) -> Column:
    return OPERATIONS[operation.name](c, **dict(operation.params))
