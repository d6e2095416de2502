"""The operations as SQL functions and table functions.

``tp_<operation>`` for each of the twenty operations with its parameters as further
arguments, and their defaults; ``tp_upper``, ``tp_lower``, ``tp_title`` and ``tp_sentence``
are the cases by themselves.  Those that are one expression are SQL functions that Catalyst
inlines, all others Arrow functions.  ``tp_lines(text)`` and ``tp_tokens(text)`` are table
functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..functions import interpreter

_LINE = r"'(?<!\\r)\\r*+\\n'"
_CONTENT = rf"split(regexp_replace(t, concat({_LINE}, '\\z'), ''), {_LINE}, -1)"
_END = r"if(endswith(t, '\n'), '\n', '')"
_KEYED = rf"transform({_CONTENT}, (x, i) -> named_struct('k', lower(translate(x, 'Σ', 'σ')), 'i', if(descending, -i, i), 'x', x))"
_CORES = "transform(regexp_extract_all(t, '(?U)(\\\\S++)', 1), w -> trim(BOTH '" + interpreter.EDGE_PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'") + "' FROM w))"
#: Operations that are one SQL expression of ``t`` (and their parameters).
NATIVE: dict[str, tuple[str, str]] = {
    "collapse_whitespace": ("", r"regexp_replace(t, '[ \\t]+', ' ')"),
    "trim_trailing_whitespace": ("", r"regexp_replace(t, '(?U)(?<![\\s&&[^\\n]])[\\s&&[^\\n]]++(?=\\n|\\z)', '')"),
    "remove_blank_lines": ("", rf"if(t IS NULL, NULL, if(exists({_CONTENT}, x -> NOT x RLIKE '(?U)\\A\\s*+\\z'), concat(array_join(filter({_CONTENT}, x -> NOT x RLIKE '(?U)\\A\\s*+\\z'), '\n'), {_END}), ''))"),
    "dedupe_lines": ("", rf"concat(array_join(array_distinct({_CONTENT}), '\n'), {_END})"),
    "sort_lines": (
        ", descending BOOLEAN DEFAULT false, case_insensitive BOOLEAN DEFAULT false",
        rf"concat(array_join(if(case_insensitive, transform(if(descending, reverse(array_sort({_KEYED})), array_sort({_KEYED})), s -> s.x), if(descending, reverse(array_sort({_CONTENT})), array_sort({_CONTENT}))), '\n'), {_END})",
    ),
    "unwrap_lines": ("", rf"regexp_replace(regexp_replace(regexp_replace(array_join(transform(split(t, {_LINE}, -1), x -> regexp_replace(x, '(?U)\\A\\s++|(?<!\\s)\\s++\\z', '')), '\n'), '\\A\\n++|(?<!\\n)\\n++\\z', ''), '(?<!\\n)\\n(?!\\n)', ' '), '\\n{{2,}}+', '\n\n')"),
    "extract_emails": ("", rf"array_join(filter({_CORES}, k -> k RLIKE '(?s)\\A[^@]++@[^@.]++\\.[^@]+\\z'), '\n')"),
    "extract_urls": ("", rf"array_join(filter({_CORES}, k -> k RLIKE '(?s)\\A(?:https?://|www\\.).'), '\n')"),
    "prefix_lines": (", p STRING", rf"concat(array_join(transform({_CONTENT}, x -> if(x = '', x, concat(p, x))), '\n'), {_END})"),
    "suffix_lines": (", p STRING", rf"concat(array_join(transform({_CONTENT}, x -> if(x = '', x, concat(x, p))), '\n'), {_END})"),
    "join_with": (", p STRING", rf"array_join(split(t, {_LINE}, -1), p)"),
    "split_on": (", p STRING", r"replace(t, p, '\n')"),
    "upper": ("", "upper(t)"),
    "lower": ("", "lower(translate(t, 'Σ', 'σ'))"),
    "refang": ("", r"replace(regexp_replace(t, '\\[(://|[.@:])\\]|\\((://|[.@:])\\)', '$1$2'), 'hxxp', 'http')"),
}
#: All others run in Arrow batches when called from SQL; the DataFrame API has their column forms.
PARSED = ("strip_html", "strip_markdown", "html_to_markdown", "title", "sentence", "clean_urls", "defang", "mask_identifiers", "change_case")


@udtf(returnType=T.StructType().add("line_no", T.IntegerType()).add("content", T.StringType()).add("newline", T.BooleanType()))
class TextLines:
    """Rows of a text's lines; ``newline`` tells whether one ends the line."""

    def eval(self, text: str) -> Iterator[tuple[int, str, bool]]:
        if text is not None:
            lines, final = interpreter.content_lines(text)
            for i, line in enumerate(lines):
                yield i, line, final or i + 1 < len(lines)


@udtf(returnType=T.StructType().add("token_no", T.IntegerType()).add("token", T.StringType()).add("core", T.StringType()))
class TextTokens:
    """Rows of a text's tokens, with and without the punctuation around them."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, token in enumerate(interpreter._TOKEN.findall(text or "")):
            yield i, token, interpreter.core(token)


def register(spark: SparkSession, prefix: str = "tp_") -> list[str]:
    """Make all functions known to ``spark.sql``; their names are returned."""
    names = []
    for name, (params, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING{params}) RETURNS STRING RETURN {body}")
        names.append(prefix + name)
    for name in PARSED:
        spark.udf.register(prefix + name, _batch(getattr(interpreter, name)))
        names.append(prefix + name)
    spark.udtf.register(prefix + "lines", TextLines)
    spark.udtf.register(prefix + "tokens", TextTokens)
    return [*names, prefix + "lines", prefix + "tokens"]


def _batch(f):
    @pandas_udf(T.StringType())
    def run(*columns: pd.Series) -> pd.Series:
        # Parameters may differ from row to row; a null text or parameter gives null.
        return pd.Series([f(*row) if all(x is not None for x in row) else None for row in zip(*columns)], dtype=object)

    return run
