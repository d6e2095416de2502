"""Pipelines on a string column: each row is one text."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..plans.config import Config, ConfigError, parse_config
from ..plans.planner import Step, plan

_HELD = "__textpipe"


def step_columns(step: Step) -> list[Callable[[Column], Column]]:
    """The projections of a step, one on the other."""
    names = [o.name for o in step.operations]
    if not step.fused:
        return [partial(columns.apply, step.operations[0])]
    if names[0] == "strip_html":
        return [columns.strip_html_and_markdown]
    filtered = partial(columns.trim_and_filter, collapse=names[0] == "collapse_whitespace")
    return [filtered, columns.dedupe_lines] if names[-1] == "dedupe_lines" else [filtered]


def transform(df: DataFrame, config: Config, column: str = "text", out: str | None = None, continuous: bool = False) -> DataFrame:
    """``df`` with the pipeline's result in ``out`` (default: in place).

    Steps are chained projections, so that no step's text is computed twice.
    """
    steps = plan(config, continuous)
    df = df.withColumn(_HELD, F.col(column).cast("string"))
    for change in (change for step in steps for change in step_columns(step)):
        df = df.withColumn(_HELD, change(F.col(_HELD)))
    if out is None or out == column:
        names = df.columns[:-1]
        return df.select(*[F.col(_HELD).alias(n) if n == column else F.col(n) for n in names])
    return df.withColumnRenamed(_HELD, out)


def lossy_utf8(c: Column) -> Column:
    """Text of binary data; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def guarded(df: DataFrame, config: Config, column: str = "text", out: str = "out", most_bytes: int = 2 << 30, continuous: bool = False) -> DataFrame:
    """Like :func:`transform`, with a ``status`` for each row: ``empty``, ``too_large``, ``unchanged`` or ``transformed``.

    Texts beyond ``most_bytes`` are not touched: their result is null.
    """
    fits = F.octet_length(column) <= most_bytes
    held = df.withColumn("__in", F.when(fits, F.col(column)))
    done = transform(held, config, "__in", out, continuous)
    status = F.when(F.col(column).isNull() | (F.col(column) == ""), "empty").when(~fits, "too_large").when(F.col(out) == F.col(column), "unchanged").otherwise("transformed")
    return done.withColumn("status", status).drop("__in")


#: Status codes of a call; 3 (an internal error) fails the job here instead.
OK, NULL_ARGUMENT, INVALID_CONFIG, INTERNAL, TOO_LARGE, UNSUPPORTED_VERSION = range(6)


def coded(df: DataFrame, config_json: str | None, column: str = "text", out: str = "out", most_bytes: int = 2 << 30) -> DataFrame:
    """``out`` and a numeric ``code`` for each row, whatever the configuration is.

    Checked in this order: a null configuration or text, a text beyond ``most_bytes``, the configuration's version,
    the rest of the configuration.  ``out`` is null unless the code is 0.
    """
    config, failed = Config(), None
    try:
        config = parse_config(config_json) if config_json is not None else config
    except ConfigError as e:
        failed = UNSUPPORTED_VERSION if e.kind == "unsupported_version" else INVALID_CONFIG
    code = F.when(F.lit(config_json is None) | F.col(column).isNull(), NULL_ARGUMENT).when(F.octet_length(column) > most_bytes, TOO_LARGE).otherwise(OK if failed is None else failed)
    held = df.withColumn("code", code).withColumn("__in", F.when(F.col("code") == OK, F.col(column)))
    return transform(held, config, "__in", out).drop("__in")
