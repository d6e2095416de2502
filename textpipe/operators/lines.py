"""The line operations as relations, for texts too large for one cell.

A text is rows ``doc_id, line_no, content``; whether a newline ends it is kept beside, in
``doc_id, newline``.  Filters and projections stay where the rows are; repeated lines are
found by ``(doc_id, content)``, so one huge text is spread over all tasks; ordering is a
range-partitioned sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.columns import content_array, is_blank, lower


@dataclass(frozen=True)
class Lines:
    """Lines of texts, and the texts themselves (ids, final newline)."""

    rows: DataFrame
    texts: DataFrame


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lines:
    """Null texts have no lines and stay null when put together again."""
    held = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = held.select("doc_id", F.col("text").endswith("\n").alias("newline"), F.col("text").isNull().alias("absent"))
    rows = held.select("doc_id", F.posexplode(content_array(F.col("text"))).alias("line_no", "content"))
    return Lines(rows, texts)


def collapse_whitespace(lines: Lines) -> Lines:
    return Lines(lines.rows.withColumn("content", columns.collapse_whitespace(F.col("content"))), lines.texts)


def trim_trailing_whitespace(lines: Lines) -> Lines:
    return Lines(lines.rows.withColumn("content", F.regexp_replace("content", r"(?U)(?<!\s)\s++\z", "")), lines.texts)


def remove_blank_lines(lines: Lines) -> Lines:
    return Lines(lines.rows.where(~is_blank(F.col("content"))), lines.texts)


def dedupe_lines(lines: Lines) -> Lines:
    return Lines(lines.rows.groupBy("doc_id", "content").agg(F.min("line_no").alias("line_no")).select("doc_id", "line_no", "content"), lines.texts)


def prefix_lines(lines: Lines, prefix: str) -> Lines:
    return Lines(lines.rows.withColumn("content", F.when(F.col("content") == "", "").otherwise(F.concat(F.lit(prefix), "content"))), lines.texts)


def suffix_lines(lines: Lines, suffix: str) -> Lines:
    return Lines(lines.rows.withColumn("content", F.when(F.col("content") == "", "").otherwise(F.concat("content", F.lit(suffix)))), lines.texts)


def sort_lines(lines: Lines, descending: bool = False, case_insensitive: bool = False) -> DataFrame:
    """Rows in order: by text, then line; lines with equal keys keep their order."""
    key = lower(F.col("content")) if case_insensitive else F.col("content")
    return lines.rows.orderBy("doc_id", key.desc() if descending else key.asc(), "line_no")


def renumbered(lines: Lines, descending: bool = False, case_insensitive: bool = False) -> Lines:
    """Like :func:`sort_lines`, with new numbers; the lines of one text meet in one task."""
    key = lower(F.col("content")) if case_insensitive else F.col("content")
    order = Window.partitionBy("doc_id").orderBy(key.desc() if descending else key.asc(), "line_no")
    return Lines(lines.rows.withColumn("line_no", F.row_number().over(order) - 1), lines.texts)


def unwrap_lines(lines: Lines) -> DataFrame:
    """``doc_id, out``: paragraphs (runs of lines without blank ones between) on one line each."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    content = F.regexp_replace("content", r"(?U)\A\s++|(?<!\s)\s++\z", "")
    rows = lines.rows.withColumn("content", content).withColumn("paragraph", F.sum(F.when(F.col("content") == "", 1).otherwise(0)).over(so_far)).where("content <> ''")
    each = rows.groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), " ").alias("p"))
    whole = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "p"))), lambda x: x["p"]), "\n\n").alias("out"))
    return lines.texts.join(whole, "doc_id", "left").select("doc_id", F.when(~F.col("absent"), F.coalesce("out", F.lit(""))).alias("out"))


def assemble(lines: Lines, separator: str = "\n", final: bool = True) -> DataFrame:
    """``doc_id, out``: the texts put together again; one without lines is empty."""
    joined = lines.rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), separator).alias("joined"))
    end = F.when(F.col("newline"), separator).otherwise("") if final else F.lit("")
    return lines.texts.join(joined, "doc_id", "left").select("doc_id", F.when(~F.col("absent"), F.coalesce(F.concat("joined", end), F.lit(""))).alias("out"))
