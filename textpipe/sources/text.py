"""Texts from files and to files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..operators.cell import lossy_utf8


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, whole: ``path, text``; bytes that are not UTF-8 become U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", lossy_utf8(F.col("content")).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line, split at newlines only: ``path, line_no, content``.

    Files are read in splits; ``line_no`` grows along a file but has gaps.  Carriage returns belong to the
    newline that follows; those at the end of a file without one stay.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("content"))
    returns = F.col("content").endswith("\r")
    # Only where a line has them is its file looked at once more, for its last byte.
    ends = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), (F.substring("content", -1, 1) != F.lit(b"\n")).alias("open"))
    last = lines.where(returns).groupBy("path").agg(F.max("line_no").alias("last"))
    last = last.join(ends, F.regexp_replace("path", "^[a-z0-9]+:/*", "/") == F.regexp_replace("file", "^[a-z0-9]+:/*", "/")).where("open").select(F.col("path").alias("__path"), "last")
    tail = lines.groupBy("path").agg(F.max("line_no").alias("last_line")).withColumnRenamed("path", "__tail")
    last = last.join(tail, (F.col("__path") == F.col("__tail")) & (F.col("last") == F.col("last_line")), "left_semi")
    stays = F.col("last").isNotNull()
    rows = lines.join(last, (F.col("path") == F.col("__path")) & (F.col("line_no") == F.col("last")), "left")
    return rows.select("path", "line_no", F.when(stays | ~returns, F.col("content")).otherwise(F.regexp_replace("content", r"(?<!\r)\r++\z", "")).alias("content"))


def write_texts(df: DataFrame, path: str, column: str = "text", separator: str = "\n") -> None:
    """Texts as they are, each followed by ``separator``."""
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).text(path)


@pandas_udf(StringType())
def _ladder(raw: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        b = bytes(b)
        for encoding in ("utf-8", "utf-16", "utf-16-le", "utf-16-be"):
            try:
                return b.decode(encoding)
            except UnicodeDecodeError:
                continue
        return b.decode("utf-8", "replace")

    return raw.map(one)


def decode_ladder(c: Column) -> Column:
    """Text of bytes in UTF-8, else UTF-16 with or without a mark, else lossy UTF-8."""
    valid = F.is_valid_utf8(c.cast("string"))
    return F.when(valid, c.cast("string")).otherwise(_ladder(F.when(~valid, c)))


def best_representation(df: DataFrame) -> DataFrame:
    """``text`` and ``kind`` of a record with ``html, rtf_text, plain``: the richest one there is."""
    return df.withColumn("text", F.coalesce("html", "rtf_text", "plain")).withColumn("kind", F.when(F.col("html").isNotNull(), "html").when(F.col("rtf_text").isNotNull(), "rtf").when(F.col("plain").isNotNull(), "plain"))


def routed(df: DataFrame, column: str = "out", threshold_kb: int = 512) -> DataFrame:
    """With ``route``: ``file`` for results strictly larger than the threshold (1 KB at least), else ``inline``."""
    return df.withColumn("route", F.when(F.octet_length(column) > max(1, threshold_kb) * 1024, "file").otherwise("inline"))


def write_routed(df: DataFrame, path: str, id_col: str = "id", column: str = "out", threshold_kb: int = 512) -> DataFrame:
    """Large results as text files below ``path/name=<id>/``, each with a newline after it; the rows with ``route`` and ``file``.

    ``file`` is the folder of a large result, whose text is null in the rows; results within the threshold stay as they are.
    Ids of other characters than letters, digits, ``. _ -`` are named by ``~`` and their bytes in hexadecimal, null ids
    ``~null``; rows of one id share a folder.  What is there is replaced.
    """
    rows = routed(df, column, threshold_kb)
    name = F.col(id_col).cast("string")
    name = F.when(name.isNull(), "~null").when(name.rlike(r"\A[A-Za-z0-9._-]+\z"), name).otherwise(F.concat(F.lit("~"), F.hex(name.cast("binary"))))
    large = rows.where("route = 'file'").select(name.alias("name"), F.col(column).cast("string").alias("value"))
    large.write.mode("overwrite").partitionBy("name").text(path)
    big = F.col("route") == "file"
    return rows.withColumn("file", F.when(big, F.concat(F.lit(f"{path.rstrip('/')}/name="), name))).withColumn(column, F.when(~big, F.col(column)))
