"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Word separators of all word-based operators: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package ships beside the interpreter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs in one process (tests, a laptop) a local temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "textpipe-shared")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there.

    Lost executors cost no more than their running tasks; the folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textpipe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found._textpipe_place = place
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        place = getattr(df, "_textpipe_place", None)
        if place is not None:
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows whose texts are held as Python objects at once.
SLICE_ROWS = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices; at the end of a task its freed memory goes back to the machine, since workers stay for later tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the one knob for how widely keys are dealt."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
