"""Continuous runs: records with a generation, html or plain text, transformed as they come.

All of it is stateless column work, so the same functions serve batches and streams; what a
stream keeps of several records in one micro-batch is the latest (:func:`latest`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cell import guarded
from ..plans.config import Config, op
from ..plans.planner import plan
from ..sources.text import best_representation

#: Markers of records that must not be processed.
DO_NOT_PROCESS = ("org.nspasteboard.TransientType", "org.nspasteboard.ConcealedType", "org.nspasteboard.AutoGeneratedType")
POLL = "500 milliseconds"
SCHEMA = "generation long, html string, rtf_text string, plain string, markers array<string>, origin string"


def effective(config: Config, kind: str) -> Config:
    """For html sources tags are stripped first, whatever else is asked for."""
    if kind != "html":
        return config
    return Config((op("strip_html"), *[o for o in config.operations if o.name != "strip_html"]), config.ordering, config.version)


def run_records(records: DataFrame, config: Config, own: str = "textpipe", most_bytes: int = 2 << 30, continuous: bool = True) -> DataFrame:
    """``generation, kind, out, status`` of each record.

    ``status`` is ``self_write``, ``do_not_process``, ``empty``, ``too_large``, ``unchanged`` or ``transformed``;
    a continuous run refuses reductions.
    """
    rows = best_representation(records)
    skip = F.when(F.col("origin") == own, "self_write").when(F.arrays_overlap(F.coalesce("markers", F.array().cast("array<string>")), F.array(*map(F.lit, DO_NOT_PROCESS))), "do_not_process")
    rows = rows.withColumn("skip", skip).withColumn("text", F.when(F.col("skip").isNull(), F.col("text")))
    # Two branches without a shuffle: each kind has its own program, which sees null for the other.
    rows = rows.withColumn("as_html", F.when(F.col("kind") == "html", F.col("text"))).withColumn("as_text", F.when(F.col("kind") != "html", F.col("text")))
    rows = guarded(rows, effective(config, "html"), "as_html", "out_html", most_bytes, continuous).withColumnRenamed("status", "status_html")
    rows = guarded(rows, config, "as_text", "out_text", most_bytes, continuous).withColumnRenamed("status", "status_text")
    # A rich source is written even if its text comes out the same; a plain one only if it changed.
    status = F.when(F.col("kind") == "html", F.when(F.col("status_html") == "unchanged", "transformed").otherwise(F.col("status_html"))).when(F.col("kind") == "rtf", F.when(F.col("status_text") == "unchanged", "transformed").otherwise(F.col("status_text"))).otherwise(F.coalesce("status_text", F.lit("empty")))
    return rows.select("generation", "kind", F.coalesce("out_html", "out_text").alias("out"), F.coalesce("skip", status).alias("status"))


def run_once(records: DataFrame, config: Config) -> DataFrame:
    """A single command: HTML to Markdown applies to html sources only, elsewhere its status is ``not_applicable``."""
    only_html = any(o.name == "html_to_markdown" for o in config.operations)
    rows = best_representation(records)
    applies = (F.col("kind") == "html") if only_html else F.lit(True)
    done = guarded(rows.withColumn("text", F.when(applies, F.col("text"))), config, "text", "out")
    return done.select("generation", "kind", "out", F.when(~F.coalesce(applies, F.lit(False)), "not_applicable").otherwise(F.col("status")).alias("status"))


def latest(records: DataFrame) -> DataFrame:
    """The record of the highest generation: what is left of several that came while one was in work."""
    return records.groupBy().agg(F.max_by(F.struct(*records.columns), "generation").alias("r")).where("r IS NOT NULL").select("r.*")


def _generations(spark: SparkSession, mark: str) -> list[tuple[int, int]]:
    """Epochs done so far and the last generation of each: one row an epoch."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return []
    rows = spark.read.schema("epoch long, generation long").parquet(f"{mark}/*")
    return [tuple(r) for r in rows.groupBy().agg(F.max_by(F.struct("epoch", "generation"), "epoch").alias("r")).where("r IS NOT NULL").select("r.*").collect()]


def start(records: DataFrame, config: Config, sink, checkpoint: str, trigger: dict | None = None, latest_only: bool = True, baseline: bool = False) -> StreamingQuery:
    """Run a stream; ``sink(batch, epoch)`` gets the transformed records that are to be written.

    Of several records that came while one was in work only the latest is done, and one that is not newer than the
    last is stale and dropped (the last generation is kept beside the checkpoint).  With ``baseline`` what is there
    when the stream first starts is not transformed, only newer generations are.  Without ``latest_only`` every
    record is done as it comes.
    """
    plan(config, continuous=True)
    mark = f"{checkpoint}/generation"

    def each(batch: DataFrame, epoch: int) -> None:
        if not latest_only:
            sink(run_records(batch, config).where("status = 'transformed'"), epoch)
            return
        spark = batch.sparkSession
        newest = latest(batch)
        row = newest.select("generation").first()
        if row is None:
            return
        done = _generations(spark, mark)
        last = max((g for e, g in done if e < epoch), default=None)
        if last is None and baseline or last is not None and row.generation <= last:
            newest = newest.limit(0)
        sink(run_records(newest, config).where("status = 'transformed'"), epoch)
        seen = row.generation if last is None else max(last, row.generation)
        spark.createDataFrame([(epoch, seen)], "epoch long, generation long").coalesce(1).write.mode("overwrite").parquet(f"{mark}/epoch={epoch}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": POLL})).start()
