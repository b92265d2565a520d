"""Continuous ingestion of new files, and the event view of parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..options import ParseOptions
from ..sources.pdf import parse_files

PROGRESS_EVERY = 16


def file_stream(spark: SparkSession, path: str, glob: str = "*.pdf", files_a_trigger: int = 64) -> DataFrame:
    """New files below a path as a stream of (doc_id, content); a trigger takes a bounded number of them."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_trigger).load(path)
    return found.select(F.col("path").alias("doc_id"), "content")


def parse_stream(files: DataFrame, options: ParseOptions | None = None) -> DataFrame:
    """The tagged rows of parse_files over a stream; the stage keeps no state, so restarts are exact."""
    return parse_files(files, options)


def write_stream(parsed: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends parsed rows to a Parquet folder, each file once; returns the running query."""
    return parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def until(events: DataFrame, stop: Column) -> DataFrame:
    """The events of each document up to the first for which `stop` holds: what a reader that stops there sees."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.coalesce(stop, F.lit(False))).over(before), F.lit(False))
    return events.withColumn("over", over).where("not over").drop("over")


def page_events(parsed: DataFrame, every: int = PROGRESS_EVERY) -> DataFrame:
    """(doc_id, seq, event, page, done, total): document_start, page_parsed or page_failed in page order, progress every
    so many pages and at the last one, document_end."""
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("page")
    total = F.max("document.page_count").over(whole)
    rows = parsed.withColumn("total", F.coalesce(total, F.lit(0)))
    pages = rows.where("page > 0").withColumn("done", F.row_number().over(order)).withColumn("of", F.count("*").over(whole))
    event = lambda rank, name: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("event"))
    said = F.when(F.col("kind") == "page", event(1, "page_parsed")).otherwise(event(1, "page_failed"))
    tick = (F.col("done") % every == 0) | (F.col("done") == F.col("of"))
    pages = pages.select("doc_id", "page", "done", "total", F.explode(F.when(tick, F.array(said, event(2, "progress"))).otherwise(F.array(said))).alias("e"))
    ends = rows.where("kind = 'document'").select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("page"), F.lit(0).alias("rank"), F.lit("document_start").alias("event")), F.struct(F.lit(2**31 - 1).alias("page"), F.lit(9).alias("rank"), F.lit("document_end").alias("event")))).alias("e"), "total")
    out = pages.select("doc_id", F.col("page").alias("at"), "e.rank", "e.event", "done", "total").unionByName(ends.select("doc_id", F.col("e.page").alias("at"), "e.rank", "e.event", F.lit(None).cast("int").alias("done"), "total"))
    seq = F.row_number().over(whole.orderBy("at", "rank")) - 1
    return out.select("doc_id", seq.cast("int").alias("seq"), "event", F.when(F.col("rank").isin(1, 2), F.col("at")).alias("page"), "done", "total")
