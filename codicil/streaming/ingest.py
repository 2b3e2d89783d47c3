"""Continuous ingest: a stream of page files becomes chunks that are replaced per document.

The source is any streaming DataFrame of pages. Each micro-batch holds whole documents; its chunks are
written under the batch's id, so that a batch that is run again after a failure overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codicil.operators.chunking import chunk
from codicil.sources.catalog import latest

PAGES = "document_id string, page_number int, text string, filename string, category string"


def page_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of pages; a file holds all pages of its documents."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(pages: DataFrame, target: str, checkpoint: str, *, method: str = "recursive", **options) -> StreamingQuery:
    """Chunks what there is and ends (availableNow); run it again for what has come since."""

    def put(batch: DataFrame, batch_id: int) -> None:
        chunk(batch, method, **options).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/b={batch_id}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's latest batch: those of an earlier version are out of sight."""
    rows = spark.read.parquet(target).drop("b")
    newest = latest(rows.select("document_id", "batch").distinct(), "document_id", "batch")
    return rows.join(newest, ["document_id", "batch"], "left_semi").drop("batch")


def first_sight(stream: DataFrame, *, event_time: str, delay: str = "1 day") -> DataFrame:
    """Documents as they come for the first time; state older than the delay is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["document_id"])
