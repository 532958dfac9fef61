"""Scanning a stream of files or rows: stateless per row, so findings go out batch by batch, and a restart repeats no batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltscan.operators.scan import findings


def read_folder(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """New files of a folder, as (path, content)."""
    return (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder).select("path", "content")
    )


def scan_stream(files: DataFrame, target: str, checkpoint: str, text: str = "content", **options) -> StreamingQuery:
    """Append findings as Parquet. Whatever stands when a run is interrupted is whole batches."""
    found = findings(files, "path", text, **options)
    return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: findings or events by window and kind, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"))
