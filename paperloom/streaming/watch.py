"""Converting files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.config import Config
from paperloom.plans.pipeline import convert_files
from paperloom.session import scratch
from paperloom.sources.scan import file_type

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, config: Config = Config(), once: bool = False):
    """Start a stream that converts each new file and appends the results to a Parquet table.

    Every batch is written under its number, so a batch that is run again
    after a failure replaces what it had written.
    """
    files = spark.readStream.format("binaryFile").schema(_BINARY).load(folder)
    rows = files.select(F.col("path").alias("doc_id"), file_type(F.col("path")).alias("file_type"), "content").where(F.col("file_type").isin("docx", "pptx", "pdf", "image"))

    def convert(batch: DataFrame, number: int) -> None:
        with scratch():
            convert_files(batch, config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    w = rows.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
