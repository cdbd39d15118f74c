"""Document files as a stream: new files of a folder are decoded as they come.

The reference semantics have no streams; this is the batch reader of sources.strict behind Spark's file
stream, for folders that grow. Each micro-batch appends its tables, and its errors, as Parquet; a batch
that runs again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import settle
from ..sources.strict import decode_files, tables_of

FILES = "path string, modificationTime timestamp, length long, content binary"
NAMES = ("documents", "schemas", "schema_fields", "entities", "cells")


def read_stream(spark: SparkSession, path: str, pattern: str = "*.ro") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(path)


def ingest(spark: SparkSession, path: str, output: str, checkpoint: str, pattern: str = "*.ro", once: bool = True) -> StreamingQuery:
    """Start decoding the files of `path` to tables under `output`; once: stop when no file is left."""

    def write(batch: DataFrame, number: int) -> None:
        decoded = settle(decode_files(batch.select("path", "content")))
        for name, table in zip(NAMES, tables_of(decoded).tables(), strict=True):
            table.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")
        decoded.where("error is not null").select("doc", "error", "message").write.mode("overwrite").parquet(f"{output}/errors/batch={number}")

    writer = read_stream(spark, path, pattern).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
