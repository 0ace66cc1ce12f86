"""Files as a stream: each micro-batch goes through the batch operators. An extension of the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BINARY = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def file_stream(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files below path, with their hash."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path).withColumn("sha256", F.sha2("content", 256))


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG", per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def convert_stream(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on each micro-batch and writes it below its batch id: a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
