"""Replays as a stream: each new file is read once, whole, in the micro-batch that finds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.replay_files import messages_of

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_messages(spark: SparkSession, path: str, types: list[int] | None = None, files_a_batch: int = 16) -> DataFrame:
    """The messages of files as they arrive in a folder.  A file is closed when it arrives, so there is nothing late and no state."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_a_batch).load(path)
    return messages_of(files.select(F.col("path").alias("demo_id"), "content"), types, permissive=True)


def append_messages(messages: DataFrame, to: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of messages to a table partitioned by type; restarts go on from ``checkpoint``."""
    out = messages.writeStream.format("parquet").partitionBy("msg_type").option("path", to).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
