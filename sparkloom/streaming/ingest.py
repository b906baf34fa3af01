"""Continuous ingestion: files that arrive in a folder go through the same diff as an update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index
from ..sources import files
from ..sources.kinds import kind, language


def upsert(index: Index, arrived: DataFrame) -> None:
    """Take in rows of the binary file source; nothing is removed."""
    arrived = arrived.withColumn("path", F.regexp_replace("path", "^file:(//)?", "")).where(kind(F.col("path")) != "unknown")
    walked = arrived.select("path", kind(F.col("path")).alias("kind"), language(F.col("path")).alias("language"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    diff = index.diff(walked, "/", only_walked=True)
    wanted = diff.where("status in ('new', 'changed')").select("path")
    index.apply(walked, diff, files.parse_contents(arrived.join(wanted, "path", "left_semi")))


def start(index: Index, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Watch a folder. Each micro-batch writes what came; a replayed batch finds its files unchanged and adds nothing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = index.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    writer = arrived.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert(index, batch))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
