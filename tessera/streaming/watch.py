"""The build as a stream: a file source, and the batch build for each micro-batch.

The batch build compares with the whole listing, so a micro-batch only says that something came; the
store's manifest, not the stream's checkpoint, decides what is done.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.config import Config
from tessera.models import Embedder
from tessera.plans.build import build


def watch(spark: SparkSession, folder: str, root: str, checkpoint: str, embedder: Embedder, config: Config | None = None, pattern: str = "*", once: bool = False) -> StreamingQuery:
    """Start to rebuild the store at root whenever files come to folder; once: for those that are there, then stop."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def step(batch, number: int) -> None:
        if not batch.isEmpty():
            build(spark, folder, root, embedder, config, pattern)

    out = files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
