"""Schemas of the stored tables; reads name them, so that partition columns keep their types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "uri string, length long, mtime long, sha256 string, docId string, contentHash string"
DOCS = "docId string, uri string, title string, language string, contentHash string, text string, runId string, shard long"
CHUNKS = "docId string, contentHash string, uri string, title string, language string, chunkIx int, start int, end int, chunkText string, sectionPath string, chunkId string, runId string, shard long"
EMBEDDINGS = "docId string, contentHash string, chunkId string, chunkIx int, embedding array<float>, embDim int, runId string, embedder string, embVersion string, shard long"
INDEX = "docId string, contentHash string, uri string, title string, language string, chunkId string, chunkIx int, sectionPath string, chunkText string, embedding array<float>, embDim int, embedder string, embVersion string, shard long"
METRICS = "runAt string, runAtMs long, numDocsScanned long, numChangedDocs long, numSkippedDocs long, numChunksWritten long, numEmbeddingsWritten long, indexRows long, durationMs long"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, and the optimizer knows it: joins with them move nothing."""
    return spark.createDataFrame([], schema).where("false")
