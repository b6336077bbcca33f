"""Flat outputs besides the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Quoted CSV, in as many files as df has partitions; quotes within fields are doubled."""
    df.write.mode("overwrite").option("header", header).option("quoteAll", True).option("escape", '"').csv(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """term, token_id, total_tf in the order of ids, without a header."""
    write_csv(vocabulary.select("term", "token_id", "total_tf").orderBy("token_id"), path, header=False)


def write_documents(chunks: DataFrame, path: str) -> None:
    """doc_id, chunk_id, text of chunks."""
    write_csv(chunks.select(F.col("docId").alias("doc_id"), F.col("chunkId").alias("chunk_id"), F.col("chunkText").alias("text")), path)


def similarities(pairs: DataFrame, vectors: DataFrame, word: str = "word", vector: str = "embedding") -> DataFrame:
    """(a, b) -> a, b, dot, cosine, norm_a, norm_b; words without a vector have null vectors."""
    x, y = F.col("_x"), F.col("_y")
    va, vb = (vectors.select(F.col(word).alias(k), F.col(vector).alias(v)) for k, v in (("a", "_x"), ("b", "_y")))
    return pairs.join(va, "a", "left").join(vb, "b", "left").select("a", "b", V.dot(x, y).alias("dot"), V.cosine(x, y).alias("cosine"), V.norm(x).alias("norm_a"), V.norm(y).alias("norm_b"))
