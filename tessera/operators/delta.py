"""Change detection between listings, as joins on keys. Nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed(current: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of current that are new by key, or differ from previous in one of columns (null-safe)."""
    prev = previous.select(F.col(key), F.lit(True).alias("_known"), *(F.col(c).alias(f"_{c}") for c in columns))
    differs = reduce(lambda a, b: a | b, [~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in columns])
    return current.join(prev, key, "left").where(F.col("_known").isNull() | differs).select(*current.columns)


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted without their keys in present. Which side is broadcast is left to the optimizer."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def latest(versions: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The newest row for each key; of equally new ones that with the greater tie."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def next_manifest(listing: DataFrame, previous: DataFrame, hashes: DataFrame) -> DataFrame:
    """uri, length, mtime, sha256: what is listed now, with the new hash, else the known one, else ''."""
    p = previous.select("uri", F.col("sha256").alias("_old"))
    h = hashes.select("uri", F.col("sha256").alias("_new"))
    return listing.join(p, "uri", "left").join(h, "uri", "left").select("uri", "length", "mtime", F.coalesce("_new", "_old", F.lit("")).alias("sha256"))


def index_rows(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, doc_keys: tuple[str, str], chunk_key: str) -> DataFrame:
    """The documents' current versions with their chunks and one vector for each chunk."""
    one = vectors.dropDuplicates([chunk_key])
    return docs.join(chunks, list(doc_keys)).join(one, chunk_key)
