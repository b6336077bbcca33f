"""Identifiers: hex digests of UTF-8 text, and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_id(uri: Column) -> Column:
    return F.sha2(uri, 256)


def content_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def chunk_id(doc: Column, start: Column, end: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc, start.cast("string"), end.cast("string"), content), 256)


def section_path(ix: Column) -> Column:
    return F.concat(F.lit("/p="), ix.cast("string"))


def shard(doc: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(shards)).cast("long")


def relative_uri(uri: Column, root: str) -> Column:
    """uri below root; ids made of it survive a move of the root."""
    prefix = F.lit(root if root.endswith("/") else root + "/")
    return F.when(uri.startswith(prefix), F.substring(uri, F.length(prefix) + 1, F.length(uri))).otherwise(uri)
