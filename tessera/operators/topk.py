"""Top-K by score, with defined ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k best rows: score descending (NaN last), then ties ascending. Plans as TakeOrderedAndProject."""
    return scored.orderBy(F.isnan(score), F.desc(score), *ties).limit(k)


def top_k_per(scored: DataFrame, k: int, group: str | Column, score: str, *ties: str) -> DataFrame:
    """The k best rows of each group, with their rank (from 1); ranks are cut before the shuffle too."""
    w = Window.partitionBy(group).orderBy(F.isnan(score), F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_top_k(partial: DataFrame, k: int, score: str, doc: str, chunk: str) -> DataFrame:
    """Merge shards' best: on a boundary tie the larger (doc, chunk) stays; ranks go by ascending ids."""
    kept = partial.orderBy(F.desc(score), F.desc(doc), F.desc(chunk)).limit(k)
    w = Window.orderBy(F.desc(score), doc, chunk)
    return kept.withColumn("rank", F.row_number().over(w))
