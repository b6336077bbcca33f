"""Vocabulary: global term counts and dense ids."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(T.words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("total_tf"))


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """term, token_id, total_tf: ids from 0 by falling count, then by term.

    Ids are positions in a total order; terms are dealt by range, numbered within their partition, and
    the partitions' sizes (one row each) give the offsets, so that no task holds them all.
    """
    t = term_counts(docs, text).repartitionByRange(F.desc("total_tf"), F.asc("term"))
    # Written, as the ranges may differ when they are worked out a second time.
    t = _checkpointed(t.select("term", "total_tf", F.spark_partition_id().alias("part")))
    sizes = t.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("total_tf"), "term"))
    return t.withColumn("_own", own).join(offsets, "part").select("term", (F.col("offset") + F.col("_own") - 1).alias("token_id"), "total_tf")


def _checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir; with a local master, where none is set, on this machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()
