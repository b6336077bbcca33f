"""The corpus pipeline: documents that are good, different, unleaked, mixed and encoded.

Each stage takes the documents that its predecessor kept and is written before the next one starts,
so that a lost executor costs a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_dir, table, written
from tessera.llm.decontam import drop_contaminated
from tessera.llm.mixing import mixed
from tessera.llm.quality import keep_good, train
from tessera.llm.simgroups import keep_one
from tessera.llm.tokenstore import read_back, write_store

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects go (label 1 less likely than not)."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, similarity=0.8, shingle_words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in the content-addressed store; per document: start, n_tokens, ids_crc32, read back from it."""
    return read_back(write_store(docs, TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
#: SQL expresses neither the model nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}-{name}", shared_dir(spark, f"pipeline-{i}"))
    return docs
