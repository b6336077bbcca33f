"""Questions over a published index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import context, schemas
from tessera.config import Config
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.models import ChatModel, Embedder
from tessera.operators.topk import top_k
from tessera.sources.store import Store


def load_index(spark: SparkSession, table: str | None = None, path: str | None = None, root: str | None = None, config: Config | None = None) -> DataFrame:
    """The index: a catalog table, else a Parquet path, else the configured path if it is there, else the current snapshot of a store, else a path below root."""
    if table:
        return spark.table(table)
    if path:
        return spark.read.schema(schemas.INDEX).parquet(path)
    if config and config.index_path and Store(spark, config.index_path).exists("."):
        return spark.read.schema(schemas.INDEX).parquet(config.index_path)
    if root:
        store = Store(spark, root)
        if store.current("retrieval_index"):
            return store.snapshot("retrieval_index", schemas.INDEX)
        for place in ("retrieval_index", "index", "."):
            if store.exists(place):
                return spark.read.schema(schemas.INDEX).parquet(store.path(place))
    raise FileNotFoundError("no index: give a table, a path or a store with a published index")


def search(index: DataFrame, vector: list[float], k: int, embedder: Embedder | None = None, scaled: bool = False) -> DataFrame:
    """The k chunks of greatest cosine, ties by docId and chunkIx; an embedder's own vectors only.

    scaled: scores as (1 + cosine) / 2, between 0 and 1; the order is the same.
    """
    if embedder:
        index = index.where((F.col("embedder") == embedder.name) & (F.col("embVersion") == embedder.version))
    q = F.array(*(F.lit(float(x)) for x in vector))
    best = top_k(index.withColumn("score", V.cosine(F.col("embedding"), q)).drop("embedding"), k, "score", "docId", "chunkIx")
    return best.withColumn("score", V.scaled(F.col("score"))) if scaled else best


def context_of(hits: DataFrame, config: Config | None = None) -> DataFrame:
    """One row: the hits as blocks, best first."""
    c = config or Config()
    w = Window.orderBy(F.desc("score"), "docId", "chunkIx")
    h = hits.withColumn("pos", F.row_number().over(w) - 1)
    block = context.block(F.col("pos"), F.col("title"), F.col("sectionPath"), F.col("docId"), F.col("score"), T.snippet(F.col("chunkText"), c.snippet_chars))
    return context.joined(h.select("pos", block.alias("block")), [], ["pos"], "block")


def answer(spark: SparkSession, index: DataFrame, question: str, embedder: Embedder, chat: ChatModel, config: Config | None = None) -> dict:
    """Retrieve, build the prompt, ask: {answer, context}."""
    c = config or Config()
    normal = spark.range(1).select(T.normalize(F.lit(question)).alias("q")).first().q
    if not normal:
        raise ValueError("the question is empty")
    hits = search(index, embedder.embed([normal])[0], c.top_k, embedder)
    found = context_of(hits, c).first().context
    return {"answer": chat.chat(context.messages(question, found, c)), "context": found}
