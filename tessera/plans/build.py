"""The incremental build: sources -> documents -> chunks -> vectors -> a published index.

A run moves the stored tables towards a desired state and does only what is missing: a version of a
document is stored once, chunks once for each version, vectors once for each (embedder, version,
chunk). So a crashed run is taken up by the next one, a new embedder version embeds everything again, a
reverted document goes back to what is stored of it, and deleted ones leave the index.
"""

from __future__ import annotations

import re
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.functions import ids
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.models import Embedder, embed_column
from tessera.operators.chunk import sentence_chunks
from tessera.operators.delta import changed, missing
from tessera.sources.files import extract_text, list_files, read_files
from tessera.sources.store import Store

#: Changed files that a run reads by name; their names come to the driver.
LISTED_PATHS = 10_000


def documents(texts: DataFrame, run_id: str, shards: int) -> DataFrame:
    """(uri, text) -> the DOCS columns and `norm`; texts that are null or empty after normalisation are left out."""
    d = texts.withColumn("norm", T.normalize(F.col("text"))).where(F.length("norm") > 0)
    d = d.withColumn("docId", ids.doc_id(F.col("uri")))
    return d.select(
        "docId", "uri", T.title(F.col("text"), F.col("uri")).alias("title"), T.language(F.col("norm")).alias("language"), ids.content_hash(F.col("norm")).alias("contentHash"),
        F.col("norm").alias("text"), F.lit(run_id).alias("runId"), ids.shard(F.col("docId"), shards).alias("shard"),
    )


def chunks_of(docs: DataFrame, run_id: str, config: Config) -> DataFrame:
    keys = ["docId", "contentHash", "uri", "title", "language", "shard"]
    c = sentence_chunks(docs, keys, "text", config)
    cid = ids.chunk_id(F.col("docId"), F.col("start"), F.col("end"), F.col("contentHash"))
    return c.select("docId", "contentHash", "uri", "title", "language", F.col("ix").alias("chunkIx"), "start", "end", F.col("chunk_text").alias("chunkText"), ids.section_path(F.col("ix")).alias("sectionPath"), cid.alias("chunkId"), F.lit(run_id).alias("runId"), "shard")


def suspects(spark: SparkSession, root: str, suspect: DataFrame, pattern: str) -> DataFrame:
    """uri, length, mtime, content of the suspect files: up to LISTED_PATHS are read by name, and nothing else is.

    Where more are suspect, as in a first run, the folder is read and the others are left out.
    """
    paths = [r.uri for r in suspect.select("uri").distinct().limit(LISTED_PATHS + 1).collect()]
    if not paths:
        return read_files(spark, root, pattern).limit(0)
    if len(paths) > LISTED_PATHS:
        return read_files(spark, root, pattern).join(suspect.select("uri"), "uri", "left_semi")
    return read_files(spark, [re.sub(r"([][{}*?\\])", r"\\\1", p) for p in paths])


def matching(files: DataFrame, uris: DataFrame) -> DataFrame:
    """Files whose uri is among uris. Contents are moved only where more than LISTED_PATHS are."""
    few = uris.select("uri").distinct().limit(LISTED_PATHS + 1).persist()
    n = few.count()
    if n > LISTED_PATHS:
        few.unpersist()
        return files.join(uris.select("uri"), "uri", "left_semi")
    names = files.sparkSession.createDataFrame(few.collect(), "uri string") if n else None
    few.unpersist()
    return files.join(F.broadcast(names), "uri", "left_semi") if n else files.where("false")


def picked(rows: DataFrame, wanted: DataFrame, keys: list[str], one: str | None = None) -> DataFrame:
    """Rows whose keys are wanted, one for each keys (and `one`). Whole rows are moved only where some are to be left out
    and more than LISTED_PATHS keys are wanted; which is so is found by the keys alone."""
    by = [*keys, one] if one else keys
    asked = wanted.select(*keys).distinct()
    have = rows.select(*by).join(asked.withColumn("_wanted", F.lit(1)), keys, "left").groupBy(*by).agg(F.count("*").alias("n"), F.max("_wanted").alias("w"))
    r = have.agg(F.count("w").alias("wanted"), F.count("*").alias("all"), F.max("n").alias("most"), F.max(F.when(F.col("w") == 1, F.col("n"))).alias("copies")).first()
    if not r.wanted:
        return rows.where("false")
    if r.wanted == r["all"] and r.most == 1:
        return rows
    kept = rows if r.wanted == r["all"] else rows.join(F.broadcast(asked) if r.wanted <= LISTED_PATHS else asked, keys, "left_semi")
    return kept.dropDuplicates(by) if r.copies > 1 else kept


def published(snapshot: DataFrame, chunks: DataFrame, vectors: DataFrame, mine) -> bool:
    """Whether the snapshot holds just these chunks with these vectors; compared by ids, of which a chunk's and a vector's are of one content."""
    now = chunks.select("chunkId").join(vectors.select("chunkId"), "chunkId").withColumn("_now", F.lit(1))
    there = snapshot.select("chunkId", F.when(mine, 1).alias("_there"))
    return now.join(there, "chunkId", "full_outer").where("_now IS NULL OR _there IS NULL").isEmpty()


def build(spark: SparkSession, sources: DataFrame | str, root: str, embedder: Embedder, config: Config | None = None, pattern: str = "*", content: DataFrame | None = None) -> dict:
    """Bring the store at root up to date with the sources; returns the run's metrics.

    sources: a folder, or a frame with uri, length, mtime and content (binary). Nothing is collected but counts.
    """
    c = config or Config()
    began, run_id, now = time.time(), uuid.uuid4().hex, datetime.now(UTC)
    s = Store(spark, root, c.rows_per_file)
    listing = list_files(spark, sources, pattern) if isinstance(sources, str) else sources.select("uri", "length", "mtime")
    first = not s.exists("manifest")  # then all is new, and nothing is compared
    known = s.read("manifest", schemas.MANIFEST)
    known = known if first else known.persist()
    # 1. Files that look new; of these, those whose bytes are new; their text.
    suspect = changed(listing, known, "uri", ["length", "mtime"])
    files = suspects(spark, sources, suspect, pattern) if isinstance(sources, str) else sources if first else matching(sources, suspect)
    hashes = files.select("uri", F.sha2("content", 256).alias("sha256")).persist()
    fresh = changed(hashes, known, "uri", ["sha256"]).select("uri")
    docs = documents(extract_text(files if first else matching(files, fresh)), run_id, c.shards).persist()
    # 2. The manifest to be: what is listed, and which version of which document each file is now.
    versions = docs.select("uri", F.col("docId").alias("_doc"), F.col("contentHash").alias("_hash"))
    old = known.select("uri", F.col("sha256").alias("_old"), F.col("docId").alias("_odoc"), F.col("contentHash").alias("_ohash"))
    touched = fresh.distinct().withColumn("_new", F.lit(True))
    m = listing.join(old, "uri", "left").join(hashes.withColumnRenamed("sha256", "_sha"), "uri", "left").join(versions, "uri", "left").join(touched, "uri", "left")
    pick = lambda new, was: F.when(F.col("_new"), F.col(new)).otherwise(F.col(was))
    manifest = m.select("uri", "length", "mtime", F.coalesce("_sha", "_old", F.lit("")).alias("sha256"), pick("_doc", "_odoc").alias("docId"), pick("_hash", "_ohash").alias("contentHash")).persist()
    # 3. Versions, chunks and vectors that are missing.
    stored = s.read("doc_normalized", schemas.DOCS)
    s.append(missing(docs, stored, ["docId", "contentHash"]), "doc_normalized", ["shard"], once="contentHash")
    current = manifest.where("docId IS NOT NULL").select("docId", "contentHash").distinct()
    uncut = missing(current, s.read("chunks", schemas.CHUNKS), ["docId", "contentHash"])
    s.append(chunks_of(picked(s.read("doc_normalized", schemas.DOCS), uncut, ["docId", "contentHash"]), run_id, c), "chunks", ["shard"])
    chunks = picked(s.read("chunks", schemas.CHUNKS), current, ["docId", "contentHash"], "chunkId")
    mine = (F.col("embedder") == embedder.name) & (F.col("embVersion") == embedder.version)
    have = s.read("embeddings", schemas.EMBEDDINGS).where(mine)
    todo = picked(chunks, missing(chunks.select("chunkId"), have, ["chunkId"]), ["chunkId"]) if s.exists("embeddings") else chunks
    todo = todo.select("docId", "contentHash", "chunkId", "chunkIx", "shard", "chunkText")
    v = embed_column(todo, "chunkText", embedder, c.embed_batch).where(V.is_valid(F.col("embedding")))
    v = v.select("docId", "contentHash", "chunkId", "chunkIx", "embedding", F.size("embedding").alias("embDim"), F.lit(run_id).alias("runId"), F.lit(embedder.name).alias("embedder"), F.lit(embedder.version).alias("embVersion"), "shard")
    s.append(v, "embeddings", ["embedder", "embVersion", "shard"])
    # 4. Publish what is current, then the manifest: a run that dies before is simply done again.
    vectors = s.read("embeddings", schemas.EMBEDDINGS).where(mine).dropDuplicates(["chunkId"]).select("chunkId", "embedding", "embDim", "embedder", "embVersion")
    if not s.current("retrieval_index") or not published(s.snapshot("retrieval_index", schemas.INDEX), chunks, vectors, mine):
        index = chunks.join(vectors, "chunkId").select(*(f.split()[0] for f in schemas.INDEX.split(", ")))
        s.publish(index, "retrieval_index", ["shard"], int(began * 1000))
        s.vacuum("retrieval_index")
    changed_docs = docs.count()
    # skipped: changed files without text or that could not be read
    counts = {"numDocsScanned": manifest.count(), "numChangedDocs": changed_docs, "numSkippedDocs": fresh.count() - changed_docs}
    s.replace(manifest, "manifest")
    written = lambda name, schema: s.read(name, schema).where(F.col("runId") == run_id).count()
    row = {"runAt": now.isoformat(), "runAtMs": int(began * 1000)} | counts | {
        "numChunksWritten": written("chunks", schemas.CHUNKS), "numEmbeddingsWritten": written("embeddings", schemas.EMBEDDINGS),
        "indexRows": s.snapshot("retrieval_index", schemas.INDEX).count(), "durationMs": int((time.time() - began) * 1000),
    }
    s.record_metrics(row)
    for x in (known, docs, hashes, manifest):
        x.unpersist()
    return row
