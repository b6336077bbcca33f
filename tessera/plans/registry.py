"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import context as C
from tessera.functions import ids
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunk, delta, knn, rerank, topk, vocab
from tessera.plans.sql import SQL as _SQL
from tessera.sources.store import newest

QUERIES = {}
SQL = _SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text", "lang", "source", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"))


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("norm", T.normalize(F.col("text")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query
def normalize_hash(spark, d):
    return _norm(spark, d).select("doc_id", F.length("norm").alias("norm_chars"), ids.content_hash(F.col("norm")).alias("content_hash"), ids.doc_id(F.col("uri")).alias("doc_key"))


@query
def text_quality(spark, d):
    n = F.col("norm")
    return _norm(spark, d).select("doc_id", V.rounded(T.alpha_ratio(n), 6).alias("alpha"), V.rounded(T.symbol_share(n), 6).alias("symbols"), T.is_junk(n).alias("junk"))


@query
def junk_archived(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", T.is_junk_strict(F.col("line")).alias("junk"))


@query
def lang_detect(spark, d):
    return _norm(spark, d).select("doc_id", T.language(F.col("norm")).alias("language"))


@query
def doc_title(spark, d):
    return _docs(spark, d).select("doc_id", T.title(F.col("text"), F.col("uri")).alias("title"))


@query
def shard_assign(spark, d):
    return _docs(spark, d).select("doc_id", ids.shard(ids.doc_id(F.col("uri")), 64).alias("shard"))


@query
def relative_uri(spark, d):
    return _t(spark, d, "pages").select("page_id", ids.relative_uri(F.col("url"), "https://").alias("rel"))


@query
def chunk_count(spark, d):
    return _norm(spark, d).select("doc_id", T.chunk_count(F.length("norm"), 900, 108).alias("n_chunks"))


def _fixed(spark, d):
    # Documents are hashed before they are cut, once each.
    k = _norm(spark, d).select("doc_id", "norm", ids.doc_id(F.col("uri")).alias("docId"), ids.content_hash(F.col("norm")).alias("contentHash"))
    c = k.select("doc_id", "docId", "contentHash", F.explode(chunk.fixed_windows(F.col("norm"), 900, 108)).alias("p"))
    key = ids.chunk_id(F.col("docId"), F.col("p.start"), F.col("p.end"), F.col("contentHash"))
    return c.select("doc_id", "contentHash", F.col("p.ix").cast("long").alias("ix"), F.col("p.start").cast("long").alias("chunk_start"), F.col("p.end").cast("long").alias("chunk_end"), key.alias("chunk_id"), ids.section_path(F.col("p.ix")).alias("section"))


@query
def chunk_fixed(spark, d):
    return _fixed(spark, d).drop("contentHash")


@query
def chunk_sentence(spark, d):
    c = chunk.sentence_chunks(_norm(spark, d), ["doc_id"])
    return c.select("doc_id", F.col("ix").cast("long").alias("ix"), F.col("start").cast("long").alias("chunk_start"), F.col("end").cast("long").alias("chunk_end"), F.sha2("chunk_text", 256).alias("sha"))


@query
def chunk_compat(spark, d):
    return chunk.sentence_chunks(_norm(spark, d), ["doc_id"], compat=True).select("doc_id", "ix", "start", "end", F.sha2("chunk_text", 256).alias("sha"))


@query
def vocabulary(spark, d):
    return vocab.vocabulary(_docs(spark, d), "text").select("term", F.col("token_id").cast("long").alias("token_id"), "total_tf")


@query
def distinct_terms(spark, d):
    return vocab.term_counts(_docs(spark, d), "text").agg(F.count("*").alias("n_terms"), F.sum("total_tf").alias("n_words"))


# Change detection. The listing before: one source wasn't there, one language was longer, one was touched only.
def _listing(spark, d):
    return _docs(spark, d).select("uri", F.length("text").cast("long").alias("length"), F.lit(0).cast("long").alias("mtime"), F.sha2("text", 256).alias("sha256"))


def _listing_before(spark, d):
    de, fr = F.col("lang") == "de", F.col("lang") == "fr"
    sha = F.when(de, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return _docs(spark, d).where("source <> 'src3'").select("uri", (F.length("text") + de.cast("int")).cast("long").alias("length"), fr.cast("long").alias("mtime"), sha.alias("sha256"))


@query
def list_sources(spark, d):
    from tessera.sources.files import list_files

    return list_files(spark, d, "*.[pP][aA][rR][qQ][uU][eE][tT]")


@query
def delta_candidates(spark, d):
    return delta.changed(_listing(spark, d).drop("sha256"), _listing_before(spark, d), "uri", ["length", "mtime"])


@query
def delta_changed(spark, d):
    suspect = delta.changed(_listing(spark, d), _listing_before(spark, d), "uri", ["length", "mtime"])
    return delta.changed(suspect, _listing_before(spark, d), "uri", ["sha256"]).select("uri", "sha256")


@query
def manifest_next(spark, d):
    suspect = delta.changed(_listing(spark, d), _listing_before(spark, d), "uri", ["length", "mtime"])
    return delta.next_manifest(_listing(spark, d).drop("sha256"), _listing_before(spark, d), suspect.select("uri", "sha256"))


def _keys(spark, d):
    return _norm(spark, d).select("doc_id", "lang", ids.doc_id(F.col("uri")).alias("docId"), ids.content_hash(F.col("norm")).alias("contentHash"))


@query
def anti_new_docs(spark, d):
    k = _keys(spark, d)
    return delta.missing(k, k.where("lang = 'en'"), ["docId", "contentHash"]).select("doc_id", "docId", "contentHash")


@query
def anti_missing_vectors(spark, d):
    have = _t(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"))
    return delta.missing(_fixed(spark, d).select("doc_id", "chunk_id"), have, ["doc_id"])


@query
def latest_version(spark, d):
    k = _norm(spark, d).select("doc_id", "lang", "norm")
    first = k.select("doc_id", F.sha2("norm", 256).alias("hash"), F.lit(1).alias("version"))
    second = k.where("lang = 'de'").select("doc_id", F.sha2(F.concat("norm", F.lit("2")), 256).alias("hash"), F.lit(2).alias("version"))
    tied = k.where("lang = 'fr'").select("doc_id", F.sha2(F.concat("norm", F.lit("3")), 256).alias("hash"), F.lit(1).alias("version"))
    return delta.latest(first.unionByName(second).unionByName(tied), "doc_id", "version", "hash").select("doc_id", "hash", "version")


@query
def index_join(spark, d):
    # Texts are normalised, hashed and cut once; what is joined are the ids and hashes written then.
    root = shared_root(spark, "index-join")
    _fixed(spark, d).select("doc_id", "contentHash", "ix", "chunk_id").write.parquet(root)
    chunks = spark.read.parquet(root)
    docs = chunks.select("doc_id", "contentHash").distinct()
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dim"))
    vectors = chunks.select("doc_id", "chunk_id").join(v, "doc_id").select("chunk_id", "dim")  # a document's vector for each of its chunks
    return delta.index_rows(docs, chunks, vectors, ("doc_id", "contentHash"), "chunk_id").select("doc_id", "contentHash", "ix", "chunk_id", "dim")


@query
def distinct_keys(spark, d):
    return _keys(spark, d).select("contentHash").distinct().agg(F.count("*").alias("n_versions"))


@query
def union_dedupe(spark, d):
    k = _keys(spark, d).select("docId", "contentHash")
    return k.unionByName(_keys(spark, d).where("lang = 'en'").select("docId", "contentHash")).dropDuplicates(["docId", "contentHash"])


@query
def metrics_window(spark, d):
    by_day = _t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"), V.rounded(F.sum("value"), 3).alias("total"))
    runs = by_day.select(F.col("day").cast("string").alias("runAt"), F.unix_millis(F.col("day").cast("timestamp")).alias("runAtMs"), "rows", "total")
    past, last = runs.where("runAtMs < 1e15"), runs.orderBy(F.desc("runAtMs")).limit(1)
    return newest(newest(past.join(last.select("runAt"), "runAt", "left_anti"), 1).unionByName(last), 2)


@query
def skip_reasons(spark, d):
    n = F.col("norm")
    why = F.when(F.length(n) == 0, "empty").when(F.length(n) < 80, "short").when(T.alpha_ratio(n) < 0.45, "not_text").when(T.symbol_share(n) > 0.55, "symbols").otherwise("kept")
    return _norm(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


# Vectors.
def _vectors(spark, d):
    return _t(spark, d, "embeddings")


def _one(spark, d, vec_id: int, name: str) -> DataFrame:
    return F.broadcast(_vectors(spark, d).where(F.col("vec_id") == vec_id).select(F.col("embedding").alias(name)))  # one row


@query
def l2_normalize(spark, d):
    v = _vectors(spark, d).select("vec_id", V.norm(F.col("embedding")).alias("n"), V.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return v.select("vec_id", V.rounded(F.col("n"), 5).alias("norm"), V.rounded(V.norm(F.col("u")), 5).alias("unit"), V.rounded(F.col("u")[0].cast("double"), 5).alias("first"))


def _scored(spark, d, score):
    return _vectors(spark, d).crossJoin(_one(spark, d, 0, "q")).select("vec_id", V.rounded(score(F.col("embedding"), F.col("q")), 6).alias("score"))


@query
def cosine_topk(spark, d):
    return topk.top_k(_scored(spark, d, V.cosine), 5, "score", "vec_id")


@query
def scaled_topk(spark, d):
    return topk.top_k(_scored(spark, d, lambda a, b: V.scaled(V.cosine(a, b))), 5, "score", "vec_id")


@query
def dot_topk(spark, d):
    return topk.top_k(_scored(spark, d, V.dot), 5, "score", "vec_id")


@query
def knn_all_pairs(spark, d):
    v = _vectors(spark, d)
    return knn.exact_knn(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", V.rounded(F.col("score"), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def topk_sharded(spark, d):
    s = _scored(spark, d, V.cosine).withColumn("shard", F.pmod("vec_id", F.lit(8))).withColumn("chunk", F.lit(0))
    best = topk.top_k_per(s, 5, "shard", "score", "vec_id").drop("rank")
    return topk.merge_top_k(best, 5, "score", "vec_id", "chunk").select("vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query
def topk_merge_ties(spark, d):
    e = _t(spark, d, "events").select(F.round("value").alias("score"), "user_id", "event_id")
    return topk.merge_top_k(e, 10, "score", "user_id", "event_id").select("score", "user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query
def analogy_topk(spark, d):
    q = _one(spark, d, 0, "a").crossJoin(_one(spark, d, 1, "b")).crossJoin(_one(spark, d, 2, "c"))
    s = _vectors(spark, d).where("vec_id NOT IN (0, 1, 2)").crossJoin(q)
    return topk.top_k(s.select("vec_id", V.rounded(V.cosine(F.col("embedding"), V.analogy(F.col("a"), F.col("b"), F.col("c"))), 6).alias("score")), 5, "score", "vec_id")


@query
def accuracy_at_k(spark, d):
    v = _vectors(spark, d)
    label = v.select("vec_id", "label")
    hits = knn.exact_knn(v, v.where("vec_id % 20 = 0"), 5).join(label, "vec_id").groupBy("query_id").agg(F.collect_set("label").alias("found"))
    judged = hits.join(label.withColumnRenamed("vec_id", "query_id"), "query_id").select(F.array_contains("found", F.col("label")).cast("int").alias("hit"))
    return judged.agg(F.count("*").alias("n"), V.rounded(F.avg("hit"), 6).alias("accuracy"))


@query
def vector_validity(spark, d):
    v = F.col("embedding")
    bent = F.when(F.col("label") == 1, F.lit(None).cast("array<float>")).when(F.col("label") == 2, F.array().cast("array<float>")).when(F.col("label") == 3, F.transform(v, lambda x: (x * float("nan")).cast("float"))).otherwise(v)
    return _vectors(spark, d).select("vec_id", V.is_valid(bent).alias("valid"))


@query
def pair_similarity(spark, d):
    v = _vectors(spark, d)
    a, b = v.select("vec_id", F.col("embedding").alias("x")), v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select("vec_id", V.rounded(V.dot(x, y), 6).alias("dot"), V.rounded(V.cosine(x, y), 6).alias("cosine"), V.rounded(V.norm(x), 5).alias("norm_a"), V.rounded(V.norm(y), 5).alias("norm_b"))


# Context.
@query
def snippets(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.snippet(F.col("text")), 256).alias("snippet"), F.length(T.clip(F.col("text"), 2000, "...")).alias("clipped"))


def _hits(spark, d):
    s = _vectors(spark, d).crossJoin(_one(spark, d, 0, "q")).select(F.col("vec_id").alias("doc_id"), V.rounded(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return _docs(spark, d).join(s, "doc_id")


@query
def context_blocks(spark, d):
    top = topk.top_k(_hits(spark, d), 5, "score", "doc_id")
    pos = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1
    b = top.withColumn("pos", pos).select("pos", C.block(F.col("pos"), F.col("source"), F.lit("/p=0"), F.col("doc_id").cast("string"), F.col("score"), T.snippet(F.col("text"))).alias("block"))
    return C.joined(b, [], ["pos"], "block")


@query
def hit_blocks(spark, d):
    h = _hits(spark, d).select("source", "doc_id", "score", C.hit_block(F.col("lang"), F.col("uri"), F.col("doc_id"), F.col("score"), F.col("source")).alias("block"))
    return C.joined(h.withColumn("neg", -F.col("score")), ["source"], ["neg", "doc_id"], "block", "\n\n")


@query
def prompts(spark, d):
    return _norm(spark, d).select("doc_id", F.sha2(C.prompt(T.title(F.col("text"), F.col("uri")), F.col("norm")), 256).alias("prompt"))


@query
def refs_filter(spark, d):
    lines = _lines(spark, d)
    cited = F.concat(F.when(F.col("doc_id") == F.col("line_no"), "References ").otherwise(""), "line", F.when(F.length("line") > 100, " [1], [2], [30], 1999, 2004, a, b").otherwise(""))
    return lines.select("doc_id", "line_no", T.is_references(cited).alias("refs"))


@query
def prefix_dedupe(spark, d):
    return C.first_by_prefix(_lines(spark, d).where("length(line) > 0"), "line", ["doc_id", "line_no"]).select("doc_id", "line_no")


@query
def jaccard(spark, d):
    t = _docs(spark, d).select("doc_id", T.word_set(F.col("text")).alias("w"))
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("x"))
    return t.join(nxt, "doc_id").select("doc_id", V.rounded(T.jaccard(F.col("w"), F.col("x")), 6).alias("jaccard"))


@query
def section_boost(spark, d):
    head = F.when(F.col("lang") == "en", "Abstract ").when(F.col("lang") == "fr", "1. Introduction ").when(F.col("lang") == "de", "CONCLUSIONS ").otherwise("")
    return _docs(spark, d).select("doc_id", V.rounded(F.lit(0.5) + T.section_boost(F.concat(head, "text")), 6).alias("score"))


def _questions(spark, d):
    h = _hits(spark, d).select(F.col("source").alias("question"), F.col("lang").alias("source"), F.col("doc_id").cast("int").alias("chunk_id"), "score", "text")
    return topk.top_k_per(h, 30, "question", "score", "chunk_id").drop("rank")


@query
def cap_per_doc(spark, d):
    return rerank.cap_per_doc(_questions(spark, d)).drop("text")


@query
def mmr(spark, d):
    return rerank.mmr(_questions(spark, d), 5).drop("text")


@query
def budget_pack(spark, d):
    return rerank.pack(_questions(spark, d), 6000).drop("text")


@query
def parse_hits(spark, d):
    e = _t(spark, d, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("{bad")).otherwise(F.col("props"))
    p = e.select("event_type", F.from_json(raw, "k int").alias("j")).select("event_type", F.col("j.k").alias("k"))
    return p.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("good"), F.sum("k").alias("total"))


@query
def json_roundtrip(spark, d):
    p = _docs(spark, d).select("doc_id", "text", F.to_json(F.struct("doc_id", "text")).alias("j"))
    back = p.select("doc_id", "text", F.from_json("j", "doc_id long, text string").alias("b"))
    return back.select("doc_id", (F.col("b.text") == F.col("text")).alias("same"))


@query
def context_from_hits(spark, d):
    h = topk.top_k_per(_hits(spark, d), 10, "source", "score", "doc_id")
    one = F.struct("score", F.col("uri").alias("doc_id"), F.col("doc_id").cast("int").alias("chunk_id"), F.col("lang").alias("source"), F.col("text"))
    lines = h.groupBy("source").agg(F.to_json(F.struct(F.lit("q").alias("question"), F.sort_array(F.collect_list(one)).alias("hits"))).alias("value"))
    return C.context_from_hits(lines.select(F.col("source").alias("run"), "value"), "run")


@query
def extract_html(spark, d):
    from tessera.sources.files import extract_text

    p = _t(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("uri"), F.encode("html", "UTF-8").alias("content"))
    return extract_text(p).select("uri", "status", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query
def embed_hashing(spark, d):
    from tessera.models import HashingEmbedder, embed_column

    e = embed_column(_norm(spark, d).select("doc_id", "norm"), "norm", HashingEmbedder())
    count = lambda test: F.size(F.filter("embedding", test))
    return e.select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dim"), count(lambda x: x > 0).alias("positive"), count(lambda x: x < 0).alias("negative"))


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that driver and executors share; with a local master, where none is set, on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def build_incremental(spark, d):
    """Build an index of all documents, run again, then retrieve and put together the context of a question."""
    from tessera.config import Config
    from tessera.models import HashingEmbedder
    from tessera.plans.build import build
    from tessera.plans.query import context_of, load_index, search

    root, e, c = shared_root(spark, "index"), HashingEmbedder(), Config()
    sources = _docs(spark, d).select("uri", F.octet_length("text").cast("long").alias("length"), F.lit(0).cast("long").alias("mtime"), F.encode("text", "UTF-8").alias("content"))
    first = build(spark, sources, root, e, c)
    again = build(spark, sources, root, e, c)
    hits = search(load_index(spark, root=root), e.embed(["the and of that"])[0], 5, e)
    done = {k: F.lit(first[k]).alias(k) for k in ("numChangedDocs", "numChunksWritten", "numEmbeddingsWritten", "indexRows")}
    return context_of(hits).select("context", *done.values(), F.lit(again["numChangedDocs"] + again["numChunksWritten"] + again["numEmbeddingsWritten"]).alias("rerunWork"))
