from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import chunk as chunk_
from tessera.operators import delta, knn, rerank, topk
from tessera.operators.chunk import Sentences, fixed_windows


def w(n, dots=()):
    t = ["abcdefghij"[(7 * k + k // 10) % 10] for k in range(n)]
    for d in dots:
        t[d] = "."
    return "".join(t)


CASES = [("", []), (w(79), []), (w(80), [(0, 0, 80)]), (w(900), [(0, 0, 900)]), (w(1500, [539]), [(0, 0, 900), (1, 792, 1500)]), (w(1500, [540]), [(0, 0, 541), (1, 433, 1333), (2, 1225, 1500)]), ("-- 12 --", []), ("1234567890" * 10, []), ("$" * 100, [])]


@pytest.mark.parametrize(("text", "kept"), CASES)
def test_sentence_chunks(text, kept):
    found = Sentences().split(text)
    assert [(p["ix"], p["start"], p["end"]) for p in found] == kept
    assert all(p["text"] == text[p["start"] : p["end"]] for p in found)


def test_junk_counts_characters_of_any_script():
    c, rng = Sentences(), random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice("aZ9 .,$^~_\x1c\u00a0\u00e9\u4e2d\u00b2\u2013\u0663\u20ac") for _ in range(rng.randint(80, 120))) + rng.choice(("", "abc" * 30))
        letters, odd = sum(x.isalpha() for x in t), sum(not c.plain(x) for x in t)
        assert c.junk(t) == (letters / len(t) < 0.45 or odd / len(t) > 0.55)


def test_sentences_of_a_paragraph():
    t = ("The quick brown fox jumps over lazy dogs and cats. " * 100).strip()
    assert [(p["ix"], p["start"], p["end"]) for p in Sentences().split(t)] == [(0, 0, 866), (1, 759, 1631), (2, 1524, 2396), (3, 2289, 3161), (4, 3054, 3926), (5, 3819, 4691), (6, 4584, 5099)]


def test_compat_keeps_what_it_finds():
    found = Sentences(compat=True).split(w(1500, [539]))
    assert [(p["ix"], p["start"], p["end"]) for p in found] == [(0, 0, 900), (2, 992, 1100), (3, 1193, 1300), (4, 1394, 1500)]


def test_pieces_cover_the_text():
    rng = random.Random(4)
    for _ in range(20):
        t = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta,"]) for _ in range(rng.randrange(20, 900)))
        seen = set()
        for p in Sentences(Config(min_chars=1)).split(t):
            seen.update(range(p["start"], p["end"]))
        assert all(i in seen for i, c in enumerate(t) if c != " ")


def test_fixed_windows(spark):
    df = spark.createDataFrame([("",), ("a" * 5,), ("a" * 10,), ("a" * 11,), (None,)], "t string")
    got = [r.n for r in df.select(F.transform(fixed_windows(F.col("t"), 10, 8), lambda p: p["start"]).alias("n")).collect()]
    assert got[:4] == [[], [0], [0], [0, 5]] and not got[4]


def test_changed_is_null_safe(spark):
    now = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", None)], "uri string, n int")
    before = spark.createDataFrame([("a", 1), ("b", None), ("c", None)], "uri string, n int")
    assert sorted(r.uri for r in delta.changed(now, before, "uri", ["n"]).collect()) == ["c", "d"]


def test_latest_breaks_ties(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "k string, at int, h string")
    assert delta.latest(v, "k", "at", "h").first().h == "z"


def test_merge_keeps_the_larger_id_at_the_boundary(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.5), ("c", 0, 0.5)], "doc string, chunk int, score double")
    assert [(r.doc, r["rank"]) for r in topk.merge_top_k(s, 2, "score", "doc", "chunk").orderBy("rank").collect()] == [("a", 1), ("c", 2)]


def test_nan_ranks_last(spark):
    s = spark.createDataFrame([(1, float("nan")), (2, -1.0), (3, 2.0)], "id int, score double")
    assert [r.id for r in topk.top_k(s, 3, "score", "id").collect()] == [3, 2, 1]


HITS = [("q", "d1", 1, 0.9, "alpha beta"), ("q", "d1", 2, 0.8, "alpha beta"), ("q", "d1", 1001, 0.7, "gamma"), ("q", "d1", 2001, 0.6, "delta"), ("q", "d2", 1, 0.5, "epsilon zeta")]


def hits(spark):
    return spark.createDataFrame(HITS, rerank.HITS)


def test_cap_per_doc(spark):
    assert [(r.source, r.chunk_id) for r in rerank.cap_per_doc(hits(spark)).orderBy("pos").collect()] == [("d1", 1), ("d1", 1001), ("d2", 1)]


def test_mmr(spark):
    assert [(r.source, r.chunk_id) for r in rerank.mmr(hits(spark), 3).orderBy("pos").collect()] == [("d1", 1), ("d1", 1001), ("d1", 2001)]


def test_pack_goes_on_after_what_does_not_fit(spark):
    assert [r.chunk_id for r in rerank.pack(hits(spark), 20).orderBy("pos").collect()] == [1, 1001]
    assert [r.chunk_id for r in rerank.pack(hits(spark), 14).orderBy("pos").collect()] == [1]


def test_exact_knn(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None)], "vec_id long, embedding array<double>")
    got = knn.exact_knn(df, df.where("vec_id < 10"), 3).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(10):
        s = u @ u[q]
        s[q] = -9
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-s)[:3].tolist()


def test_exact_knn_holds_a_tile_of_scores_not_a_batch(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 16))

    class Base:
        """Stands for a frame: its function is called in this process."""

        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                @staticmethod
                def broadcast(value):
                    return type("Shared", (), {"value": value})

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            return f

    monkeypatch.setattr(knn.F, "col", lambda _: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())
    one = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])
    query = one.slice(0, 3000)
    try:
        run = knn._block(Base(), query, 5, "vec_id", "v", "cosine")
    except (AttributeError, TypeError):  # as rows, not as a batch
        row = type("Row", (tuple,), {"v": property(lambda s: s[1])})
        run = knn._block(Base(), [row(r) for r in zip(query.column(0).to_pylist(), query.column(1).to_pylist(), strict=True)], 5, "vec_id", "v", "cosine")
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter([one]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 << 20  # all scores of the batch are 288 MB
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 3000, 500):
        s = u @ u[q]
        s[q] = -9
        own = got.filter(pa.compute.equal(got["query_id"], q)).sort_by([("score", "descending")])
        assert own["vec_id"].to_pylist() == np.argsort(-s)[:5].tolist()


def test_exact_knn_ties_by_id_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 4)
    rows = [(i, [1.0, 2.0, 0.1 * (i % 3)]) for i in range(60)] + [(90, [0.0, 0.0, 0.0]), (91, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = {(r.query_id, r["rank"]): r.vec_id for r in knn.exact_knn(df, df.where("vec_id % 20 = 0 OR vec_id > 89"), 4).collect()}
    for q in (0, 20, 40):
        assert [got[q, r] for r in (1, 2, 3, 4)] == [i for i in range(60) if i % 3 == q % 3 and i != q][:4]
    assert [got[91, r] for r in (1, 2, 3, 4)] == [got[90, r] for r in (1, 2, 3, 4)] == [0, 1, 2, 3]


def test_exact_knn_queries_without_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in knn.exact_knn(df, df.where("vec_id = 20"), 5).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0)]


@pytest.mark.parametrize("step", ["chunk_compat", "embed_hashing", "extract_html"])
def test_a_step_holds_a_slice_of_a_batch(spark, monkeypatch, step):
    """What is made of a batch's first texts leaves the task before the others are worked on."""
    import pyarrow as pa

    from tessera.models import HashingEmbedder, embed_column
    from tessera.sources import files

    df = spark.createDataFrame([("u.html", b"x")], "uri string, content binary" if step == "extract_html" else "uri string, norm string")
    found, batch = [], pa.RecordBatch.from_pydict({"uri": [f"{i}.html" for i in range(1000)], ("content" if step == "extract_html" else "norm"): [b"<p>abc" if step == "extract_html" else "abc " * 300] * 1000})
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self.selectExpr("*", "array(struct(1 AS ix, 1 AS start, 1 AS end, '' AS text)) AS pieces"))
    {"chunk_compat": lambda: chunk_.sentence_chunks(df, ["uri"], compat=True), "embed_hashing": lambda: embed_column(df, "norm", HashingEmbedder()), "extract_html": lambda: files.extract_text(df)}[step]()
    out = list(found[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 64 and pa.Table.from_batches(out)["uri"].to_pylist() == batch["uri"].to_pylist()
