"""Invariants of the incremental build."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.models import HashingEmbedder, ModelError, StubChat
from tessera.plans.build import build
from tessera.plans.query import answer, load_index, search
from tessera.sources.store import Store

A = "The first text speaks of rivers and lakes. " * 30
B = "Another text speaks of mountains and valleys. " * 30
E = HashingEmbedder()


def sources(spark, files: dict[str, str], mtime: int = 0):
    return spark.createDataFrame([(u, len(t), mtime, bytearray(t.encode())) for u, t in files.items()], "uri string, length long, mtime long, content binary")


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def index(spark, root):
    return {(r.uri, r.chunkIx): r.contentHash for r in load_index(spark, root=root).collect()}


def test_rerun_does_nothing(spark, root):
    s = sources(spark, {"a.txt": A, "b.txt": B, "c.txt": "too short"})
    first = build(spark, s, root, E)
    assert first["numChangedDocs"] == 3 and first["indexRows"] == first["numEmbeddingsWritten"] > 2
    again = build(spark, s, root, E)
    assert (again["numChangedDocs"], again["numChunksWritten"], again["numEmbeddingsWritten"]) == (0, 0, 0) and again["indexRows"] == first["indexRows"]


def test_touched_file_is_not_changed(spark, root):
    build(spark, sources(spark, {"a.txt": A}), root, E)
    assert build(spark, sources(spark, {"a.txt": A}, mtime=5), root, E)["numChangedDocs"] == 0


def test_revert_delete_and_emptied(spark, root):
    build(spark, sources(spark, {"a.txt": A, "b.txt": B}), root, E)
    was = index(spark, root)
    build(spark, sources(spark, {"a.txt": B, "b.txt": B}), root, E)
    assert index(spark, root) != was
    back = build(spark, sources(spark, {"a.txt": A, "b.txt": B}), root, E)
    assert index(spark, root) == was and back["numEmbeddingsWritten"] == 0
    build(spark, sources(spark, {"a.txt": A}), root, E)
    assert {u for u, _ in index(spark, root)} == {"a.txt"}
    build(spark, sources(spark, {"a.txt": "now short"}), root, E)
    assert not index(spark, root)


def test_new_version_embeds_everything(spark, root):
    s = sources(spark, {"a.txt": A, "b.txt": B})
    first = build(spark, s, root, E)
    second = build(spark, s, root, HashingEmbedder(version="2"))
    assert second["numChangedDocs"] == 0 and second["numEmbeddingsWritten"] == first["numEmbeddingsWritten"]


def test_crash_while_embedding_is_taken_up(spark, root):
    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise ModelError("down")

    s = sources(spark, {"a.txt": A})
    with pytest.raises(Exception, match="down"):
        build(spark, s, root, Broken())
    assert build(spark, s, root, E)["indexRows"] > 0


def test_metrics_hold_two_runs_and_snapshots_are_removed(spark, root):
    for t in (A, B, A + B):
        build(spark, sources(spark, {"a.txt": t}), root, E)
    s = Store(spark, root)
    assert s.read("metrics", schemas.METRICS).count() == 2
    lines = [r.value for r in spark.read.text(s.path("run_metrics.csv")).collect()]
    assert len(lines) == 3 and lines[0].startswith("runAt,")


def test_files_on_disk_and_stream(spark, root, tmp_path):
    from tessera.streaming.watch import watch

    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text(A)
    (folder / "b.html").write_text(f"<html><head><title>x</title></head><body><p>{B}</p><script>bad()</script></body></html>")
    (folder / "c.pdf").write_bytes(b"%PDF-nothing")
    q = watch(spark, str(tmp_path / "in"), root, str(tmp_path / "ck"), E, once=True)
    q.awaitTermination(120)
    i = load_index(spark, root=root)
    assert i.select("uri").distinct().count() == 2 and not i.where(F.col("chunkText").contains("bad()")).count()


def test_answer(spark, root):
    build(spark, sources(spark, {"a.txt": A, "b.txt": B}), root, E)
    found = answer(spark, load_index(spark, root=root), "mountains and valleys", E, StubChat())
    assert "mountains" in found["context"].split("\n")[1] and found["answer"].startswith("[2 messages")
    with pytest.raises(ValueError):
        answer(spark, load_index(spark, root=root), "  ", E, StubChat())


def test_index_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_index(spark, root=f"file://{tmp_path}/none")


def test_index_of_the_configured_path(spark, root):
    s = Store(spark, root)
    s.replace(schemas.empty(spark, schemas.INDEX), "elsewhere")
    there, missing = Config(index_path=s.path("elsewhere")), Config(index_path=s.path("nowhere"))
    assert load_index(spark, config=there).columns == [f.split()[0] for f in schemas.INDEX.split(", ")]
    with pytest.raises(FileNotFoundError):
        load_index(spark, config=missing)


def test_skipped_are_counted_and_scores_scaled(spark, root):
    rows = [("a", 1, 0, ("Rivers run through the valley and reach the sea. " * 5).encode()), ("b", 1, 0, b"  ")]
    m = build(spark, spark.createDataFrame(rows, "uri string, length long, mtime long, content binary"), root, E)
    assert (m["numDocsScanned"], m["numChangedDocs"], m["numSkippedDocs"]) == (2, 1, 1)
    i, v = load_index(spark, root=root), E.embed(["rivers of the valley"])[0]
    plain, scaled = search(i, v, 1, E).first().score, search(i, v, 1, E, scaled=True).first().score
    assert scaled == pytest.approx((1 + plain) / 2)


def test_swap_may_read_what_it_replaces(spark, root):
    s = Store(spark, root)
    s.replace(spark.createDataFrame([(1,), (2,)], "n int"), "t")
    s.replace(s.read("t", "n int").where("n > 1"), "t")
    assert [r.n for r in s.read("t", "n int").collect()] == [2]


def test_partitions_are_replaced_alone(spark, root):
    s = Store(spark, root)
    s.append(spark.createDataFrame([(1, "a"), (2, "b")], "docId int, p string"), "t", ["p"])
    s.overwrite_partitions(spark.createDataFrame([(3, "a")], "docId int, p string"), "t", ["p"])
    assert sorted((r.docId, r.p) for r in s.read("t", "docId int, p string").collect()) == [(2, "b"), (3, "a")]


def test_only_suspect_files_are_read(spark, tmp_path):
    from tessera.plans.build import suspects
    from tessera.sources.files import list_files

    for name in ("a.txt", "b[1].txt", "b1.txt", "c{x}*.txt"):
        (tmp_path / name).write_text(name)
    listing = list_files(spark, str(tmp_path))
    some = suspects(spark, str(tmp_path), listing.where("uri LIKE '%b[1]%' OR uri LIKE '%c{x}%'"), "*")
    assert sorted(bytes(r.content).decode() for r in some.collect()) == ["b[1].txt", "c{x}*.txt"]
    assert len(some.inputFiles()) == 2
    none = suspects(spark, str(tmp_path), listing.where("false"), "*")
    assert none.collect() == [] and "FileScan" not in none._jdf.queryExecution().executedPlan().toString()


def test_a_rerun_publishes_nothing_and_a_first_run_compares_nothing(spark, root, monkeypatch):
    from tessera.plans import build as module

    joined, publish, own = [], [], Store.publish
    monkeypatch.setattr(module, "matching", lambda files, uris: joined.append(1) or files.join(uris.select("uri"), "uri", "left_semi"))
    monkeypatch.setattr(Store, "publish", lambda self, *a: publish.append(1) or own(self, *a))
    sources = spark.createDataFrame([(f"u{i}", 9, 0, bytearray(("some words that go on. " * 9 + str(i)).encode())) for i in range(3)], "uri string, length long, mtime long, content binary")
    first = module.build(spark, sources, root, HashingEmbedder())
    assert not joined and len(publish) == 1 and first["indexRows"] == 3
    assert module.build(spark, sources, root, HashingEmbedder())["indexRows"] == 3
    assert len(publish) == 1
