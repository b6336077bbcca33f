from __future__ import annotations

import pathlib

import numpy as np
import pytest

from tessera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)  # a column whose name clashes with the result's
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect()]


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in ids[ids % 20 == 0]:
        s = x @ x[np.flatnonzero(ids == i)[0]]
        out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def vectors(n, dim=16, seed=0, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * (rng.uniform(0.2, 3, size=(n, 1)) if scale else 1)
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rows = vectors(3000, scale=scale)
    true, got = brute(rows), {}
    for q, r, i, _ in run(spark, rows, list_rows=64):
        got.setdefault(q, []).append(i)
    assert set(got) == set(true) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(true[q])) / 20 for q in true]) >= 0.9


def test_few_rows_ties_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [2.0, 0.0])]
    assert [x[:3] for x in run(spark, rows)] == [(0, 1, 5), (0, 2, 3), (0, 3, 20), (0, 4, 2), (20, 1, 5), (20, 2, 0), (20, 3, 3), (20, 4, 2)]


def test_a_hot_vector(spark):
    rows = [(i, [1.0, 1.0]) for i in range(400)] + [(1000 + i, [float(i % 7), 1.0]) for i in range(1, 50)]
    got = run(spark, rows)
    true = brute(rows)
    for q in true:
        assert [i for a, _, i, _ in got if a == q] == true[q]


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (None, [5.0, 5.0])]
    assert [x[:3] for x in run(spark, rows)] == [(0, 1, 1)]
    assert run(spark, []) == [] and run(spark, [(0, None)]) == [] and run(spark, [(0, [0.0])]) == []


def test_graph_search_finds_lists_in_the_ratio(spark):
    x = np.random.default_rng(3).normal(size=(2000, 8))
    i = ann.Index.fit(x, 60, float(np.linalg.norm(x, axis=1).max()), 10, 0.95)
    d = ann._distance(i.queries(x[:100]), i.centroids)
    exact = d <= i.ratio * d.min(1)[:, None]
    assert (i.lists(x[:100]) & exact).sum() >= 0.98 * exact.sum()


def clustered(n, dim=32, clusters=20, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dim))
    return middle[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_boundary_vectors_are_replicated_and_lists_pruned(kind):
    rng = np.random.default_rng(7)
    x = clustered(6000) if kind == "clustered" else rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i = ann.Index.fit(x, 60, 1.0, 20, 0.95)
    at = i.assign(x)
    sizes = np.bincount(at[at >= 0], minlength=60)
    copies, scanned = (at >= 0).sum() / len(x), (i.lists(x[::20]) * sizes).sum(1).mean() / sizes.sum()
    assert 1.0 < copies < 2.6 and scanned < (0.2 if kind == "clustered" else 0.8)
    assert np.bincount(at[:, 0], minlength=60).max() <= 4 * len(x) / 60
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -9
    true = np.argsort(-s, 1)[:, :20]
    found = [np.isin(t, np.flatnonzero(np.isin(at, np.flatnonzero(row)).any(1))).mean() for t, row in zip(true, i.lists(x[::20]), strict=True)]
    print(kind, copies, scanned, np.mean(found))
    assert np.mean(found) >= 0.9


def written(spark):
    """Bytes of all shuffles so far, and of what is in the shared folder."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) + sum(f.stat().st_size for f in shared.rglob("*.parquet"))


def test_what_is_written_grows_with_the_vectors_alone(spark):
    """However many lists a query searches, neither it nor its hits are written for each of them."""
    rows, before = vectors(20_000), written(spark)
    assert len(run(spark, rows, list_rows=16)) == 20 * 1000
    assert written(spark) - before < 10 * 20_000 * 16 * 4


def test_answers_against_a_sort(monkeypatch):
    monkeypatch.setattr(ann, "HITS", 50)
    monkeypatch.setattr(ann, "SCORES", 100)
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(-3, 4, (400, 3)).astype(float), axis=0)  # many equal scores
    x = x[np.abs(x).sum(1) > 0]
    ids = rng.permutation(3 * len(x)).reshape(-1, 3)
    best = ann.Answers(x[::9], float(np.linalg.norm(x, axis=1).max()), 7)
    for part in (slice(0, 90), slice(60, 120), slice(100, None), slice(0, 5)):  # boundary vectors stand in several lists
        best.scan(np.arange(len(x[::9])), x[part], ids[part].ravel(), np.full(len(x[part]), 3))
    best.merge()
    for q, got, score in zip(x[::9], best.id, best.score, strict=True):
        s = np.repeat(x @ q, 3)
        order = np.lexsort((ids.ravel(), -s))[:7]
        assert got.tolist() == ids.ravel()[order].tolist() and score.tolist() == s[order].tolist()


@pytest.mark.parametrize("kind", ["tight clusters", "queries elsewhere"])
def test_recall_where_clusters_are_apart_or_queries_unlike_the_rest(spark, kind):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(20 if kind == "tight clusters" else 50, 32))
    x = middle[rng.integers(0, len(middle), 4000)] + 0.05 * rng.normal(size=(4000, 32))
    if kind == "queries elsewhere":
        x[::20] = rng.normal(size=(200, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    true, got = brute(rows), {}
    for q, _, i, _ in run(spark, rows, list_rows=64):
        got.setdefault(q, []).append(i)
    assert np.mean([len(set(got[q]) & set(true[q])) / 20 for q in true]) >= 0.9
