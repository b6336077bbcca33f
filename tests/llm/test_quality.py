from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from tessera.llm import quality as Q

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = Q.op6_additive_quality(spark, DATA).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(p == 0 for p, y in held if y == 0)


def test_edges(spark):
    texts = [(1, "Good plain words in a row, and more of them."), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "BAD!! BAD!! " * 200_000), (5, "\n\n")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in texts], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = Q.train(docs, labels, fold=None)
    out = Q.score(docs, model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    kept = Q.keep_good(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.5}
    assert Q.score(docs.where("doc_id > 99"), model).count() == 0


def test_pairs_are_learnt():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(Q.FEATURES)))
    x[:, :3] = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Q.fit(x, y)
    assert m.pairs[0][:2] == (0, 1) and np.mean((m.score(x) > 0.5) == y) > 0.9


def test_bound_of_the_sample(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text of ', id) AS text")
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    assert isinstance(Q.train(docs, labels, fit_rows=100), Q.Model)


def test_pair_trees_against_all_splits():
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, w = rng.normal(size=(5, 4)), rng.uniform(5, 9, size=(5, 4))
        value = lambda m: g[m].sum() ** 2 / (w[m].sum() + 1)
        a, b = np.indices(g.shape)
        masks = [a < k for k in range(1, 5)] + [b < k for k in range(1, 4)]
        best = max(masks, key=lambda m: value(m) + value(~m))
        want = np.where(best, g[best].sum() / (w[best].sum() + 1), g[~best].sum() / (w[~best].sum() + 1))
        assert np.allclose(Q._pair_tree(g, w, leaves=2), want)
        assert len(np.unique(Q._pair_tree(g, w).round(12))) <= 4


def test_scores_against_looking_up_one_by_one():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, len(Q.FEATURES))).round(1)  # ties on the bins' edges
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Q.fit(x, y)
    want = []
    for row in x[:100]:
        z = m.intercept + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(m.tables, m.edges, row, strict=True))
        z += sum(t[sum(e <= row[a] for e in m.pair_edges[a]), sum(e <= row[b] for e in m.pair_edges[b])] for a, b, t in m.pairs)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(m.score(x[:100]), want)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.85  # which no sum of single features gives
