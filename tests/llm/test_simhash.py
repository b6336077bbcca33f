from __future__ import annotations

import collections
import random
import re

import pytest
import xxhash

from tessera.llm import simgroups as G
from tessera.llm import simhash as S
from tessera.llm.components import components


def brute(data, k=3):
    prints = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[a : a + k]).encode(), 42) for a in range(max(1, len(w) - k + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = collections.defaultdict(lambda: None)
    for g, (i, _) in zip(group, data, strict=True):
        if i is not None:
            least[g] = i if least[g] is None else min(i, least[g])
    return sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(data, prints, group, strict=True)), key=str)


def rows():
    rng = random.Random(3)
    base = [f"t{rng.randrange(500)}" for _ in range(1500)]
    out = [(i, " ".join(w if rng.random() > 0.002 else "zz" + str(rng.randrange(99)) for w in base)) for i in range(150)]
    out += [(200 + i, " ".join(f"u{rng.randrange(2000)}" for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    return out + [(400, None), (401, " \t"), (402, "One"), (403, "one"), (404, "a b"), (405, out[0][1]), (405, out[0][1]), (None, "alone here")]


@pytest.mark.parametrize("paired", [256, 3])
def test_against_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(S, "PAIRED", paired)
    data = rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, fp int")
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute(data)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).count() == 0 and G.keep_one(none).count() == 0


def test_chains_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 500).astype(np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
        ok = np.zeros(500, bool)
        for start in range(S.SEGMENTS):
            ok |= S.within_budgets(x ^ y, np.full(500, start))
        assert ok.all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(1000 + rng.randrange(50), 2000 + rng.randrange(50)) for _ in range(60)] + [(5000, 6000 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_groups_of_similar_texts(spark):
    rng = random.Random(8)
    originals = [[f"v{rng.randrange(5000)}" for _ in range(rng.randrange(150, 400))] for _ in range(60)]
    data, family = [], {}
    for f, base in enumerate(originals):
        for c in range(3):
            w = list(base)
            for _ in range(c * 2):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(999))
            data.append((10 * f + c, " ".join(w), f))
            family[10 * f + c] = f
        half = base[: len(base) // 2] + [f"y{rng.randrange(5000)}" for _ in range(len(base) // 2)]
        data.append((10 * f + 9, " ".join(half), f))
    data += [(5000, None, 0), (5001, "", 0), (10, data[4][1], 1)]
    kept = G.keep_one(spark.createDataFrame(data, "doc_id long, text string, _rid int"))
    assert kept.columns == ["doc_id", "text", "_rid"]
    ids = sorted(r.doc_id for r in kept.collect())
    near = [t for t in data if t[0] < 5000 and t[0] % 10 in (1, 2) and jaccard(t[1], " ".join(originals[t[0] // 10])) >= 0.8]
    assert len(near) > 100 and sum(t[0] in ids for t in near) <= 0.03 * len(near)
    assert all(10 * f in ids and 10 * f + 9 in ids for f in range(60)) and ids.count(10) == 1 and sum(i >= 5000 for i in ids) == 1


def test_a_dense_bucket_stays_together(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(5000)}" for _ in range(300)]
    data = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        data.append((i, " ".join(w)))
    G_BLOCK, G.BLOCK = G.BLOCK, 50
    try:
        assert [r.doc_id for r in G.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()] == [0]
    finally:
        G.BLOCK = G_BLOCK
