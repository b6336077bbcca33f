"""The near-duplicate stage against exact Jaccard similarity, compared pair by pair."""

from __future__ import annotations

import random

from tessera.llm import simgroups as G
from tessera.llm.simhash import fingerprint


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(data, similarity=0.8):
    """The smallest id of each component, by all pairs."""
    sets, root = [shingles(t) for _, t in data], list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j])) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(data[i][0] for i in range(len(data)) if root[i] == r) for r in set(root))


def kept(spark, data):
    return sorted(r.doc_id for r in G.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect())


def test_a_sparse_large_bucket_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 64)
    rng = random.Random(1)
    base = [words(rng, 150) for _ in range(250)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:-5] + words(rng, 5) if i % 9 == 0 else words(rng, 150)) for i, w in enumerate(base)]
    brief = [bytes(G.minhashes(G.shingle_set(t.encode(), 5), 120).astype("u1")) for t in texts]
    nodes = spark.createDataFrame([(i, [7], b, (False, i, i)) for i, b in enumerate(brief)], "node long, keys array<long>, brief binary, least struct<none: boolean, doc_id: long, rid: long>")
    links = G._links(nodes, spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), 0.8, 5)
    assert {(min(r), max(r)) for r in links.collect()} == {(i, i + 250) for i in range(0, 250, 9)}


def test_groups_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    rng = random.Random(4)
    data = []
    for _ in range(12):  # copies of copies, some changed in few places and some in many
        family = [words(rng, rng.randrange(3, 200))]
        for _ in range(20):
            w = list(rng.choice(family))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            family.append(w)
        data += [" ".join(w) for w in family]
    rng.shuffle(data)
    data = list(enumerate(data))
    assert kept(spark, data) == brute(data)


def test_pairs_right_at_the_radius(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):  # 300 shingles, 33 of them changed: 267 / 333; 34 changed: 266 / 334
        w = words(rng, 304)
        data += [(4 * i, " ".join(w)), (4 * i + 1, " ".join(w[:-33] + words(rng, 33)))]
        w = words(rng, 304)
        data += [(4 * i + 2, " ".join(w)), (4 * i + 3, " ".join(w[:-34] + words(rng, 34)))]
    assert kept(spark, data) == [i for i in range(1200) if i % 4 != 1]


def test_a_repeated_line_makes_no_copies(spark):
    rng = random.Random(3)
    line = " ".join(words(rng, 12))
    data = [(i, " ".join([*words(rng, 100), *[line] * 10])) for i in range(40)]
    once = words(rng, 100)
    data += [(50, " ".join([*once, line])), (51, " ".join([*once, *[line] * 10]))]
    assert kept(spark, data) == brute(data) and 50 in kept(spark, data) and 51 not in kept(spark, data)


def test_near_copies_are_linked_by_fingerprints_and_checked_exactly(spark, monkeypatch):
    """Without any MinHash key in common, what op5's fingerprints and pigeonring filter find is linked, if it is similar."""
    monkeypatch.setattr(G, "band_keys", lambda least: G.np.random.default_rng().integers(-(2**62), 2**62, len(least) // G.ROWS))
    rng = random.Random(6)
    data = []
    for _ in range(40):
        w = words(rng, 600)
        data += [" ".join(w)] + [" ".join([*w[:-n], *words(rng, n)]) for n in (1, 2, 30)]
    sets = [shingles(t) for t in data]
    prints = [fingerprint(G.shingle_set(t.encode(), 5)) for t in data]

    def least(similarity, bits):
        root = list(range(len(data)))
        for i in range(len(data)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= bits and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and root[i] != root[j]:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        return set(root)

    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {s: {r.doc_id for r in G.keep_one(docs, similarity=s).collect()} for s in (0.8, 0.995)}
    assert len(least(0.8, 2)) < 90 and least(0.8, 64) <= got[0.8] <= least(0.8, 2)
    assert least(0.995, 64) <= got[0.995] and got[0.8] < got[0.995] < set(range(len(data)))
