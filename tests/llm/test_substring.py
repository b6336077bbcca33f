from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

from tessera.llm import substring as S

RNG = random.Random(5)


def words(n):
    return [f"w{RNG.randrange(4000)}" for _ in range(n)]


def rows():
    passage, line, whole = words(60), words(20), " ".join(words(90))
    out = [(i, " ".join(words(30) + passage + words(25) + line + words(RNG.randrange(40)))) for i in range(120)]
    out += [(200, " ".join(["a"] * 200)), (201, " ".join(["b", "c"] * 60)), (202, None), (203, ""), (204, "x"), (205, " ".join(words(35))), (206, " ".join(words(34)))]
    out += [(300, whole), (300, whole), (301, whole.replace(" ", "\t\n")), (None, "q " + whole), (302, " ".join(["a"] * 36)), (303, " ".join(words(4000)) + " " + whole), (304, "é ü " + whole + " é ü")]
    return out


def brute(data, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    seen = collections.Counter(tuple(w[a : a + window]) for w in split for a in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(data, split, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("frequent", "cells"), [(64, 1 << 27), (3, 1 << 16), (10_000, 1 << 16)])
def test_against_brute_force(spark, frequent, cells):
    data = rows()
    docs = spark.createDataFrame([(i, t, 3) for i, t in data], "doc_id long, text string, rid int").repartition(5)
    got = S.remove_repeats(docs, frequent=frequent, most_cells=cells).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(data, 35)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    data = rows()
    got = S.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), most_cells=64)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(data, 35)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
