from __future__ import annotations

import random

from tessera.llm import decontam as D

RNG = random.Random(2)
VOCABULARY = [f"w{i}" for i in range(3000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(words(RNG.randrange(10, 60)))) for i in range(40)]


def brute(docs, items):
    """The least edits of any window, by full dynamic programming over the document."""
    out = set()
    for d, text in docs:
        w = D.normal((text or "").encode()).split()
        for i, item in items:
            a = D.normal((item or "").encode()).split()
            if len(a) < D.MIN_WORDS:
                continue
            row = [0] * (len(w) + 1)
            for r, x in enumerate(a, 1):
                new = [r]
                for c, y in enumerate(w, 1):
                    new.append(min(row[c - 1] + (x != y), row[c] + 1, new[c - 1] + 1))
                row = new
            if min(row) <= int(D.MAX_EDITS * len(a)):
                out.add((d, i))
    return out


def edited(text, rate):
    w = text.split()
    for _ in range(int(rate * len(w))):
        at = RNG.randrange(len(w))
        kind = RNG.randrange(3)
        w[at : at + (kind != 0)] = [] if kind == 1 else [RNG.choice(VOCABULARY)]
    return " ".join(w)


def test_against_brute_force(spark):
    docs = [(i, " ".join([*words(30), edited(item, rate), *words(30)])) for i, (item, rate) in enumerate((t, r) for _, t in ITEMS for r in (0, 0.1, 0.18, 0.5))]
    docs += [(1000 + i, " ".join(words(80))) for i in range(40)] + [(2000, None), (2001, ""), (2002, ITEMS[0][1].upper().replace(" ", ",  ")), (2003, " ".join(words(5000)) + " " + ITEMS[1][1]), (None, ITEMS[2][1]), (2004, ITEMS[3][1]), (2004, ITEMS[3][1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    items = [*ITEMS, (100, "the short one"), (101, None), (102, ITEMS[5][1])]
    found = D.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    true, got = brute(docs, items), {(r.doc_id, r.item_id) for r in found}
    assert not got - true and len(true - got) <= 0.02 * len(true)
    assert sum(r.doc_id == 2004 for r in found) == 2
    clean = {r.doc_id for r in D.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_empty_tables_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[7][1])], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0 and D.drop_contaminated(docs, none).count() == 2
    assert D.contaminated(docs.where("doc_id > 9"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    monkeypatch.setattr(D, "BLOCK_ITEMS", 15)
    assert {(r.doc_id, r.item_id, r.distance) for r in D.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()} == {(1, 0, 0), (2, 7, 0)}


def test_edit_distance():
    assert D.edit_distance([1, 2, 3], [1, 2, 3, 9], 1) == 0 and D.edit_distance([1, 2, 3], [1, 3], 1) == 1
    assert D.edit_distance([1, 2, 3], [4, 5, 6], 1) == 2
