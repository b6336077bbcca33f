from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        n.append(docs.count())
    assert n[0] > n[1] > n[2] > n[3]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    bad = [i for i, y in labels.items() if y == 0]
    assert sum(i in ids for i in bad) <= 0.1 * len(bad)  # some 60 labelled documents to learn from
    out = corpus_pipeline.STAGES[4][1](spark, docs, DATA).orderBy("start").collect()
    assert len(out) == n[4] and [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def one_of_each(rows, similarity=0.8, k=5):
    """(id, text) rows -> the smallest id of each component of similar shingle sets, by all pairs."""
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def leaked(text, items, most=0.2, least_words=8):
    """Whether any window is within the edits of an item: dynamic programming over the whole text, a row for each word of the item."""
    split = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).encode().split()
    known: dict = {}
    w = np.array([known.setdefault(x, len(known)) for x in split(text)], int)
    places = np.arange(len(w) + 1)
    for item in items:
        a = split(item)
        if len(a) < least_words:
            continue
        row = np.zeros(len(w) + 1, int)
        for r, x in enumerate(a, 1):
            new = np.concatenate([[r], np.minimum(row[:-1] + (w != known.get(x, -1)), row[1:] + 1)])
            row = np.minimum.accumulate(new - places) + places
        if row.min() <= int(most * len(a)):
            return True
    return False


def water(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by pouring again and again: what stands above a cap goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not full:
            return target | share
        target |= {s: epochs * sizes[s] for s in full}
        left, open_ = left - sum(epochs * sizes[s] for s in full), open_ - full
    return target


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_against_brute_force(spark):
    """Each stage's rows against a plain version on that stage's own input."""
    from tokenizers import Tokenizer

    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs, rows = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"brute-{name}")
        rows[name] = docs.collect()
    ids = {name: sorted(r.doc_id for r in x) for name, x in rows.items()}
    assert ids["near_duplicates"] == one_of_each([(r.doc_id, r.text) for r in rows["quality"]])
    assert ids["decontamination"] == sorted(r.doc_id for r in rows["near_duplicates"] if not leaked(r.text, items))

    before, times = rows["decontamination"], {i: ids["mixing"].count(i) for i in set(ids["decontamination"])}
    assert set(rows["mixing"]) <= set(before) and max(times.values()) <= 3
    size = {r.doc_id: len(words_of(r.text)) for r in before}
    of = {s: [r.doc_id for r in before if r.source == s] for s in {r.source for r in before}}
    target = water({s: sum(size[i] for i in x) for s, x in of.items()})
    for s, x in of.items():  # the smallest document that is left is twice as far off at least
        assert abs(sum(size[i] * times[i] for i in x) - target[s]) <= max(size[i] for i in x) / 2 + 1

    tokenizer, start, want = Tokenizer.from_file(str(corpus_pipeline.TOKENIZER)), 0, []
    for r in sorted(rows["mixing"], key=lambda r: r.doc_id):
        found = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    out = corpus_pipeline.STAGES[4][1](spark, docs, DATA).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == want


def tables(spark, path, docs):
    """docs, and the labels and benchmark that the stages read, with columns of the same names."""
    text = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, 1, "x"), (2, 0, None), (None, 1, "y"), (3, None, "z")], "doc_id long, quality int, text string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, text, 5), (None, None, None), (2, "", 6)], "item_id long, text string, doc_id long").write.parquet(f"{path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, item_id long, keep boolean, node long, size long"
    frame = spark.createDataFrame([(*d, 0.5, 1, False, 2, 3) for d in docs], schema)
    frame.write.parquet(f"{path}/documents.parquet")
    return frame.columns, text


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(40))
    plain = [" ".join(f"{'abcdef'[i]}{j}" for j in range(60)) for i in range(6)]
    docs = [(10 + i, t, "en", "ab"[i % 2], 5) for i, t in enumerate(plain)]
    docs += [(20, plain[0], None, None, None), (10, plain[0], "en", "a", 5), (21, None, "en", "a", 0), (22, "", "en", None, 0), (None, plain[1] + " more", None, "b", None)]
    docs += [(30, "so far " + item.upper() + " and on", "en", "a", 9), (31, "long " + " ".join(f"q{j}" for j in range(100_000)), "en", "c", 9)]
    columns, _ = tables(spark, str(tmp_path), docs)
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[1:4]:  # the model of two labelled rows decides nothing here
        frame = corpus_pipeline.written(stage(spark, frame, str(tmp_path)), f"edges-{name}")
        assert frame.columns == columns
        kept[name] = [r.doc_id for r in frame.collect()]
    # copies go, a null id after any other, and null and empty texts are copies of each other
    assert sorted(kept["near_duplicates"]) == [10, 11, 12, 13, 14, 15, 21, 30, 31]
    assert sorted(kept["decontamination"]) == [10, 11, 12, 13, 14, 15, 21, 31]
    assert set(kept["mixing"]) <= set(kept["decontamination"])


def test_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert {f"op{i}_" for i in range(1, 11)} <= {k.split("_")[0] + "_" for k in found} and "pipeline" in found
    assert set(e.oracle_sql()) <= set(found)
