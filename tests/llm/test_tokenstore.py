from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokenstore as S

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \t\n", "a<|endoftext|>b <|ENDOFTEXT|> c", "Éa! été, ÀÉÎ?? it's IT'S don't'll", "12½ ⅷ 日本語 \U0001f600 ﬁ İ ΑΣ", "x" * 20_000, "各 각 é́ .", "café  naïve x\x1cy"]


def rows():
    long = " ".join(f"word{i % 997} Thing{i % 13}," for i in range(30_000))
    return [*((i, t) for i, t in enumerate(ODD)), (50, long), (51, long), (51, "same id"), (51, "same id"), (None, "no id"), (49, long[1000:])]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, key string")
    store = S.write_store(docs, PATH)
    tk, true = Tokenizer.from_file(PATH), {}
    for i, t in rows():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        true.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    got = sorted(S.read_back(store).collect(), key=lambda r: r.start)
    assert len(got) == len(rows()) and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:]) and got[0].doc_id is None
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [x[:2] for x in true[r.doc_id]]
        at += r.n_tokens
    assert all(r.ids in [x[2] for x in true[r.doc_id]] for r in S.read_ids(store).collect())
    assert S.verify(store).count() == 0
    chunks = store.chunks()
    assert chunks.count() == chunks.select("key").distinct().count()
    # the long text is there three times, its chunks about once
    assert chunks.selectExpr("sum(length(payload))").first()[0] < 1.5 * store.width * max(x[0] for x in true[50])


def test_damage_is_found(spark):
    store = S.write_store(spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string"), PATH)
    c = store.chunks().collect()
    bad = spark.createDataFrame([(r.key, bytes(r.payload[:-1]) + b"\x01", "chunk") for r in c], "key binary, payload binary, kind string")
    bad.write.mode("append").partitionBy("kind").parquet(f"{store.root}/objects2")
    broken = S.Store(spark, store.root, store.width)
    broken.chunks = lambda: spark.read.schema("key binary, payload binary").parquet(f"{store.root}/objects2/kind=chunk")
    with pytest.raises(Exception, match="damaged chunks"):
        S.read_back(broken).collect()


def test_empty_table(spark):
    store = S.write_store(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert S.read_back(store).count() == 0


def test_cuts():
    ids = np.random.default_rng(1).integers(0, 40_000, 20_000)
    for bounds in ([0, 20_000], [0, 5, 40, 9_000, 20_000]):
        for (a, z), ends in zip(zip(bounds, bounds[1:]), S.cut(ids, bounds)):
            sizes = np.diff([0, *ends])
            assert ends[-1] == z - a and sizes.max() <= S.MOST and (sizes[:-1] >= S.LEAST).all()
    # a shift of the stream moves few cuts
    one, two = S.cut(ids, [0, 20_000])[0], S.cut(ids[7:], [0, 19_993])[0]
    assert len({x - 7 for x in one} & set(two)) > 0.9 * len(one)


def test_crc_of_parts():
    t, data = S._shift_tables(), np.random.default_rng(2).integers(0, 2**32, 500, dtype=np.uint32)
    a, b = data[:123].tobytes(), data[123:].tobytes()
    joined = S._apply(np.array([zlib.crc32(a)], np.uint32), t[[len(b) // 4]]) ^ np.uint32(zlib.crc32(b))
    assert int(joined[0]) == zlib.crc32(a + b)


def test_merkle_depends_on_order_and_count():
    x = [bytes([i]) for i in range(7)]
    roots = {S.merkle(x), S.merkle(x[::-1]), S.merkle(x[:6]), S.merkle([]), S.merkle(x + [b"\0"])}
    assert len(roots) == 5


@pytest.mark.parametrize("damage", ["none", "a lost row", "tokens", "tokens of both", "start", "another recipe of that root"])
def test_damaged_recipes_are_found(spark, tmp_path, damage):
    docs = [(1, "some words"), (2, "other words here"), (3, "some words"), (4, "last")]
    store = S.write_store(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH)
    rows = [r.asDict() for r in spark.read.schema(S.RECIPES).parquet(f"{store.root}/recipes").collect()]
    part = next(r["part"] for r in rows if r["doc_id"] == 3)
    r, told = next(r for r in rows if r["doc_id"] == 3), next(r for r in rows if r["seq"] < 0 and r["part"] == part)
    if damage == "a lost row":
        rows.remove(r)
    elif damage.startswith("tokens"):
        r["n_tokens"] += 1
        if damage == "tokens of both":
            told["n_tokens"] += 1
            for x in rows:
                x["local_start"] += x["part"] == part and x["seq"] > r["seq"]
    elif damage == "start":
        r["local_start"] += 1
    elif damage == "another recipe of that root":
        r["recipe"] = next(x for x in rows if x["doc_id"] == 2)["recipe"]
    spark.createDataFrame([tuple(x[c.split()[0]] for c in S.RECIPES.split(", ")) for x in rows], S.RECIPES).write.parquet(f"file://{tmp_path}/recipes")
    broken = S.Store(spark, f"file://{tmp_path}", store.width)
    broken.chunks = store.chunks
    if damage == "none":
        assert sorted(S.read_back(broken).collect()) == sorted(S.read_back(store).collect())
    else:
        with pytest.raises(Exception, match="doesn't follow|not those of|is damaged"):
            S.read_back(broken).collect()
