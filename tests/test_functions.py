from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "normal"), [("a b", "a b"), ("a­b", "a b"), ("a͸b", "a b"), ("a  b", "a  b"), (" a\t\r\n b�c ", "a b c"), ("   ", ""), ("x\U0001f600y", "x\U0001f600y")])
def test_normalize(spark, raw, normal):
    assert one(spark, raw, T.normalize) == normal


def test_ratios_of_empty_text(spark):
    assert one(spark, "", T.alpha_ratio) == 0 and one(spark, "", T.symbol_share) == 1


@pytest.mark.parametrize(("text", "junk"), [("word " * 20, False), ("short", True), ("-- 12 --", True), ("1234567890" * 10, True), ("$" * 100, True)])
def test_junk(spark, text, junk):
    assert one(spark, text, T.is_junk) is junk


def test_strict_junk(spark):
    assert one(spark, "12 34 56 seven 89 10 11 12 13 14 15 16 17 18 19 20", T.is_junk_strict)
    assert not one(spark, "these are words of a sentence that is long enough", T.is_junk_strict)


def test_title(spark):
    f = lambda raw, uri: spark.range(1).select(T.title(F.lit(raw), F.lit(uri)).alias("y")).first().y
    assert f("\n  \n First line \nsecond", "file:/a/b.txt") == "First line"
    assert f(" \n ", "file:/a/report.v2.pdf") == "report.v2"
    assert len(f("x" * 500, "u")) == 200


def test_references(spark):
    assert one(spark, " References\n...", T.is_references)
    assert one(spark, "see [1] [2] [3] 1999 2001, a, b, c, d, e, f", T.is_references)
    assert not one(spark, "see [1] [2] 1999 2001, a, b, c, d, e, f", T.is_references)


def test_word_set_and_jaccard(spark):
    assert one(spark, "A a b.", T.word_set) == ["a", "b"]
    r = spark.range(1).select(T.jaccard(T.word_set(F.lit("a b")), T.word_set(F.lit("b c"))).alias("y")).first().y
    assert r == pytest.approx(1 / 3)


def test_ids(spark):
    import hashlib

    assert one(spark, "u", ids.doc_id) == hashlib.sha256(b"u").hexdigest()
    r = spark.range(1).select(ids.chunk_id(F.lit("d"), F.lit(1), F.lit(2), F.lit("h")).alias("y")).first().y
    assert r == hashlib.sha256(b"d:1:2:h").hexdigest()
    import xxhash

    for k in ("u", "", "é" * 40):
        h = xxhash.xxh64_intdigest(k.encode(), seed=42)
        assert one(spark, k, lambda c: ids.shard(c, 60)) == (h - (h >> 63 << 64)) % 60
    assert one(spark, "/root/a/b.txt", lambda c: ids.relative_uri(c, "/root")) == "a/b.txt"


def test_vector_edges(spark):
    df = spark.createDataFrame([(None, [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 9.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r.y, 9) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("y")).collect()] == [0, 0, 1, 1]
    assert [r.y for r in df.select(V.l2_normalize(F.col("a")).alias("y")).collect()][1] == [0, 0]
    bad = spark.createDataFrame([(None,), ([],), ([math.nan],), ([math.inf],), ([None],), ([1.0],)], "a array<double>")
    assert [r.y for r in bad.select(V.is_valid(F.col("a")).alias("y")).collect()] == [False] * 5 + [True]
    assert spark.range(1).select(V.analogy(F.array(F.lit(5.0)), F.array(F.lit(2.0)), F.array(F.lit(1.0))).alias("y")).first().y == [4.0]
