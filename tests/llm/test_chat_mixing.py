from __future__ import annotations

import random
from fractions import Fraction

import duckdb
import pytest

from tessera.llm import chat, mixing

CHAT = "conv_id long, turn long, role string, text string, copies int"


def run_chat(spark, data):
    df = spark.createDataFrame([(*r, 1) for r in data], CHAT)
    got = sorted(map(tuple, chat.format_conversations(df).select("conv_id", "copies", "n_turns", "rendered").collect()))
    con = duckdb.connect()
    con.register("t", df.toArrow())
    con.sql("CREATE VIEW conversations AS SELECT * FROM t")
    assert got == sorted(con.sql(chat.OP7_SQL).fetchall())
    return got


def test_snapshots_collapse(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    data = [(c, i, *t) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for i, t in enumerate(turns[:n])]
    data += [(5, 0, "user", "a"), (5, 1, "assistant", "other"), (6, 0, "user", "a"), (None, 0, "user", "a")]
    got = run_chat(spark, data)
    assert [(g[0], g[1], g[2]) for g in got] == [(2, 2, 4), (5, 1, 2)]
    assert got[1][3] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"


def test_chat_edges(spark):
    rng = random.Random(1)
    data = [(c, rng.choice([None, 0, 1, 1]), rng.choice(["user", None]), rng.choice(["x", "", None])) for c in range(40) for _ in range(rng.randrange(1, 5))]
    data += [(100, 0, "user", "long " * 50_000), (101, 0, "user", "long " * 50_000), (101, 1, "user", "more")]
    run_chat(spark, data)
    assert run_chat(spark, []) == []


def targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(w[s] for s in sizes if s not in full)
        new = {s for s in sizes if s not in full and Fraction(rest * w[s], open_) > most * sizes[s]}
        if not new:
            return {s: float(most * sizes[s]) if s in full else float(Fraction(rest * w[s], open_)) for s in sizes}
        full |= new


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    data = []
    for s, n in zip(["a", "b", "é", "Z", None, "zero", ""], [400, 20, 60, 3, 100, 5, 50], strict=True):
        data += [(len(data) + i, "w " * (0 if s == "zero" else rng.randrange(1, 80)), s) for i in range(n)]
    data += [(9000, None, "a"), (9001, "\t\n", "a"), (9002, "x y", "b"), (9002, "x y", "b"), (None, "q", "b")]
    docs = spark.createDataFrame([(i, t, s, 0, "u", None) for i, t, s in data], "doc_id long, text string, source string, size int, target string, repetitions int")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    true = targets(sizes)
    assert len(got) == len(data)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - true[s]) < 1e-6 and r.taken == r.size * r.repetitions and r.repetitions <= 3 for r in mine)
        assert abs(sum(r.taken for r in mine) - true[s]) <= 80
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.repetitions for r in got)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()
    assert (r["size"], r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
