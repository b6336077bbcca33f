from __future__ import annotations

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import warc
from tessera.llm import wordpiece as W
from tessera.llm.common import Words


def greedy(word, first, rest):
    at = n = 0
    while at < len(word):
        pieces = first if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def counted(a, words):
    w = Words([" ".join(words).encode()])
    return a.counts(w, np.frombuffer(" ".join(words).encode() + b" ", np.uint8)).tolist()


def test_automaton_against_greedy_matching():
    rng = random.Random(1)
    for _ in range(30):
        make = lambda: {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15))}
        first, rest = make(), make()
        a = W.Automaton(list(first), list(rest))
        words = ["".join(rng.choice("abéc") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
        assert counted(a, words) == [greedy(w, first, rest) for w in words]


def test_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    first, rest = map(set, W.sentencepiece_vocabulary(path))
    texts = [(1, "Hello world, internationalisation"), (2, None), (3, ""), (4, "日本語 ÿ x " * 3), (4, "z" * 5000), (None, "a"), (5, "the " * 100_000)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id long, text string, n_words string")
    got = sorted(map(tuple, W.count_tokens(docs, path).collect()), key=str)
    want = [(i, len((t or "").encode().split()), sum(greedy(w.decode(), first, rest) for w in (t or "").encode().split())) for i, t in texts]
    assert got == sorted(want, key=str)
    assert W.count_tokens(docs.where("doc_id > 9"), path).count() == 0


def pages():
    rng = random.Random(2)
    out = [(i, f"http://h/{i}", "<p>" + "x" * rng.randrange(2000) + f"{rng.randrange(30)}") for i in range(300)]
    out += [(1000 + i, "u", "same page") for i in range(50)] + [(2000, None, None), (2001, "u\r\nX: y", ""), (2002, "u", "é\r\n\r\nWARC/1.1\r\n"), (2003, "u", "z" * 3_000_000), (None, "u", "no id"), (3000, "u", "twice"), (3000, "u", "twice")]
    return out


@pytest.mark.parametrize("least", [0, 100])
def test_archive(spark, least):
    data = pages()
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, frame int").repartition(3)
    a = warc.write_archive(df, least_bytes=least)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(a).collect())
    groups = collections.defaultdict(list)
    for i, _, t in data:
        groups[t or ""].append(i)
    want = collections.Counter()
    for i, _, t in data:
        b = (t or "").encode()
        top = max((x for x in groups[t or ""] if x is not None), default=None)
        revisit = len(b) >= least and len(groups[t or ""]) > 1 and i != top
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == want


def test_single_record_and_seek_table(spark):
    a = warc.write_archive(spark.createDataFrame(pages(), "page_id long, url string, html string"))
    r = a.index().where("page_id = 2003").first()
    fields, block = a.lookup(r.record_id)
    assert fields["X-Page-ID"] == "2003" and len(block) == 3_000_000
    where, path = warc._filesystem(f"{a.root}/bundles")
    data = where.open_input_file(f"{path}/{r.bundle}").read()
    table = warc.seek_table(data)
    assert table[r.frame][:2] == (r.frame_start, r.frame_size) and sum(x[1] for x in table) < len(data)
    import zstandard

    plain = b"".join(zstandard.ZstdDecompressor().decompress(data[s : s + n]) for s, n, _ in table)
    assert len(plain) == sum(x[2] for x in table) and plain.startswith(b"WARC/1.1")


def test_empty_archive(spark):
    a = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archive(a).count() == 0
