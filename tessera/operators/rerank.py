"""Greedy re-rankers of one question's hits: order matters, lists are short (tens of hits)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "question string, source string, chunk_id int, score double, text string"


def _ordered(rows):
    return sorted(rows.to_pylist(), key=lambda r: (-r["score"], r["source"], r["chunk_id"]))


def _each(hits: DataFrame, choose) -> DataFrame:
    """Run choose(ordered hits) for each question; adds pos, the place in its answer."""

    def run(rows):
        import pyarrow as pa

        schema = pa.schema([("question", pa.string()), ("source", pa.string()), ("chunk_id", pa.int32()), ("score", pa.float64()), ("text", pa.string()), ("pos", pa.int32())])
        return pa.Table.from_pylist([r | {"pos": i} for i, r in enumerate(choose(_ordered(rows)))], schema=schema)

    return hits.select(*(c.split()[0] for c in HITS.split(", "))).groupBy("question").applyInArrow(run, HITS + ", pos int")


def cap_per_doc(hits: DataFrame, per_doc: int = 2, per_page: int = 1, page: int = 1000) -> DataFrame:
    """In rank order, at most per_doc hits of a source and per_page of `page` chunks; a rejected hit uses nothing up."""

    def choose(rows):
        docs, pages, out = {}, {}, []
        for r in rows:
            d, p = r["source"], (r["source"], r["chunk_id"] // page)
            if docs.get(d, 0) < per_doc and pages.get(p, 0) < per_page:
                docs[d], pages[p] = docs.get(d, 0) + 1, pages.get(p, 0) + 1
                out.append(r)
        return out

    return _each(hits, choose)


def word_similarity(a: str, b: str) -> float:
    x, y = (set(re.split(r"[^a-zA-Z0-9_]+", t.lower())) for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def mmr(hits: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: score against the greatest word overlap with what is chosen already."""

    def choose(rows):
        rows, out = list(rows), []
        while rows and len(out) < k:
            gain = [weight * r["score"] - (1 - weight) * max((word_similarity(r["text"], s["text"]) for s in out), default=0.0) for r in rows]
            best = rows[gain.index(max(gain))]
            out.append(best)
            rows = [r for r in rows if (r["source"], r["chunk_id"]) != (best["source"], best["chunk_id"])]
        return out

    return _each(hits, choose)


def pack(hits: DataFrame, budget: int) -> DataFrame:
    """In rank order, hits whose texts (and 2 characters each) fit the budget; those that don't are passed over."""

    def choose(rows):
        used, out = 0, []
        for r in rows:
            if used + len(r["text"]) + 2 <= budget:
                used += len(r["text"]) + 2
                out.append(r)
        return out

    return _each(hits, choose)


def boosted(hits: DataFrame) -> DataFrame:
    from tessera.functions.text import section_boost

    return hits.withColumn("score", F.col("score") + section_boost(F.col("text")))
