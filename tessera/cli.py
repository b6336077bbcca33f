"""Command line: build an index, ask a question."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tessera.config import Config
from tessera.models import HashingEmbedder, HttpChat, HttpEmbedder, StubChat


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--config", help="JSON file with settings")
    p.add_argument("--master", help="Spark master, where spark-submit doesn't set it")
    sub = p.add_subparsers(dest="command")
    b = sub.add_parser("add-context", aliases=["build"], help="build or update the index")
    b.add_argument("--sources", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--shards", type=int)
    b.add_argument("--pattern", default="*")
    q = sub.add_parser("question", aliases=["query"], help="ask the index")
    q.add_argument("text")
    q.add_argument("--out")
    q.add_argument("--index-table")
    q.add_argument("--index-path")
    q.add_argument("--top-k", type=int, dest="top_k")
    for x in (b, q):
        x.add_argument("--embed-model", dest="embed_model", help="a server's model; without it words are hashed")
        x.add_argument("--dim", type=int, default=64)
    q.add_argument("--chat-model", dest="chat_model")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        said = input("1: build the index\n2: ask a question\n> ").strip()
        if said not in ("1", "2"):
            p.print_usage()
            return 1
        out = input("store: ").strip()
        argv = ["add-context", "--sources", input("sources: ").strip(), "--out", out] if said == "1" else ["question", input("question: ").strip(), "--out", out]
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if not a.command:
        p.print_usage()
        return 1
    names = ("embed_model", "chat_model", "top_k", "shards")
    c = Config.load(a.config, **{n: getattr(a, n, None) for n in names})
    embedder = HashingEmbedder(a.dim) if c.embed_model == "hashing" else HttpEmbedder(c.embed_model, a.dim)
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    c.export(spark)
    if a.command in ("add-context", "build"):
        if "://" not in a.out:
            Path(a.out).mkdir(parents=True, exist_ok=True)
        if "://" not in a.sources:
            Path(a.sources).mkdir(parents=True, exist_ok=True)
        from tessera.plans.build import build

        print(build(spark, a.sources, a.out, embedder, c, a.pattern))
        return 0
    from tessera.plans.query import answer, load_index

    try:
        index = load_index(spark, a.index_table, a.index_path, a.out, c)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    chat = StubChat() if c.chat_model == "stub" else HttpChat(c.chat_model, c)
    try:
        found = answer(spark, index, a.text, embedder, chat, c)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 3
    print(found["context"], found["answer"], sep="\n\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
