"""Token ids in a content-addressed store.

Layout, all Parquet, under one root in shared storage:

* objects/kind=chunk: key (16-byte BLAKE2b of the payload), payload (ids, little-endian, `width` bytes
  each). A rolling hash over the ids cuts each document's stream where 8 consecutive ids say so, so that
  equal passages make equal chunks wherever they stand. Each chunk is there once.
* objects/kind=doc: a document's recipe, the keys of its chunks in order; read again to make
* recipes: rows in ascending doc_id order: doc_id, part, seq, local_start, n_tokens, recipe, root
  (Merkle root over the chunk keys). The row with seq = -1 is a part's manifest: its tokens, its
  documents and the Merkle root over its documents' roots.

Ids are encoded once, chunks shuffled once (by key). Documents with equal recipes are looked up once.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rolling, Words, mix, shared_dir, slices, table, tidy, utf8

KEY, END_ID = 16, 2
#: Half the words whose ids a worker keeps, and chunk keys that a task remembers, at most.
CACHED_WORDS, CACHED_KEYS = 200_000, 200_000
#: Words with their case and punctuation that a worker keeps, as arrays.
TABLE_WORDS = 1_000_000
WINDOW, MASK, LEAST, MOST = 8, 255, 32, 2048


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY).digest()


class Merkle:
    """A Merkle root over leaves that come one at a time, in memory of the tree's height."""

    def __init__(self):
        self.levels: list[bytes | None] = []
        self.count = 0

    def add(self, leaf: bytes) -> None:
        self.count += 1
        node = digest(b"\0" + leaf)
        for i, other in enumerate(self.levels):
            if other is None:
                self.levels[i] = node
                return
            node, self.levels[i] = digest(b"\1" + other + node), None
        self.levels.append(node)

    def root(self) -> bytes:
        node = None
        for other in self.levels:
            if other is not None:
                node = other if node is None else digest(b"\1" + other + node)
        return digest(struct.pack("<q", self.count) + (node or b""))


def merkle(leaves: list[bytes]) -> bytes:
    m = Merkle()
    for x in leaves:
        m.add(x)
    return m.root()


class Encoder:
    """Ids of texts by the tokenizers library.

    Neither normalisation nor pre-tokenisation of the vocabulary file looks across white space, so a
    text's ids are those of its words in a row. Each different word of a batch is looked up once. Where
    the file also lower-cases and parts letters from other characters (LETTERS), what is kept is words
    without case and without the punctuation after them.
    """

    #: Fixed value: the pre-tokeniser's pattern that this holds for.
    LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: ASCII punctuation but the apostrophe.
    TAIL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.table = Table.empty(self.dtype)
        told = json.loads(self.tokenizer.to_str())
        kinds = {x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])}
        parts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.parted = "Lowercase" in kinds <= {"NFC", "Replace", "Lowercase"} and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": self.LETTERS}

    def _other(self, word: bytes, core: bytes) -> bytes:
        """Of a word that isn't ASCII letters and punctuation: its letters, where they are of another Latin alphabet, else all of it."""
        if not self.parted or not core:
            return word
        seen = core.decode()  # within Latin, all agree on what a letter is
        return core.lower() if seen.isalpha() and max(seen) < "\u0250" else word

    def _learn(self, keys: list[bytes]) -> None:
        """Ids of new keys: plain letters go to the model, of others many together, told apart by their tokens' offsets."""
        plain = [k for k in keys if self.parted and k.isalpha()]
        for k in plain:
            ids = [t.id for t in self.model.tokenize(k.decode())]
            self.known[k] = struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)
        rest = list(set(keys).difference(plain))
        for i in range(0, len(rest), 4000):
            part = [w.decode() for w in rest[i : i + 4000]]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            at = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            cuts = (np.concatenate([[0], np.searchsorted(at, begin)]) * self.width).tolist()
            data = np.array(got.ids, self.dtype).tobytes()
            self.known.update(zip(rest[i : i + 4000], [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of self.dtype."""
        if len(self.known) > CACHED_WORDS:  # words that come again are taken over from the older half
            self.known, self.older = {}, self.known
        known, parts, new = self.known, [], set()
        for w in words:  # letters, ASCII ones in lower case, and the punctuation after them
            core = w.rstrip(self.TAIL)
            key = core.lower() if self.parted and core.isalpha() else self._other(w, core)
            tail = w[len(key) :]
            parts.append((key, tail))
            if key not in known:
                new.add(key)
            if tail and tail not in known:
                new.add(tail)
        back = [k for k in new if k in self.older]
        known.update(zip(back, map(self.older.__getitem__, back), strict=True))
        self._learn(list(new.difference(back)))
        return [known[a] + known[b] if b else known[a] for a, b in parts]

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Each text's ids and the end id, as bytes of self.dtype."""
        w = Words(texts)
        order = np.argsort(w.hash)
        new = np.concatenate([[True], np.diff(w.hash[order]) > 0])[: len(order)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        size = w.ends - w.starts
        head = np.ndarray((len(w.joined) - 7,), np.dtype("<u8"), w.joined, strides=(1,))[w.starts]
        head = np.where(size < 8, 0, head)
        if (size[first][which] != size).any() or (head[first][which] != head).any():  # a hash that two words share
            first, which = order, np.empty(len(order), np.int64)
            which[order] = np.arange(len(order))
        # Words of earlier batches are found by hash, size and first bytes; the others are looked up and added.
        t, h, size, head = self.table, w.hash[first], size[first], head[first]
        at = np.minimum(np.searchsorted(t.hash, h), len(t.hash) - 1)
        hit = (t.hash[at] == h) & (t.size[at] == size) & (t.head[at] == head)
        miss = np.flatnonzero(~hit)
        got = self.words([w.joined[x:y] for x, y in zip(w.starts[first[miss]].tolist(), w.ends[first[miss]].tolist(), strict=True)])
        n_new = np.fromiter(map(len, got), np.int64, len(got)) // self.width
        flat = np.concatenate([t.flat, np.frombuffer(b"".join(got), self.dtype)])
        begin, n = t.begin[at].astype(np.int64), t.n[at].astype(np.int64)
        begin[miss], n[miss] = len(t.flat) + np.cumsum(n_new) - n_new, n_new
        self._remember(Table(h, size, head, begin, n, flat), miss)
        n_of = n[which]
        upto = np.concatenate([[0], np.cumsum(n_of)])
        ids = flat[np.repeat(begin[which] - upto[:-1], n_of) + np.arange(upto[-1])].tobytes()
        cuts, end = (upto[w.bounds] * self.width).tolist(), np.array([end_id], self.dtype).tobytes()
        return [ids[a:b] + end for a, b in zip(cuts, cuts[1:], strict=False)]

    def _remember(self, batch: Table, new: np.ndarray) -> None:
        """Add a batch's new words to the table; one that is full starts again with them."""
        t = self.table
        if len(t.hash) + len(new) > TABLE_WORDS:
            t = Table.empty(self.dtype)
            n = batch.n[new]
            flat = batch.flat[np.repeat(batch.begin[new] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            batch = Table(batch.hash, batch.size, batch.head, batch.begin.copy(), batch.n, np.concatenate([t.flat, flat]))
            batch.begin[new] = np.cumsum(n) - n + len(t.flat)
        order = np.argsort(np.concatenate([t.hash, batch.hash[new]]), kind="stable")
        self.table = Table(*(np.concatenate([x, y[new].astype(x.dtype)])[order] for x, y in zip(t.columns(), batch.columns(), strict=True)), batch.flat)


@dataclass
class Table:
    """Words by hash, with size and first 8 bytes (0 for shorter ones), and where in flat their ids are."""

    hash: np.ndarray
    size: np.ndarray
    head: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    flat: np.ndarray

    @classmethod
    def empty(cls, dtype: np.dtype) -> Table:
        """One entry that no word has (size 0), so that a look-up always finds some."""
        one = np.zeros(1, np.uint32)
        return cls(np.full(1, 2**64 - 1, np.uint64), one, np.zeros(1, np.uint64), one, one, np.zeros(0, dtype))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.hash, self.size, self.head, self.begin, self.n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """Ends of the chunks of each stream ids[bounds[i]:bounds[i + 1]]: where the rolling hash says so, LEAST to MOST ids apart."""
    marks = np.flatnonzero(Rolling(mix(ids.astype(np.uint64) + np.uint64(1)), 0x9E3779B97F4A7C15).runs(WINDOW) & np.uint64(MASK) == 0) + WINDOW
    at = np.searchsorted(marks, np.array(bounds) + LEAST).tolist()  # a window within the stream, as LEAST is longer
    to = np.searchsorted(marks, bounds).tolist()
    out = []
    for i, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
        ends, last = [], a
        for m in marks[at[i] : to[i + 1]].tolist():
            while m - last > MOST:
                last += MOST
                ends.append(last - a)
            if m - last >= LEAST:
                last = m
                ends.append(last - a)
        while z - last > MOST:
            last += MOST
            ends.append(last - a)
        out.append(ends + [z - a] if last < z else ends)
    return out


@dataclass
class Store:
    spark: SparkSession
    root: str
    width: int

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(OBJECTS).parquet(f"{self.root}/objects").where("kind = 'chunk'").select("key", "payload")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(RECIPES).parquet(f"{self.root}/recipes").where("seq >= 0")

    def manifest(self) -> DataFrame:
        """A row per part, in order: part, documents, tokens, start (tokens of the parts before), root."""
        m = self.spark.read.schema(RECIPES).parquet(f"{self.root}/recipes").where("seq < 0")
        before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        return m.select("part", F.col("local_start").alias("documents"), F.col("n_tokens").alias("tokens"), F.coalesce(before, F.lit(0)).cast("long").alias("start"), "root")


OBJECTS = "kind string, key binary, payload binary, doc_id long, n_tokens long"
RECIPES = "doc_id long, part int, seq long, local_start long, n_tokens long, recipe binary, root binary"


def write_store(docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encode every text (null: empty) with the end id after it, and write the store.

    Documents stand in ascending doc_id order, null first, those with one doc_id by their content;
    repeated rows are documents of their own. An empty table makes a store without documents.
    Other columns are not stored.
    """
    spark = docs.sparkSession
    root = root or shared_dir(spark, "tokens")
    width = encoder(tokenizer).width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e, seen = encoder(tokenizer), set()
        schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for i, j in slices(texts, 2 * SLICE_BYTES):
                rows: list[tuple] = []
                coded = e.encode(texts[i:j], end_id)
                bounds = np.cumsum([0, *map(len, coded)]) // e.width
                for doc_id, data, ends in zip(ids[i:j], coded, cut(np.frombuffer(b"".join(coded), e.dtype), bounds.tolist()), strict=True):
                    keys, last = [], 0
                    for x in ends:
                        payload, last = data[last * e.width : x * e.width], x
                        keys.append(key := digest(payload))
                        if key not in seen:
                            seen.add(key)
                            rows.append(("chunk", key, payload, None, None))
                    recipe = b"".join(keys)
                    rows.append(("doc", digest(struct.pack("<q", doc_id or 0) + recipe + b"\0" * (doc_id is None)), recipe, doc_id, last))
                if len(seen) > CACHED_KEYS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                del rows, coded

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    objects = d.mapInArrow(tidy(run), OBJECTS).groupBy("kind", "key", "doc_id", "n_tokens").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    objects.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{root}/objects")
    found = spark.read.schema(OBJECTS + ", copies long").parquet(f"{root}/objects").where("kind = 'doc'")
    rows = found.select("doc_id", "key", "n_tokens", F.col("payload").alias("recipe"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rows = rows.repartitionByRange("doc_id", "key", "copy").sortWithinPartitions("doc_id", "key", "copy")
    rows.select("doc_id", "n_tokens", "recipe", F.spark_partition_id().alias("part")).mapInArrow(_number, RECIPES).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/recipes")
    return Store(spark, root, width)


def split_keys(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + KEY] for i in range(0, len(recipe), KEY)]


def _number(batches: Iterator) -> Iterator:
    """Order within a part: seq, local_start and roots; at the end the part's manifest."""
    import pyarrow as pa

    seq, start, part, tree = 0, 0, None, Merkle()
    names = [c.split()[0] for c in RECIPES.split(", ")]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        part = b.column(3)[0].as_py()
        tokens = b.column(1).to_numpy(zero_copy_only=False)
        recipes = b.column(2).to_pylist()
        roots = [merkle(split_keys(r)) for r in recipes]
        for r in roots:
            tree.add(r)
        starts = start + np.concatenate([[0], np.cumsum(tokens)[:-1]])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3).cast(pa.int32()), pa.array(np.arange(seq, seq + n)), pa.array(starts.astype(np.int64)), b.column(1), b.column(2), pa.array(roots, pa.binary())], names=names)
        seq, start = seq + n, start + int(tokens.sum())
    if part is not None:
        last = [[None], [part], [-1], [seq], [start], [None], [tree.root()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(last, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=names)


def _shift_tables() -> np.ndarray:
    """t[n]: the 32 columns of the linear map that appending 4 * n zero bytes is to a CRC-32."""
    one = np.zeros(32, np.uint32)
    for bit in range(32):
        c = 1 << bit
        for _ in range(32):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[bit] = c
    t = np.zeros((MOST + 1, 32), np.uint32)
    t[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in range(1, MOST + 1):
        t[n] = _apply(t[n - 1], one)
    return t


def _apply(crc: np.ndarray, columns: np.ndarray) -> np.ndarray:
    bits = (crc[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(bits * columns, axis=1).astype(np.uint32)


def _check_chunks(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dtype = "<u2" if width == 2 else "<u4"
        for b in batches:
            keys, payloads = b.column(0).to_pylist(), b.column(1).to_pylist()
            if bad := [k.hex() for k, p in zip(keys, payloads, strict=True) if digest(p) != k]:
                raise ValueError(f"damaged chunks: {bad[:5]}")
            crcs = [zlib.crc32(p if width == 4 else np.frombuffer(p, dtype).astype("<u4").tobytes()) for p in payloads]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) // width for p in payloads], pa.int32()), pa.array(crcs, pa.int64())], names=["key", "n", "crc"])

    return run


def _combine(batches: Iterator) -> Iterator:
    """(root, recipe's chunks with length and CRC) -> the CRC of the whole, from those of its chunks."""
    import pyarrow as pa

    t = _shift_tables()
    for b in batches:
        found = b.column(1)
        offsets = found.offsets.to_numpy()
        flat = found.flatten()
        keys, n, crc = flat.field(1).to_pylist(), flat.field(2), flat.field(3)
        if n.null_count:
            raise ValueError("chunks are missing from the store")
        n, crc = n.to_numpy(zero_copy_only=False), crc.to_numpy(zero_copy_only=False).astype(np.uint32)
        size = np.diff(offsets)
        offsets = offsets[:-1] - offsets[0]
        for root, at, k in zip(b.column(0).to_pylist(), offsets.tolist(), size.tolist(), strict=True):
            if merkle(keys[at : at + k]) != root:
                raise ValueError(f"recipe {root.hex()} is damaged")
        total, tokens = np.zeros(len(size), np.uint32), np.zeros(len(size), np.int64)
        for step in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > step)
            at = offsets[live] + step
            total[live] = _apply(total[live], t[n[at]]) ^ crc[at]
            tokens[live] += n[at]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens), pa.array(total.astype(np.int64))], names=["root", "read_tokens", "ids_crc32"])


def _chunk_rows(recipes: DataFrame) -> DataFrame:
    """Each different recipe's chunks: root, pos, key."""
    key = F.transform(F.sequence(F.lit(0), (F.length("recipe") / KEY).cast("int") - 1), lambda i: F.substring("recipe", i * KEY + 1, F.lit(KEY)))
    return recipes.select("root", "recipe").distinct().select("root", F.posexplode(key).alias("pos", "key"))


def _check_part(key, rows):
    """The part, whose documents must stand in order without a gap and give its manifest's numbers and root."""
    import pyarrow as pa

    rows = rows.sort_by("seq")
    seq, start, tokens = (rows[c].to_numpy() for c in ("seq", "local_start", "n_tokens"))
    well = len(seq) > 0 and (seq == np.arange(-1, len(seq) - 1)).all()
    if well:
        tree, roots = Merkle(), rows["root"].to_pylist()
        for r in roots[1:]:
            tree.add(r)
        ends = np.cumsum(tokens[1:])
        well = roots[0] == tree.root() and start[0] == len(seq) - 1 and tokens[0] == tokens[1:].sum() and (start[1:] == ends - tokens[1:]).all()
    if not well:
        raise ValueError(f"part {key[0].as_py()} doesn't follow from its recipes")
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})


def read_back(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Every chunk's key, every recipe's root, every document's tokens and every part's manifest are checked.
    A document's CRC is put together from those of its chunks, so that no ids are shuffled. A part that is
    gone with its manifest leaves nothing to check it by.
    """
    recipes = store.recipes()
    chunks = store.chunks().mapInArrow(_check_chunks(store.width), "key binary, n int, crc long")
    whole = _chunk_rows(recipes).join(chunks, "key", "left").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("found"))
    crc = whole.mapInArrow(_combine, "root binary, read_tokens long, ids_crc32 long")
    start = (F.col("local_start") + F.col("p.start")).alias("start")
    rows = store.spark.read.schema(RECIPES).parquet(f"{store.root}/recipes").select("part", "seq", "local_start", "n_tokens", "root")
    parts = store.manifest().select("part", "start").join(rows.groupBy("part").applyInArrow(_check_part, "part int"), "part")
    out = recipes.select("doc_id", "part", "local_start", "n_tokens", "root").join(crc, "root").alias("r").join(parts.alias("p"), "part")
    read = F.when(F.col("read_tokens") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's tokens are not those of its chunks")).cast("long"))
    return out.select("doc_id", start, read.alias("n_tokens"), "ids_crc32")


def read_ids(store: Store) -> DataFrame:
    """doc_id, part, seq, ids (array<int>): the documents themselves, for readers of the store."""
    width = store.width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data = [np.frombuffer(b"".join(x["payload"] for x in found), "<u2" if width == 2 else "<u4").astype(np.int32) for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.list_(pa.int32()))], names=["root", "ids"])

    recipes = store.recipes()
    whole = _chunk_rows(recipes).join(store.chunks(), "key").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("found"))
    return recipes.select("doc_id", "part", "seq", "root").join(whole.mapInArrow(run, "root binary, ids array<int>"), "root").select("doc_id", "part", "seq", "ids")


def verify(store: Store) -> DataFrame:
    """The parts whose Merkle root, documents or tokens don't follow from their recipes; none is well.

    A part is read in one task; its size is a range partition's.
    """

    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("seq").to_pylist()
        told = [r for r in rows if r["seq"] < 0]
        docs = [r for r in rows if r["seq"] >= 0]
        tree = Merkle()
        for r in docs:
            tree.add(merkle(split_keys(r["recipe"])))
        well = len(told) == 1 and told[0]["root"] == tree.root() and told[0]["local_start"] == len(docs) and told[0]["n_tokens"] == sum(r["n_tokens"] for r in docs)
        return pa.table({"part": pa.array([] if well else [key[0].as_py()], pa.int32())})

    return store.spark.read.schema(RECIPES).parquet(f"{store.root}/recipes").groupBy("part").applyInArrow(run, "part int")


def op3_content_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return read_back(write_store(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))
