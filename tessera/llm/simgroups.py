"""Groups at an exact set similarity of shingle sets: SimHash by pigeonring, then MinHash for the rest, exact Jaccard of what they find.

The sets hold different shingles; how often one is repeated doesn't count. Each set has op5's fingerprint,
and those at most two bits apart, which op5's pigeonring filter finds all, are the first candidates.
Similarity down to the radius goes further than two bits (right at 0.8 some ten of 64 differ, where no
filter of fingerprints is selective), so the sets that they leave apart are looked up by MinHashes,
ROWS to a key: sets of the Jaccard similarity s share a key with the chance s ** ROWS, and there
are as many keys as reach `recall` for pairs right at the radius, and more for nearer ones. Nothing is
linked by fingerprints or keys alone: each link has the exact Jaccard similarity of its two sets behind it.

Every two members of a key's bucket are compared unless they are in one group already. Two rounds of
comparisons with one member (linear in the bucket; the one that shares most keys with others, as the
text that others were made from does) put dense groups together. In the buckets that still hold several
groups all pairs of blocks are compared, each pair of blocks in a place of its own with the shingle
sets beside it, so that a bucket of any size is whole, spreads over tasks and makes rows only of links.
Two sets that share several keys meet there once. Pairs whose MinHashes agree five standard deviations
less than those of pairs at the radius need no exact comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tidy, utf8, written
from .components import components
from .simhash import fingerprint, shingle_hashes
from .simhash import links as ring_links

ROWS = 5
#: Members and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(shingle_hashes(text, k))


def tables_for(similarity: float, recall: float) -> int:
    """Keys by which pairs right at that similarity meet with the chance `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 0.999) ** ROWS)))


def minhashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n seeded mixtures of the hashes; of none: the largest number."""
    rng = np.random.default_rng(1000)
    a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    a |= np.uint64(1)
    least = np.full(n, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[i : i + 2048, None] * a + b).min(0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each ROWS MinHashes."""
    rows = least.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def similar(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, keep): a row for each different (id, text) of docs; keep is true for one of each group, the smallest id.

    rid is xxhash64(id, text), text null as "". Null and wordless texts are copies of each other. Repeated
    rows share a rid. An empty table gives no rows; other columns are not read.
    """
    tables = tables_for(similarity, recall)

    def prints(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                nodes, fps, keys, briefs = [], [], [], []
                for t in utf8(part.column(2)):
                    s = shingle_set(t, shingle_words)
                    least = minhashes(s, tables * ROWS)
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                    fps.append(fingerprint(s))
                    keys.append(band_keys(least))
                    briefs.append(least.astype(np.uint8).tobytes())
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), flat)
                hashes = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *hashes, found, pa.array(briefs, pa.binary())], names=["doc_id", "rid", "node", "fp", "keys", "brief"])

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_id(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    d = written(t.mapInArrow(tidy(prints), "doc_id long, rid long, node long, fp long, keys array<long>, brief binary"), "minhashes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    nodes = written(d.groupBy("node").agg(F.first(F.struct("fp", "keys", "brief")).alias("x"), least).select("node", "x.*", "least"), "sets")
    roots = components(_links(nodes, t, similarity, shingle_words, by_fingerprint(nodes.select("node", "fp"))))
    of = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = of.groupBy("root").agg(F.min("least").alias("first"))
    kept = of.join(first, "root").select("node", F.col("first.rid").alias("first"))
    return d.select("rid", "node").distinct().join(kept, "node").select("rid", (F.col("rid") == F.col("first")).alias("keep"))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(node, fp) -> (u, v): as many pairs as connect all sets whose fingerprints the pigeonring filter links, or are equal."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    same = nodes.join(least, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    a, b = (least.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x)) for x in "uv")
    near = ring_links(least.select("fp")).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v")).distinct()
    return written(same.unionByName(near.join(a, "fp_u").join(b, "fp_v").select("u", "v")).where("u <> v"), "near")


def _links(nodes: DataFrame, texts: DataFrame, similarity: float, shingle_words: int, near: DataFrame | None = None) -> DataFrame:
    """(u, v): similar sets, as many pairs as connect each group. near: pairs (u, v) that are compared first."""

    def shingles(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sets = [shingle_set(t, shingle_words).view(np.int64) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles_n", "shingles"])

    rows = nodes.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    several = written(rows.join(shared, "key"), "buckets")
    degree = several.groupBy("node").agg(F.sum("n").alias("degree"))
    near = texts.sparkSession.createDataFrame([], "u long, v long") if near is None else near
    some = degree.select("node").unionByName(near.select(F.explode(F.array("u", "v")).alias("node")))
    chosen = nodes.select("node", F.col("least.rid").alias("rid")).join(some, "node", "left_semi")
    found = texts.select("rid", "text").join(chosen, "rid").dropDuplicates(["node"]).select("node", "text")
    sets = written(found.mapInArrow(tidy(shingles), "node long, shingles_n int, shingles array<long>"), "shingles")

    links = written(exact(near, sets, similarity), "links")
    buckets = several_groups(several.drop("n").join(degree, "node"), links)
    first = buckets.where("root <> pivot.root").groupBy("node").agg(F.max("pivot").alias("pivot"))
    links = links.unionByName(written(exact(first.select(F.col("node").alias("u"), F.col("pivot.node").alias("v")), sets, similarity), "links"))
    buckets = several_groups(buckets.select("key", "node", "degree"), links)
    pairs = buckets.where("root <> pivot.root").select(F.col("node").alias("u"), F.col("pivot.node").alias("v")).distinct()
    links = links.unionByName(written(exact(pairs, sets, similarity), "links"))
    buckets = several_groups(buckets.where("n > 2").select("key", "node", "degree"), links).select("key", "node", "root")
    return links.unionByName(written(block_links(buckets, nodes.select("node", "keys", "brief").join(sets, "node"), similarity), "links"))


def several_groups(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, degree) -> these, its group's root, the bucket's pivot (degree, node, root) and size n; of buckets with several groups."""
    b = buckets.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    s = b.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.max(F.struct("degree", "node", "root")).alias("pivot"), F.count("*").alias("n"))
    return written(b.join(s.where("a <> z").select("key", "pivot", "n"), "key"), "several")


def exact(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have that Jaccard similarity or more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    # i / (a + b - i) >= s
    both, need = F.size(F.array_intersect("of_u", "of_v")), (F.size("of_u") + F.size("of_v")) * (similarity / (1 + similarity))
    return pairs.join(a, "u").join(b, "v").where(both >= need - 1e-9).select("u", "v")


class Block:
    """Members of one or two blocks of a bucket: links among those of different groups."""

    def __init__(self, table, similarity: float):
        self.key, self.similarity = table["key"][0].as_py(), similarity
        self.node, self.root, self.mine = (table[c].to_numpy() for c in ("node", "root", "mine"))
        self.brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(self.node), -1)
        lists = table["shingles"].combine_chunks()
        self.at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        #: shingles as places in a list of all that are here
        self.place = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
        self.here = np.zeros(int(self.place.max(initial=-1)) + 1, bool)
        n = self.brief.shape[1]
        self.least = n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity))

    def links(self) -> Iterator[tuple[int, int]]:
        first, last = self.mine[0], self.mine.max()
        one = (self.mine == first).all()
        left = np.arange(len(self.node)) if one else np.flatnonzero(self.mine == first)
        right = left if one else np.flatnonzero(self.mine == last)
        band = int(np.flatnonzero((self.keys == self.key).all(0))[0])
        size, root = np.diff(self.at), self.root.copy()
        for x in left.tolist():
            y = right[right > x] if one else right
            y = y[root[y] != root[x]]
            # those that agree in enough MinHashes, and share no key before this one, by which they meet elsewhere
            y = y[(self.brief[y] == self.brief[x]).sum(1, dtype=np.int32) >= self.least]
            y = y[~(self.keys[y, :band] == self.keys[x, :band]).any(1)]
            if not len(y):
                continue
            own = self.place[self.at[x] : self.at[x + 1]]
            self.here[own] = True
            ends = np.cumsum(size[y])
            flat = np.repeat(self.at[y] - ends + size[y], size[y]) + np.arange(ends[-1])
            both = np.diff(np.concatenate([[0], np.cumsum(self.here[self.place[flat]])[ends - 1]]))
            self.here[own] = False
            for v in y[both >= (size[y] + len(own)) * (self.similarity / (1 + self.similarity)) - 1e-9].tolist():
                if root[v] != root[x]:
                    root[root == root[v]] = root[x]
                    yield int(self.node[x]), int(self.node[v])


def block_links(buckets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node, root), (node, keys, brief, shingles_n, shingles) -> (u, v): links that connect all similar members of a key's bucket."""

    def compare(batches: Iterator) -> Iterator:
        """Rows in order of key, i, j: each run is a pair of blocks; the last of a batch may go on in the next."""
        import pyarrow as pa

        def work(t) -> pa.RecordBatch:
            found = list(Block(t, similarity).links()) or [(0, 0)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

        left: list = []
        at = None
        for b in batches:
            t = pa.Table.from_batches([b])
            place = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), t.num_rows] if t.num_rows else []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if left and tuple(place[:, a]) != at:
                    yield work(pa.concat_tables(left).combine_chunks())
                    left = []
                left.append(t.slice(a, z - a))
                at = tuple(place[:, a])
        if left:
            yield work(pa.concat_tables(left).combine_chunks())

    light = buckets.join(nodes.select("node", "shingles_n"), "node")
    size = light.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("shingles_n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    b = buckets.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    b = b.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root").join(nodes.drop("shingles_n"), "node")
    return b.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine").mapInArrow(tidy(compare), "u long, v long").where("u <> v")


def row_id(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, one of each group of similar ones (the smallest id; of repeated rows one)."""
    kept = similar(docs, similarity, shingle_words, id_col=id_col, text_col=text_col).where("keep").select(F.col("rid").alias("_rid"))
    rows = docs.select(row_id(id_col, text_col).alias("_rid"), F.struct(*docs.columns).alias("_row"))
    return rows.join(written(kept.distinct(), "kept"), "_rid", "left_semi").dropDuplicates(["_rid"]).select("_row.*")
