"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits, one vote per word shingle. The fingerprint is cut into m segments in a ring. If
two fingerprints differ in at most t bits, then from some segment on every chain of l consecutive
segments (l = 1 .. m) differs in at most l * t / m bits: the proportional budgets. For t = 2 and m = 8
that is no bit in the first three segments and at most one in the four after them, so one half of those
four has none either: five segments (40 bits) are equal. These are the keys, one for each start and
half; candidates that share one must then hold the whole chain within its budgets before all bits
are counted.

Exact copies share a fingerprint and count once. Buckets of a key with many fingerprints are linked in
another exact way: fingerprints at most 2 bits apart meet where one bit or none of each is flipped,
so grouped minima over these flips link them without a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8, written
from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENTS, WIDTH, DISTANCE = 8, 8, 2
#: Fingerprints of one bucket that are compared with each other; of larger buckets, flips are grouped.
PAIRED = 256


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; of the whole sequence, where it is shorter."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(k, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); null texts have no words and the fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [fingerprint(shingle_hashes(t, shingle_words)) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def keyed(fps: DataFrame) -> DataFrame:
    """fp -> (bucket, fp): 2 * SEGMENTS rows, one for each start of a chain and half of its segments 4 to 7."""
    keys = []
    for i in range(SEGMENTS):
        turn = WIDTH * i
        r = F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        three, four = F.shiftrightunsigned(r, 40), F.shiftrightunsigned(r, 24).bitwiseAND(F.lit(0xFFFF))
        six = F.shiftrightunsigned(r, 8).bitwiseAND(F.lit(0xFFFF))
        for half, rest in enumerate((four, six)):
            keys.append(F.shiftleft(F.lit(2 * i + half).cast("long"), 40).bitwiseOR(F.shiftleft(three, 16)).bitwiseOR(rest))
    return fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def within_budgets(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chains of the differing bits, from segment `start` on, keep to l * DISTANCE / SEGMENTS."""
    turn = (start * WIDTH).astype(np.uint64)
    r = (diff << turn) | (diff >> ((np.uint64(64) - turn) & np.uint64(63)))
    ok = np.ones(len(diff), bool)
    for length in range(1, SEGMENTS + 1):
        ok &= np.bitwise_count(r >> np.uint64(64 - WIDTH * length)) <= length * DISTANCE // SEGMENTS
    return ok


def _bucket_links(bucket: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in a bucket: each fingerprint with its tree's first one."""
    n = len(fps)
    i, j = np.triu_indices(n, 1)
    diff = fps[i] ^ fps[j]
    ok = within_budgets(diff, np.full(len(diff), bucket >> 41))
    ok[ok] = np.bitwise_count(diff[ok]) <= DISTANCE
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in range(n) if find(x) != x]


def _link_buckets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        lists = b.column(1)
        at = lists.offsets.to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        u, v = [], []
        for bucket, x, y in zip(b.column(0).to_pylist(), (at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
            fps = np.sort(flat[x:y].view(np.int64)).view(np.uint64)
            for a, c in _bucket_links(bucket, fps):
                u.append(fps[a])
                v.append(fps[c])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(z, np.uint64).view(np.int64)) for z in (u, v)], names=["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints at most DISTANCE bits apart, enough to connect all that are linked."""
    k = keyed(fps)
    large = written(k.groupBy("bucket").count().where(F.col("count") > PAIRED).select("bucket"), "large")
    small = k.join(large, "bucket", "left_anti").groupBy("bucket").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = small.mapInArrow(_link_buckets, "u long, v long")
    # All fingerprints of a large bucket: those within 2 bits share a flip of one bit or none.
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)))
    many = k.join(large, "bucket", "left_semi").select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    least = many.groupBy("flip").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("flip", "v")
    return pairs.unionByName(many.join(least, "flip").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, for every row.

    Rows with equal or linked fingerprints share a component; null and wordless texts share the
    fingerprint 0. Repeated rows stay; null ids never name a component unless they are alone in one.
    An empty table gives no rows; other columns are not read.
    """
    d = written(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    fps = written(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    of = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return d.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_pigeonring_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
