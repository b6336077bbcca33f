"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact verification.

A document is contaminated by an item where some window of it is within `max_edits` (a share of the
item's words) word insertions, deletions and replacements of the item. The search, for each start of
a window and without any shuffle:

1. Lossless screen. With k edits at least n - 1 - 2k of the item's n - 1 word pairs survive in the
   window. Starts where too few pairs of any item's vocabulary lie ahead are passed over.
2. CGK random walk. A pointer walks over the words; step j writes the word under it and then stays
   or advances by a random bit of (j, word). Words at edit distance k come out at Hamming distance
   O(k^2) whatever their alignment. The walk of a window is a prefix of its start's walk.
3. Bit-sampling LSH. Each repetition has a walk of its own and hashes a few sampled steps to a key;
   equal keys of a window and an item make a candidate. Repetitions go on until `recall` is met.
4. Exact banded edit distance of the candidates.

Items go to the executors in blocks of at most BLOCK_ITEMS, each broadcast with that bound.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, table, tidy, utf8

MAX_EDITS, MIN_WORDS, BLOCK_ITEMS = 0.2, 8, 20_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int"
#: Not letters, digits or white space, within ASCII: these separate words, and case doesn't count.
_PUNCT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode().translate(_PUNCT)


def edit_distance(a: list, b: np.ndarray, most: int) -> int:
    """Edits that turn a into the best prefix of b, or most + 1 where it takes more."""
    n = len(a)
    m = min(len(b), n + most)
    row = list(range(m + 1))
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        new = [most + 1] * (m + 1)
        if i <= most:
            new[0] = i
        x = a[i - 1]
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row[max(0, i - most) : hi + 1], default=most + 1) > most:
            return most + 1
    return min(most + 1, *row)


class Index:
    """LSH tables of a block of items, grouped into classes by their number of words."""

    def __init__(self, items: list[tuple[int, bytes]], max_edits: float, min_words: int, samples: int, recall: float, seed: int):
        self.max_edits, self.samples, self.seed = max_edits, samples, seed
        self.items, by_class, self._salts = [], defaultdict(list), {}
        pairs = [np.zeros(0, np.int64)]
        for item_id, text in items:
            h = Words([normal(text)]).hash
            n = len(h)
            if n >= min_words:
                by_class[int(math.log(n / min_words, 1.25))].append(len(self.items))
                self.items.append((item_id, h.tolist(), int(max_edits * n)))
                pairs.append(self._pairs(h))
        pairs = np.concatenate(pairs)
        # About 1 in 32 bits is set at most; a bit that two pairs share only lets more through.
        self.bits = np.zeros(1 << max(20, min(28, math.ceil(math.log2(32 * len(pairs) + 1)))), bool)
        self.bits[pairs & (len(self.bits) - 1)] = True
        # A sampled step survives an item's edits with this chance or more (replacements, and walks that part at one).
        keep = (1 - 2 * max_edits) ** samples
        self.repetitions = max(4, math.ceil(math.log(1 - recall) / math.log(1 - keep)))
        self.classes = []
        rng = np.random.default_rng(seed)
        for _, members in sorted(by_class.items()):
            sizes = np.array([len(self.items[i][1]) for i in members])
            edits = max(self.items[i][2] for i in members)
            # the fewest pairs that survive, over the class
            need = min(len(self.items[i][1]) - 1 - 2 * self.items[i][2] for i in members)
            steps = max(samples, int(1.5 * sizes.min()))
            picks = [np.sort(rng.choice(steps, samples, replace=False)) for _ in range(self.repetitions)]
            h = np.array([x for i in members for x in self.items[i][1]] + [0], np.uint64)
            ends = np.cumsum(sizes)
            tables = []
            for r, at in enumerate(picks):
                t = defaultdict(list)
                for i, key in zip(members, self.walk(h, ends - sizes, ends, at, r).tolist(), strict=True):
                    t[key].append(i)
                tables.append((np.array(sorted(t), np.uint64), [t[k] for k in sorted(t)]))
            self.classes.append((int(sizes.min()), int(sizes.max()) + edits, need, picks, tables))

    @staticmethod
    def _pairs(h: np.ndarray) -> np.ndarray:
        return (mix(h[:-1] * np.uint64(3) + h[1:]) & np.uint64((1 << 28) - 1)).astype(np.int64)

    def walk(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, repetition: int) -> np.ndarray:
        """Keys of the sampled steps of the walks from starts; beyond the end there is a blank."""
        p, key = starts.copy(), np.full(len(starts), repetition + 1, np.uint64)
        want = set(at.tolist())
        if repetition not in self._salts:
            self._salts[repetition] = mix(np.arange(4096, dtype=np.uint64) + np.uint64((self.seed * 1_000_003 + repetition) * 10_007))
        salts = self._salts[repetition]
        for j in range(int(at[-1]) + 1):
            x = np.where(p < ends, h[np.minimum(p, len(h) - 1)], np.uint64(0))
            if j in want:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
            p = p + (((x ^ salts[j % 4096]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
        return key

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start_word, n_words, distance), the best window for each text and item."""
        w = Words([normal(t) for t in texts])
        n = len(w.hash)
        if n < 2 or not self.items:
            return []
        doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
        h = np.concatenate([w.hash, np.zeros(1, np.uint64)])
        hit = self.bits[self._pairs(w.hash) & (len(self.bits) - 1)] & (doc[1:] == doc[:-1])
        upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        found: dict[tuple[int, int], tuple[int, int]] = {}
        reach, need = max(c[1] for c in self.classes), min(c[2] for c in self.classes)
        near = np.flatnonzero(np.concatenate([upto[reach - 1 :], np.full(min(reach - 1, n), upto[-1])])[:n] - upto[:n] >= need)
        for least, reach, need, picks, tables in self.classes:
            starts = near[upto[np.minimum(near + reach - 1, n - 1)] - upto[near] >= need]
            if not len(starts):
                continue
            ends = w.bounds[doc[starts] + 1]
            live = ends - starts >= least - int(self.max_edits * least) - 1
            starts, ends = starts[live], ends[live]
            seen = set()
            for r, (at, (keys, members)) in enumerate(zip(picks, tables, strict=True)):
                got = self.walk(h, starts, ends, at, r)
                i = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                for k in np.flatnonzero(keys[i] == got):
                    for item in members[i[k]]:
                        seen.add((int(starts[k]), int(ends[k]), item))
            seen = sorted(seen)
            rest = []
            for s, e, item in seen:  # equal windows first: where there is one, no distance has to be found
                a = self.items[item][1]
                if e - s >= len(a) and h[s] == a[0] and h[s : s + len(a)].tolist() == a:
                    found.setdefault((int(doc[s]), item), (0, s))
                else:
                    rest.append((s, e, item))
            for s, e, item in rest:
                if (known := found.get((int(doc[s]), item))) and known[0] == 0:
                    continue
                _, a, most = self.items[item]
                window = h[s : min(e, s + len(a) + most)].tolist()
                if len(set(a).difference(window)) > most:  # each of these takes an edit
                    continue
                d = edit_distance(a, window, most)
                if d <= most and (not known or d < known[0]):
                    found[int(doc[s]), item] = (d, s)
        return [(t, self.items[i][0], s - int(w.bounds[t]), len(self.items[i][1]), d) for (t, i), (d, s) in sorted(found.items())]


def _indexes(items: DataFrame, max_edits: float, min_words: int, samples: int, recall: float, seed: int) -> list:
    """Broadcasts of the LSH tables of blocks of at most about BLOCK_ITEMS items."""
    spark = items.sparkSession
    it = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = max(1, math.ceil(it.count() / BLOCK_ITEMS))
    out = []
    for b in range(blocks):
        part = it if blocks == 1 else it.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text.encode()) for r in part.toLocalIterator()]
        out.append(spark.sparkContext.broadcast(Index(rows, max_edits, min_words, samples, recall, seed)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, min_words: int = MIN_WORDS, samples: int = 3, recall: float = 0.999, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance: one row for each document row and item found in it.

    Words are compared without case and ASCII punctuation. Null and empty texts contain nothing; items
    of fewer than min_words words are evidence of nothing and match nowhere; equal items each get
    their rows, as do repeated documents; of several windows the nearest counts, then the first.
    Whole texts are searched. Empty tables give no rows; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _indexes(items, max_edits, min_words, samples, recall, seed):

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = shared.value
            for batch in batches:
                texts, out = utf8(batch.column(1)), []
                for i, j in slices(texts):
                    out += [(i + t, *more) for t, *more in index.search(texts[i:j])]
                ids = batch.column(0).take(pa.array([x[0] for x in out], pa.int64()))
                rest = [pa.array([x[k] for x in out], pa.int32() if k == 4 else pa.int64()) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=[c.split()[0] for c in SCHEMA.split(", ")])

        found = d.mapInArrow(tidy(run), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, in which no item is found; map-only, one pass for each block of items."""
    place = docs.columns.index(text_col)
    for shared in _indexes(items, max_edits, min_words, 3, 0.999, 7):

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = shared.value
            for batch in batches:
                texts = utf8(batch.column(place))
                clean = np.ones(len(texts), bool)
                for i, j in slices(texts):
                    clean[[i + x[0] for x in index.search(texts[i:j])]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op2_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
