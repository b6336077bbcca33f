"""Approximate nearest neighbours by inner product, over balanced posting lists.

Inner product becomes distance by one more component, sqrt(M^2 - |x|^2), with M the greatest norm; queries
get 0 there and are scaled to M. Centroids are fitted on a bounded sample by k-means with a price on
crowded clusters, which assignment pays too, so that lists come out even. Every vector is indexed, in its
best list and, at boundaries, in up to COPIES lists whose centroids are nearly as near (COPY_RATIO).
Lists above SEGMENT rows are cut into segments that are searched each.
Queries find lists by best-first search of a neighbour graph of the centroids, as far as those at `ratio`
times the nearest one's distance; the ratio is the smallest that reaches `recall` for a sample of the
rows that ask, which may lie elsewhere than the others, among vectors that the centroids were not fitted
on. The search starts at centroids far from each other, as many as keep it from being caught in one
cluster: their number is doubled until the search, measured as it is run, finds those lists.

The lists are written once, a row for each segment, to the shared folder. Queries are dealt into blocks of
near ones, and a block's task reads the lists that any of its queries chose, one after the other, and keeps
the best ids of each query: neither queries nor hits are shuffled by list, so that what is written grows
with the vectors alone. Lists are scanned in full, in single precision; what may be among the best by its
error bound is measured at once in double precision, each pair by one sum in the same order, so that
ties are ties.

Equal vectors are one entry with their K + 1 smallest ids; that is enough for every answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table

K, SAMPLE, MOST_LISTS, LIST_ROWS, SEGMENT, COPIES, COPY_RATIO, DEGREE = 20, 32_768, 4096, 256, 4096, 3, 1.025, 16
#: Queries that a task answers at a time, scores of a list that it has at a time, hits that it gathers before they are merged.
QUERIES, SCORES, HITS = 4096, 1 << 22, 1 << 17
#: Vectors with many copies that a task merges over its batches.
MERGED = 1024


def _matrix(column, dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim).astype(np.float64)


def _distinct(batches: Iterator, dim: int, dtype: str, k: int) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """(vector, its k + 1 smallest ids) of each batch's valid rows; those with more copies are merged over batches."""
    many: dict[bytes, np.ndarray] = {}
    for b in batches:
        rows = _valid(b, dim, dtype)
        if rows is None:
            continue
        ids, x = rows
        packed = _packed(x)
        order = np.argsort(ids, kind="stable")
        _, inverse = np.unique(packed[order], return_inverse=True)
        by = np.argsort(inverse, kind="stable")  # within a vector still by id
        cut = np.flatnonzero(np.concatenate([[True], np.diff(inverse[by]) > 0, [True]]))
        ids, packed = ids[order][by], packed[order][by]
        out = []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            v, own = packed[i].tobytes(), np.unique(ids[i:j])[: k + 1]
            if v in many or (j - i > k and len(many) < MERGED):
                many[v] = np.union1d(many.get(v, own), own)[: k + 1]
            else:
                out.append((v, own))
        yield out
    yield list(many.items())


def _packed(x: np.ndarray) -> np.ndarray:
    """Each row as one value of bytes."""
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()


def _valid(batch, dim: int, dtype: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of the rows that take part."""
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    null = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
    there = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
    ends = np.cumsum(size)
    ok = np.flatnonzero(there & (size == dim) & (null[ends] == null[ends - size]))
    if not len(ok):
        return None
    x = values[(ends - size)[ok][:, None] + np.arange(dim)] + np.zeros(1, dtype)  # -0.0 becomes 0.0
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)[ok]
    return (ids[good], x[good]) if good.any() else None


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))


def beam_of(lists: int) -> int:
    return max(8, lists // 64)


@dataclass
class Index:
    """What every task has: centroids, their graph, where its search starts, the greatest norm and the ratio. Its size has a bound."""

    centroids: np.ndarray
    graph: np.ndarray
    top: float
    price: np.ndarray
    #: all lists, each one the farthest from those before it; the search starts at the first `starts`
    entry: np.ndarray
    copy_ratio: float = COPY_RATIO
    ratio: float = 1.0
    starts: int = 8

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, top: float, k: int, recall: float, seed: int = 5, of: int | None = None, asking: np.ndarray | None = None) -> Index:
        """x: a sample of `of` vectors (those alone, if not given); asking: a sample of the queries (else some of x)."""
        rng = np.random.default_rng(seed)
        index = cls(np.zeros((0, 0)), np.zeros((0, 0), np.int64), top, np.zeros(lists), np.arange(lists))
        x, rows = rng.permutation(x), len(x)
        of = max(of or 0, rows)
        # A quarter has no part in the centroids: its vectors lie to them as those do that the sample lacks. It is
        # joined by as many of the others as there are of such among all.
        out = rows // 4 if rows // 4 > 1 and rows - rows // 4 >= lists else 0
        a = index.augment(x[out:])
        x = x[: out + round(out * (rows - out) / (of - rows + out))] if out else x
        c = a[rng.choice(len(a), lists, replace=False)]
        even = len(a) / lists
        for _ in range(8):
            total, count = np.zeros_like(c), np.zeros(lists)
            for i in range(0, len(a), 4096):
                d = _distance(a[i : i + 4096], c)
                near = (d**2 + index.price).argmin(1)
                spread = float((d.min(1) ** 2).mean())
                np.add.at(total, near, a[i : i + 4096])
                count += np.bincount(near, minlength=lists)
            empty = count == 0
            c = np.where(empty[:, None], a[rng.integers(0, len(a), lists)], total / np.maximum(count, 1)[:, None])
            index.price = np.where(empty, 0, np.maximum(index.price + 0.05 * spread * np.clip(count / even - 1, -1, 1), 0))
        index.centroids = c
        d = _distance(c, c)
        far = d[0].copy()
        for j in range(1, lists):
            index.entry[j] = at = int(far.argmax())
            far = np.minimum(far, d[at])
            far[index.entry[: j + 1]] = -1
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1)[:, : min(DEGREE, lists - 1)]
        # A ring besides the neighbours keeps the graph in one piece.
        ring = np.stack([(np.arange(lists) + 1) % lists, (np.arange(lists) - 1) % lists], 1)
        index.graph = np.concatenate([near, ring], 1)
        # At which ratio are the lists of the queries' true neighbours reached? Among fewer vectors fewer are
        # as near as the k nearest of all; twice as many are asked for, to be on the safe side.
        q = x if asking is None or not len(asking) else asking
        q = q[rng.choice(len(q), min(1024, len(q)), replace=False)]
        k = min(k, len(x) - 1, max(1, round(2 * k * len(x) / of)))
        if k < 1:
            return index
        true = np.zeros((len(q), k), np.int64)
        for i in range(0, len(q), 64):
            s = q[i : i + 64] @ x.T
            near, at = np.nonzero(s >= (q[i : i + 64] ** 2).sum(1)[:, None] * (1 - 1e-9))
            same = (q[i + near] == x[at]).all(1)  # a query's own vector
            s[near[same], at[same]] = -np.inf
            true[i : i + 64] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        d = _distance(index.queries(q), c)
        lists_of = index.assign(x[true.ravel()])
        there, at = lists_of >= 0, np.maximum(lists_of, 0)
        reach = np.where(there, np.take_along_axis(np.repeat(d, k, 0), at, 1), np.inf).min(1)
        index.ratio = float(np.quantile(reach / np.repeat(np.maximum(d.min(1), 1e-12), k), recall)) * (1 + 1e-9)
        in_ratio = np.take_along_axis(np.repeat(d <= index.ratio * d.min(1)[:, None], k, 0), at, 1)
        want = (in_ratio & there).any(1).mean()
        beam = beam_of(lists)
        while index.starts < lists:
            found = np.concatenate([index.lists(q[i : i + 128], beam) for i in range(0, len(q), 128)])
            if (np.take_along_axis(np.repeat(found, k, 0), at, 1) & there).any(1).mean() >= want - 0.002:
                break
            index.starts *= 2
        return index

    def augment(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))[:, None]], 1)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q * (self.top / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))], 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Up to COPIES lists of each vector, -1 beyond: the best, and at boundaries those nearly as near."""
        out = np.full((len(x), COPIES), -1)
        for i in range(0, len(x), 2048):
            a = self.augment(x[i : i + 2048])
            d = _distance(a, self.centroids)
            rows = np.arange(len(a))
            out[i : i + 2048, 0] = first = (d**2 + self.price).argmin(1)
            order = np.argpartition(d, 3 * COPIES, 1)[:, : 3 * COPIES] if d.shape[1] > 3 * COPIES else np.tile(np.arange(d.shape[1]), (len(a), 1))
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), 1), 1)
            limit = self.copy_ratio * d[rows, first]
            taken = np.ones(len(a), np.int64)
            for r in range(order.shape[1]):
                c = order[:, r]
                own = d[rows, c]
                ok = (own <= limit) & (c != first) & (taken < COPIES)
                at = np.flatnonzero(ok)
                out[i + at, taken[at]] = c[at]
                taken[at] += 1
        return out

    def lists(self, q: np.ndarray, beam: int = 8, sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """Which lists each query searches (a boolean matrix), by best-first search of the graph.

        sizes: the lists' numbers of rows; where those found hold fewer than `least`, the next ones follow.
        """
        q = self.queries(q)
        n, m = len(q), len(self.centroids)
        seen = np.full((n, m), np.inf)
        done = np.zeros((n, m), bool)
        start = self.entry[: self.starts]
        seen[:, start] = _distance(q, self.centroids[start])
        rows = np.arange(n)
        beam = min(beam, m)
        while len(rows):
            d = np.where(done[rows], np.inf, seen[rows])
            at = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(d, at, 1)
            open_ = best <= self.ratio * seen[rows].min(1)[:, None]
            rows, at, open_ = rows[open_.any(1)], at[open_.any(1)], open_[open_.any(1)]
            r, j = np.nonzero(open_)
            done[rows[r], at[r, j]] = True
            to = self.graph[at[r, j]]
            who = np.repeat(rows[r], to.shape[1])
            to = to.ravel()
            new = np.unique(who[np.isinf(seen[who, to])] * m + to[np.isinf(seen[who, to])])
            who, to = new // m, new % m
            seen[who, to] = np.linalg.norm(q[who] - self.centroids[to], axis=1)
        chosen = seen <= self.ratio * seen.min(1)[:, None]
        if sizes is not None:
            for r in np.flatnonzero(chosen @ sizes < least):
                order = np.argsort(_distance(q[r : r + 1], self.centroids)[0])
                chosen[r, order[: int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1]] = True
        return chosen


CELL = 1 << 24


class Answers:
    """The best ids found so far for the different vectors of a block of queries, exactly measured."""

    def __init__(self, queries: np.ndarray, top: float, most: int):
        self.q, self.top, self.most = queries, top, most
        self.norm = np.linalg.norm(queries, axis=1)
        self.small = (queries / self.norm[:, None]).astype(np.float32)
        #: what a score of scaled vectors may be off in single precision
        self.off = (queries.shape[1] + 8) * 2.0**-23
        self.score = np.full((len(queries), most), -np.inf)
        self.id = np.full((len(queries), most), np.iinfo(np.int64).max)
        self.hits: list = []
        self.waiting = 0

    def scan(self, who: np.ndarray, base: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Measure the vectors `base`, which are all different, for the queries `who`."""
        small, first = (base / self.top).astype(np.float32), np.cumsum(counts) - counts
        step = max(1, SCORES // len(base))
        for i in range(0, len(who), step):
            w = who[i : i + step]
            s = self.small[w] @ small.T
            least = self.score[w, -1] / (self.norm[w] * self.top) - self.off
            new = np.flatnonzero(np.isneginf(least))
            if len(new) and len(base) > self.most:
                least[new] = np.partition(s[new], len(base) - self.most, axis=1)[:, len(base) - self.most] - 2 * self.off
            # the bound is rounded down, by far less than `off`
            r, c = np.nonzero(s >= least.astype(np.float32)[:, None])
            for j in range(0, len(r), HITS):
                a, b = w[r[j : j + HITS]], c[j : j + HITS]
                exact, n = (self.q[a] * base[b]).sum(1), counts[b]
                ends = np.cumsum(n)
                at = np.repeat(first[b] - ends + n, n) + np.arange(ends[-1])
                self.hits.append((np.repeat(a, n), np.repeat(exact, n), ids[at]))
                self.waiting += len(at)
                if self.waiting >= HITS:
                    self.merge()

    def merge(self) -> None:
        if not self.hits:
            return
        q, s, i = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        self.hits, self.waiting = [], 0
        own = np.unique(q)
        q = np.concatenate([q, np.repeat(own, self.most)])
        s, i = np.concatenate([s, self.score[own].ravel()]), np.concatenate([i, self.id[own].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        # a vector that stands in several lists counts once
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
        q, s, i = q[new], s[new], i[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.most
        self.score[own], self.id[own] = -np.inf, np.iinfo(np.int64).max
        self.score[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = s[keep], i[keep]


def _lists(root: str, wanted: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(list, vectors, ids, how many ids each vector has) of the index at `root`: all segments of the wanted lists."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(root)
    wanted = np.sort(wanted)
    for name in sorted(f.path for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")):
        with where.open_input_file(name) as opened:
            f = pq.ParquetFile(opened)
            at = f.schema_arrow.get_field_index("list")
            for g in range(f.num_row_groups):
                x = f.metadata.row_group(g).column(at).statistics
                if x is not None and x.has_min_max and np.searchsorted(wanted, x.min) == np.searchsorted(wanted, x.max, "right"):
                    continue
                t = f.read_row_group(g, use_threads=False)
                of = t["list"].to_numpy()
                for r in np.flatnonzero(np.isin(of, wanted)).tolist():
                    yield int(of[r]), t["v"][r].as_py(), t["ids"][r].values.to_numpy(), t["counts"][r].values.to_numpy()


def nearest(vectors: DataFrame, k: int = K, query_every: int = 20, recall: float = 0.95, list_rows: int = LIST_ROWS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each row whose id is a multiple of query_every.

    Vectors that are null, zero, of another length than most or hold null or non-finite components, and
    rows with a null id, take no part. Equal scores rank by id; equal vectors are candidates each, and a
    row is never its own. Rows that repeat an id with one vector count once. Other columns are not read.
    The index is written through Spark and read through pyarrow's file systems (file, hdfs, s3 ...).
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    t = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    sizes = t.where("x IS NOT NULL AND size(x) > 0").groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes.dim

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = _valid(b, dim, kind)
            if rows is not None:
                ids, x = rows
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([int((ids % query_every == 0).sum())]), pa.array([float(np.linalg.norm(x.astype(np.float64), axis=1).max())])], names=["n", "q", "m"])

    n, asking, top = t.mapInArrow(measured, "n long, q long, m double").agg(F.sum("n"), F.sum("q"), F.max("m")).first()
    if not asking:
        return spark.createDataFrame([], schema)
    part = t if n <= sample else t.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    drawn = part.where(F.size("x") == dim).limit(2 * sample).toArrow()
    drawn = [rows[1] for b in drawn.combine_chunks().to_batches() if (rows := _valid(b, dim, kind)) is not None]
    drawn = np.concatenate(drawn) if drawn else np.ones((1, dim), kind)
    x = np.unique(_packed(drawn)).view(kind).reshape(-1, dim).astype(np.float64)
    different = n * len(x) // len(drawn)
    lists = max(1, min(MOST_LISTS, different // list_rows, len(x) // 8))
    some = t.where(F.pmod("id", F.lit(query_every)) == 0).where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1, 1024 / asking)))
    some = [rows[1] for b in some.limit(2048).toArrow().combine_chunks().to_batches() if (rows := _valid(b, dim, kind)) is not None]
    index = Index.fit(x, lists, top, k, recall, of=different, asking=np.concatenate(some).astype(np.float64) if some else None)
    at = index.assign(x)
    segments = np.maximum(1, -(-np.bincount(at[at >= 0], minlength=lists) * different // (len(x) * SEGMENT)))
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS * (dim + 1 + DEGREE + 4) * 8 bytes at most

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for found in _distinct(batches, dim, kind, k):
            for i in range(0, len(found), 4096):
                some = found[i : i + 4096]
                of = shared.value.assign(np.frombuffer(b"".join(v for v, _ in some), kind).reshape(-1, dim).astype(np.float64))
                r, c = np.nonzero(of >= 0)
                of = of[r, c]
                cell = of * CELL
                for j in np.flatnonzero(segments[of] > 1).tolist():
                    cell[j] += xxhash.xxh64_intdigest(some[r[j]][0]) % int(segments[of[j]])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array([some[j][0] for j in r.tolist()], pa.binary()), pa.array([some[j][1] for j in r.tolist()], pa.list_(pa.int64()))], names=["cell", "v", "ids"])

    def gather(batches: Iterator) -> Iterator:
        """Rows in order of cell and vector: a row for each cell, or for so many of its vectors."""
        cell, vs, ids = None, [], []

        def row():
            own = [np.unique(np.concatenate(i))[: k + 1] if len(i) > 1 else i[0] for i in ids]
            return cell // CELL, b"".join(vs), np.concatenate(own), np.array([len(i) for i in own], np.int32)

        for b in batches:
            out = []
            lists = b.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for j, (c, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = flat[ends[j] : ends[j + 1]]
                if c == cell and v == vs[-1]:
                    ids[-1].append(own)
                    if len(ids[-1]) >= 1024:
                        ids[-1] = [np.unique(np.concatenate(ids[-1]))[: k + 1]]
                    continue
                if vs and (c != cell or len(vs) >= 2 * SEGMENT):
                    out.append(row())
                    vs, ids = [], []
                cell = c
                vs.append(v)
                ids.append([own])
            yield of_rows(out)
        if vs:
            yield of_rows([row()])

    def of_rows(rows: list):
        import pyarrow as pa

        types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind_) for j, kind_ in enumerate(types)], names=["list", "v", "ids", "counts"])

    root = shared_dir(spark, "postings")
    placed = t.mapInArrow(place, "cell long, v binary, ids array<long>").repartition("cell").sortWithinPartitions("cell", "v")
    posted = placed.mapInArrow(gather, "list long, v binary, ids array<long>, counts array<int>")
    posted.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").parquet(root)
    held = np.zeros(lists, np.int64)
    for r in spark.read.parquet(root).groupBy("list").agg(F.sum(F.size("counts")).alias("n")).collect():  # a row per list
        held[r.list] = r.n

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = _valid(b, dim, kind)
            if rows is not None:
                ids, x = rows
                near = _distance(shared.value.queries(x.astype(np.float64)), shared.value.centroids).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())], names=["near", "query_id", "v"])

    def answer(ids: np.ndarray, v: list[bytes]):
        import pyarrow as pa

        packed, of = np.unique(_packed(np.frombuffer(b"".join(v), kind).reshape(-1, dim)), return_inverse=True)
        ids, of = np.unique(np.stack([ids, of]), axis=1)  # rows that are repeated
        q = packed.view(kind).reshape(-1, dim).astype(np.float64)
        beam = beam_of(lists)
        chosen = np.concatenate([shared.value.lists(q[i : i + 128], beam, held, (k + 1) * COPIES) for i in range(0, len(q), 128)])
        best = Answers(q, top, k + 1)
        for c, vs, own, counts in _lists(root, np.flatnonzero(chosen.any(0))):
            best.scan(np.flatnonzero(chosen[:, c]), np.frombuffer(vs, kind).reshape(-1, dim).astype(np.float64), own, counts)
        best.merge()
        other = (best.id[of] != ids[:, None]) & np.isfinite(best.score[of])
        rank = np.cumsum(other, 1)
        r, c = np.nonzero(other & (rank <= k))
        return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(rank[r, c], pa.int32()), pa.array(best.id[of][r, c]), pa.array(best.score[of][r, c])], names=["query_id", "rank", "vec_id", "score"])

    def search(batches: Iterator) -> Iterator:
        ids, v, n = [], [], 0
        for b in batches:
            i = 0
            while i < b.num_rows:
                part = b.slice(i, QUERIES - n)
                i += part.num_rows
                ids.append(part.column(1).to_numpy())
                v += part.column(2).to_pylist()
                n += part.num_rows
                if n == QUERIES:
                    yield answer(np.concatenate(ids), v)
                    ids, v, n = [], [], 0
        if n:
            yield answer(np.concatenate(ids), v)

    blocks = max(-(-asking // QUERIES), min(2 * spark.sparkContext.defaultParallelism, -(-asking // 256)))
    asked = t.where(F.pmod("id", F.lit(query_every)) == 0).mapInArrow(ask, "near long, query_id long, v binary")
    return asked.repartitionByRange(blocks, "near", F.xxhash64("query_id")).select("near", "query_id", "v").mapInArrow(search, schema)


def op1_posting_lists(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
