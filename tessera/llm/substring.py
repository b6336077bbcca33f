"""Substring deduplication: repeated windows of words, found exactly behind a count-min prefilter.

A window is WINDOW consecutive words. Its anchor is the smallest-hashed run of ANCHOR words within it
(the leftmost, of equal ones); equal windows have equal anchors at equal places, so a window occurs at
most as often as its anchor, and there is one anchor for about ten windows.

1. Each partition counts its anchors in a count-min sketch (two rows, counters that stop at 255); the
   sketches are merged block by block. What they estimate is never too small.
2. A second pass sends on only windows whose anchor is estimated to occur twice or more, as one row for
   an anchor's run of windows, and groups them exactly by (anchor, window hash). Anchors estimated to
   be very frequent send a row for each window instead, after windows that repeat within a batch are
   settled there, so that no key gathers more rows than there are batches.
3. What came back as repeated is joined to the documents; words that a repeated window covers go.

The sketch has about two counters for an anchor in each row, up to MOST_CELLS; beyond that it lets more
windows through to the second pass, and none is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, mix, slices, table, utf8

WINDOW, ANCHOR = 35, 18
FREQUENT, MOST_CELLS, BLOCK = 64, 1 << 27, 1 << 16
ROWS = "key long, rid long, start int, n int, hashes binary, settled boolean"
BASE_ANCHOR, BASE_WINDOW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Runs:
    """The runs of windows with a common anchor in some texts.

    anchor: its hash; start, n: the windows' starts; text: which text; windows: all windows' hashes.
    """

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        w = Words(texts)
        self.bounds = w.bounds
        n = len(w.hash)
        self.anchor = np.zeros(0, np.uint64)
        if n < window:
            return
        span = window - anchor + 1
        value = Rolling(w.hash, BASE_ANCHOR).runs(anchor)
        at = np.arange(len(value))
        width = 1
        best = value
        while width < span:  # the smallest of `width` runs from each start on, by doubling
            step = min(width, span - width)
            right = best[step:] < best[: len(best) - step]
            at = np.where(right, at[step:], at[: len(at) - step])
            best = np.where(right, best[step:], best[: len(best) - step])
            width += step
        counts = np.diff(w.bounds)
        text = np.repeat(np.arange(len(texts)), counts)
        valid = (w.bounds[text + 1] - np.arange(n) >= window)[: len(at)]
        starts = np.flatnonzero(valid)
        if not len(starts):
            return
        at, text = at[starts], text[starts]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
        self.anchor, self.text = value[at[new]], text[new]
        self.start = starts[new]
        self.n = np.diff(np.concatenate([new, [len(starts)]]))
        self._words, self._window = w.hash, window

    def windows(self) -> np.ndarray:
        return Rolling(self._words, BASE_WINDOW).runs(self._window)


def _cells(anchor: np.ndarray, row_cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(row_cells - 1)
    return (anchor & mask).astype(np.int64), ((anchor >> np.uint64(32)) & mask).astype(np.int64) + row_cells


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rid, text. Rows with equal id and text share a rid, and what is found of them."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")


def sketch(texts: DataFrame, row_cells: int, window: int, anchor: int, frequent: int) -> DataFrame:
    """The merged sketch: (block, twice, often), bits of the cells of 2 or more, and of over `frequent`."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: list[np.ndarray] = []
        size = 0

        def tally() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(found), return_counts=True)
            block = cells // BLOCK
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            low, n = (cells % BLOCK).astype("<u2"), np.minimum(n, 255).astype(np.uint8)
            pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            cols = [pa.array(block[cut[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([n[a:b].tobytes() for a, b in pairs], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "cells", "counts"])

        for b in batches:
            t = utf8(b.column(0))
            for i, j in slices(t):
                a = Runs(t[i:j], window, anchor).anchor
                if len(a):
                    found += _cells(a, row_cells)
                    size += len(a)
                if size > 4_000_000:
                    yield tally()
                    found, size = [], 0
        if found:
            yield tally()

    def merge(rows):
        import pyarrow as pa

        total = np.zeros(BLOCK, np.int32)
        for cells, counts in zip(rows["cells"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            at = np.frombuffer(cells, "<u2")
            total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 255)
        return pa.table({"block": rows["block"][:1], "twice": pa.array([np.packbits(total > 1).tobytes()], pa.binary()), "often": pa.array([np.packbits(total > frequent).tobytes()], pa.binary())})

    return texts.select("text").mapInArrow(count, "block int, cells binary, counts binary").groupBy("block").applyInArrow(merge, "block int, twice binary, often binary")


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeated_windows(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT, most_cells: int = MOST_CELLS) -> DataFrame:
    """(rid, start, bits): bit i says that the window from word start + i on occurs elsewhere too."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word has about 6 bytes, and 2 in (window - anchor + 2) runs are anchors.
    anchors = size / 6 * 2 / (window - anchor + 2)
    row_cells = min(most_cells, max(BLOCK, 1 << math.ceil(math.log2(2 * anchors + 1))))
    twice, often = (np.zeros(2 * row_cells // 8, np.uint8) for _ in range(2))
    for r in sketch(texts, row_cells, window, anchor, frequent).toLocalIterator():
        place = slice(r.block * BLOCK // 8, (r.block + 1) * BLOCK // 8)
        twice[place], often[place] = np.frombuffer(r.twice, np.uint8), np.frombuffer(r.often, np.uint8)
    shared = spark.sparkContext.broadcast((twice, often))  # 4 * row_cells / 8 bytes, 64 MB at most

    def select(batches: Iterator) -> Iterator:
        import pyarrow as pa

        twice, often = shared.value
        for b in batches:
            rids, t = b.column(0).to_numpy(), utf8(b.column(1))
            for i, j in slices(t):
                runs = Runs(t[i:j], window, anchor)
                if not len(runs.anchor):
                    continue
                one, two = _cells(runs.anchor, row_cells)
                hit = np.flatnonzero(_bit(twice, one) & _bit(twice, two))
                if not len(hit):
                    continue
                hot = _bit(often, one[hit]) & _bit(often, two[hit])
                h = runs.windows()
                first = runs.bounds[runs.text]
                out = []
                some = hit[~hot]
                if len(some):
                    rows = [h[s : s + n].astype("<u8").tobytes() for s, n in zip(runs.start[some].tolist(), runs.n[some].tolist(), strict=True)]
                    out.append((_signed(runs.anchor[some]), rids[i + runs.text[some]], runs.start[some] - first[some], runs.n[some], rows, np.zeros(len(some), bool)))
                many = hit[hot]
                if len(many):
                    n = runs.n[many]
                    run = np.repeat(many, n)
                    at = np.repeat(runs.start[many] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    key = mix(runs.anchor[run] ^ mix(h[at]))
                    _, rep, where, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    # Windows that repeat here are settled; one of them goes on, to tell others of it.
                    mine = rids[i + runs.text[run]]
                    local = at - first[run]
                    alone = times[where] == 1
                    lone = np.flatnonzero(alone)
                    told = rep[times > 1]
                    for pick, done in ((lone, False), (told, True)):
                        if len(pick):
                            out.append((_signed(key[pick]), mine[pick], local[pick], np.ones(len(pick), np.int64), [x.tobytes() for x in h[at[pick]].astype("<u8")], np.full(len(pick), done)))
                    again = np.flatnonzero(~alone)
                    if len(again):  # settled windows in a row make one row, of 31 at most
                        a, r = local[again], mine[again]
                        edge = np.concatenate([[True], (a[1:] != a[:-1] + 1) | (r[1:] != r[:-1])])
                        line = np.cumsum(edge) - 1
                        place = np.arange(len(a)) - np.flatnonzero(edge)[line]
                        cut = np.flatnonzero(edge | (place % 31 == 0))
                        out.append((_signed(mix(r[cut].astype(np.uint64) + a[cut].astype(np.uint64))), r[cut], a[cut], np.diff(np.concatenate([cut, [len(a)]])), [b""] * len(cut), np.ones(len(cut), bool)))
                cols = [np.concatenate([o[k] for o in out]) for k in (0, 1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array([x for o in out for x in o[4]], pa.binary()), pa.array(np.concatenate([o[5] for o in out]))], names=[c.split()[0] for c in ROWS.split(", ")])

    def group(batches: Iterator) -> Iterator:
        """Rows come sorted by key; all of a key are looked at together."""
        import pyarrow as pa

        left = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from _settle(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None and left.num_rows:
            yield from _settle(left)

    rows = texts.select("rid", "text").mapInArrow(select, ROWS).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(group, "rid long, start int, bits long")


def _settle(t) -> Iterator:
    """Rows of whole keys -> (rid, start, bits) of those with a repeated window."""
    import pyarrow as pa

    t = t.combine_chunks()
    key, n, settled = t["key"].to_numpy(), t["n"].to_numpy(), t["settled"].to_numpy()
    lengths = np.array([len(x) for x in t["hashes"].to_pylist()], np.int64) // 8
    h = np.frombuffer(b"".join(t["hashes"].to_pylist()), "<u8")
    row = np.repeat(np.arange(len(key)), lengths)
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((h, key[row]))
    k, x = key[row][order], h[order]
    same = (k[1:] == k[:-1]) & (x[1:] == x[:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    bits = np.zeros(len(key), np.int64)
    np.bitwise_or.at(bits, row[twice], np.int64(1) << place[twice])
    bits[settled] |= (np.int64(1) << n[settled].astype(np.int64)) - 1
    keep = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(t["rid"].to_numpy()[keep]), pa.array(t["start"].to_numpy()[keep]), pa.array(bits[keep])], names=["rid", "start", "bits"])


def _remove(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for text, found in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.split()
                if found:
                    edges = np.zeros(len(words) + 1, np.int32)
                    for f in found:
                        bits, at = f["bits"], f["start"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            ones = (~(bits >> low) & ((bits >> low) + 1)).bit_length() - 1
                            edges[at + low] += 1
                            edges[at + low + ones + window - 1] -= 1
                            bits &= ~(((1 << ones) - 1) << low)
                    gone = np.cumsum(edges[:-1]) > 0
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out.append((len(words), int(gone.sum()), kept))
                else:
                    out.append((len(words), 0, b" ".join(words)))
            sha = [hashlib.sha256(x[2]).hexdigest() for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)), pa.array([x[2].decode() for x in out], pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), kept_sha256 of every row.

    Words are runs of bytes other than ASCII white space, unchanged; null texts have none. A repeated
    window is one whose words also start anywhere else, in the same text or another; repeated rows are
    elsewhere to each other. Texts shorter than a window keep all words. All judgements are made on
    the input. An empty table gives no rows; other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    found = repeated_windows(texts, window, anchor, frequent, most_cells)
    found = found.groupBy("rid").agg(F.collect_list(F.struct("start", "bits")).alias("found"))
    return texts.join(found, "rid", "left").select("doc_id", "text", "found").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op4_count_min_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35),
k AS (SELECT doc_id, s, sha256(array_to_string(words[s:s + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM r),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM e ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""
