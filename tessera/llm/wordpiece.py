"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie whose nodes have failure links in the manner of linear max-match: where a
node has no child for the next byte, the pieces that greedy matching would now emit are popped and
the match goes on at the failure node. Links and the *number* of popped pieces are precomputed for
every node and byte, so that a word's count takes one table step per byte and no piece is built.
Words of a batch go through the table in lockstep, one NumPy operation per byte position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, table, utf8


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece model: those with its word mark begin a word, the others continue one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and p[1:]], [p for p in pieces if "▁" not in p]


class Automaton:
    """next, popped: what a node and a byte class lead to; ends: pieces still to pop at a word's end.

    A word that no pieces make up counts as one unknown token: DEAD is the state for that.
    """

    def __init__(self, first: list[str], rest: list[str]):
        # Two tries in one: node 0 begins a word, node 1 stands after a piece ("##").
        child: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, vocabulary in ((0, first), (1, rest)):
            for p in sorted(set(vocabulary)):
                v = root
                for b in p.encode():
                    if b not in child[v]:
                        child[v][b] = len(child)
                        child.append({})
                        piece.append(False)
                    v = child[v][b]
                piece[v] = True
        n = len(child)
        used = sorted({b for c in child for b in c})
        self.byte_class = np.full(256, len(used), np.int64)
        self.byte_class[used] = np.arange(len(used))
        self.classes, self.dead = len(used) + 1, n
        fail, pops = [n] * (n + 1), [0] * (n + 1)
        queue = [(0, -1, 0), (1, -1, 0)]
        for v, parent, b in queue:  # breadth first: links of shorter strings are there already
            if parent >= 0:
                if piece[v]:
                    fail[v], pops[v] = 1, 1
                else:
                    u, k = fail[parent], pops[parent]
                    while u != n and b not in child[u]:
                        k, u = k + pops[u], fail[u]
                    if u != n:
                        fail[v], pops[v] = child[u][b], k
            queue += [(c, v, x) for x, c in child[v].items()]
        nxt = np.full((n + 1, self.classes), n, np.int32)
        pop = np.zeros((n + 1, self.classes), np.uint8 if max(pops) < 16 else np.int32)
        total = pop.astype(np.int32)
        # Rows in an order in which each failure node is done before: by depth of the failure chain.
        depth = [0] * (n + 1)
        for v, _, _ in queue:
            chain, u = [], v
            while u != n and not depth[u]:
                chain.append(u)
                u = fail[u]
            for x in reversed(chain):
                depth[x] = 1 + (depth[fail[x]] if fail[x] != n else 0)
        for v in sorted(range(n), key=depth.__getitem__):
            f = fail[v]
            if f != n:
                nxt[v], total[v] = nxt[f], total[f] + pops[v]
            for b, c in child[v].items():
                nxt[v, self.byte_class[b]], total[v, self.byte_class[b]] = c, 0
        self.next, self.popped = nxt.ravel(), np.where(nxt == n, 0, total).astype(np.int16).ravel()
        # At a word's end everything has to be popped and node 1 reached.
        self.ends = np.full(n + 1, -1, np.int32)
        for v in sorted(range(n), key=depth.__getitem__):
            if v == 1:
                self.ends[v] = 0
            elif fail[v] != n and self.ends[fail[v]] >= 0:
                self.ends[v] = self.ends[fail[v]] + pops[v]

    def counts(self, words: Words, raw: np.ndarray) -> np.ndarray:
        """The number of pieces of each word; 1 for words that can't be made up of pieces."""
        n = len(words.starts)
        lengths = words.ends - words.starts
        order = np.argsort(-lengths, kind="stable")
        at, left = words.starts[order], lengths[order]
        state, popped = np.zeros(n, np.int64), np.zeros(n, np.int32)
        # live[t]: how many words have more than t bytes
        live = np.searchsorted(-left, -np.arange(int(left[0]) if n else 0), side="left")
        for t, k in enumerate(live):
            i = state[:k] * self.classes + self.byte_class[raw[at[:k] + t]]
            popped[:k] += self.popped[i]
            state[:k] = self.next[i]
        ends = self.ends[state]
        out = np.empty(n, np.int64)
        out[order] = np.where((state == self.dead) | (ends < 0), 1, popped + ends)
        return out


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Built once in each Python worker; its size is the vocabulary's."""
    if path not in _automata:
        _automata[path] = Automaton(*sentencepiece_vocabulary(path))
    return _automata[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for each row; map-only.

    Words are runs of characters other than ASCII white space. Null and empty texts have no words;
    repeated rows, null ids and very long texts are rows like others; other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = automaton(vocabulary)
        for batch in batches:
            texts = utf8(batch.column(1))
            n_words, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, j in slices(texts):
                w = Words(texts[i:j])
                raw = np.frombuffer(b" ".join(texts[i:j]) + b" ", np.uint8)
                done = np.concatenate([[0], np.cumsum(a.counts(w, raw))])
                n_words[i:j] = np.diff(w.bounds)
                n_tokens[i:j] = np.diff(done[w.bounds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op8_wordpiece_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
