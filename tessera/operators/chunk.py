"""Chunkers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import PUNCTUATION

#: Texts whose pieces a task holds at a time.
SLICE = 64
PIECES = "array<struct<ix:int,start:int,end:int,text:string>>"
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_PAGE = re.compile(r"[^a-zA-Z0-9]*[0-9]{1,4}[^a-zA-Z0-9]*\Z")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, size - overlap apart, up to the one that reaches the end: PIECES.

    The overlap is half the size at most. An empty text has none.
    """
    step = size - min(overlap, size // 2)
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    piece = lambda s, i: F.struct(i.alias("ix"), s.alias("start"), F.least(s + size, n).alias("end"), F.substring(text, s + 1, F.lit(size)).alias("text"))
    return F.transform(starts, piece)


class Sentences:
    """The sentence chunker: a window is cut after its last full stop, if that lies at 60 % or later.

    A piece is trimmed; junk pieces are left out and take no index. The next one starts `overlap`
    before the untrimmed end; the one that reaches the text's end is the last.
    compat: the older stepping, which goes on from start + max(1, trimmed length - overlap) to the end.
    """

    def __init__(self, config: Config | None = None, compat: bool = False):
        self.c, self.compat = config or Config(), compat
        usual = PUNCTUATION.replace("\\", "") + "\\"
        self._usual = frozenset(usual)
        ascii = [chr(i) for i in range(128)]
        self._letters = "".join(filter(str.isalpha, ascii)).encode()
        self._plain = "".join(filter(self.plain, ascii)).encode()

    def plain(self, x: str) -> bool:
        """Whether a character is a letter, a digit, a blank or usual punctuation."""
        return x.isalpha() or x.isdecimal() or x.isspace() or x in self._usual

    def junk(self, t: str) -> bool:
        n = len(t)
        if n < self.c.min_chars:
            return True
        # ASCII is counted by what is left when a class is taken out; other characters one by one.
        usual = t.encode("ascii", "ignore")
        others = _NOT_ASCII.findall(t) if len(usual) < n else ()
        letters = len(usual) - len(usual.translate(None, self._letters)) + sum(map(str.isalpha, others))
        odd = len(usual.translate(None, self._plain)) + sum(not self.plain(x) for x in others)
        return letters / n < self.c.min_alpha or odd / n > self.c.max_symbols or _PAGE.match(t) is not None

    def split(self, text: str) -> list[dict]:
        w, o, at, out = self.c.window, self.c.overlap, 0, []
        while at < len(text):
            piece = text[at : at + w]
            stop = piece.rfind(".")
            if stop >= int(w * 0.6):
                piece = piece[: stop + 1]
            end, kept = at + len(piece), piece.strip(" ")
            if not self.junk(kept):
                start = at + len(piece) - len(piece.lstrip(" "))
                out.append({"ix": len(out), "start": start, "end": start + len(kept), "text": kept})
            if self.compat:
                at += max(1, len(kept) - o)
            elif end >= len(text):
                break
            else:
                at = max(at + 1, end - o)
        return self._located(text, out) if self.compat else out

    @staticmethod
    def _located(text: str, pieces: list[dict]) -> list[dict]:
        """compat: pieces are looked for from the end of the last one found on; those not found are dropped."""
        cursor, out = 0, []
        for p in pieces:
            at = text.find(p["text"], cursor)
            if at >= 0:
                cursor = at + len(p["text"])
                out.append(p | {"start": at, "end": cursor})
        return out


def sentence_chunks(docs: DataFrame, keys: list[str], text: str = "norm", config: Config | None = None, compat: bool = False) -> DataFrame:
    """keys, ix, start, end, chunk_text for each piece of each row's normalised text; a null text has none."""
    cutter = Sentences(config, compat)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        piece = pa.list_(pa.struct([("ix", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                found = [cutter.split(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, piece)], names=[*b.schema.names[:-1], "pieces"])

    d = docs.select(*keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[:-1]) + f", pieces {PIECES}"
    p = d.mapInArrow(run, schema).select(*keys, F.explode("pieces").alias("p"))
    return p.select(*keys, "p.ix", "p.start", "p.end", F.col("p.text").alias("chunk_text"))
