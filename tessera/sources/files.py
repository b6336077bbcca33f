"""Files as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose contents and texts a task holds at a time, beside the batch that comes from Spark.
SLICE = 64
Extractor = Callable[[str, bytes], str]


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """uri, length, mtime (epoch ms) of all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("uri"), "length", F.unix_millis("modificationTime").alias("mtime"))


def read_files(spark: SparkSession, paths: list[str] | str, pattern: str = "*") -> DataFrame:
    """uri, length, mtime, content of files, or of all below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    return files.select(F.col("path").alias("uri"), "length", F.unix_millis("modificationTime").alias("mtime"), "content")


class _Text(HTMLParser):
    SKIP, BREAK = {"script", "style", "noscript", "template", "head"}, {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(html: str) -> str:
    """The visible text: no scripts, styles or head; a line for each block."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def extract(uri: str, content: bytes) -> str:
    """Text of a file by its name: HTML, PDF (where a library is installed), else UTF-8 text."""
    name = uri.lower().rsplit("?", 1)[0]
    if name.endswith((".html", ".htm")):
        return html_text(content.decode("utf-8", "replace"))
    if name.endswith(".pdf"):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("PDF extraction needs the pypdf package") from e
        import io

        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    return content.decode("utf-8", "replace")


def extract_text(files: DataFrame, extractor: Extractor = extract) -> DataFrame:
    """uri, text, status ("ok", "empty" or "failed: ..."): a file that fails has a null text and stops nothing."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                yield texts_of(batch.slice(i, SLICE))

    def texts_of(b):
        import pyarrow as pa

        texts, status = [], []
        for uri, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            try:
                t = extractor(uri, content or b"")
                texts.append(t)
                status.append("ok" if t.strip() else "empty")
            except Exception as e:  # whatever a parser raises for a broken file
                texts.append(None)
                status.append(f"failed: {type(e).__name__}")
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(status, pa.string())], names=["uri", "text", "status"])

    return files.select("uri", "content").mapInArrow(run, "uri string, text string, status string")
