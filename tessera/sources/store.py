"""Tables under one root: appends, replacements that never leave a half, and snapshots behind a pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas


class Store:
    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 5000):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        """Whether the folder is there; a damaged table is an error at reading, not absence."""
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name)) if self.exists(name) else schemas.empty(self.spark, schema)

    def append(self, df: DataFrame, name: str, partitions: list[str], order: str = "docId", once: str | None = None) -> None:
        """Append, files of rows_per_file rows; sorted by `order` within. A partition's rows are dealt out by `order`, so that a large one is no single task.

        once: of rows with the same partition, `order` and this column one is written; that takes no shuffle of its own.
        """
        dealt = df.repartition(*partitions, order)
        w = (dealt.dropDuplicates([*partitions, order, once]) if once else dealt).sortWithinPartitions(*partitions, order).write.mode("append")
        w.option("maxRecordsPerFile", self.rows_per_file).partitionBy(*partitions).parquet(self.path(name))

    def overwrite_partitions(self, df: DataFrame, name: str, partitions: list[str]) -> None:
        """Replace the partitions that df has rows of; an option of this write, not of the session."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(self.path(name))

    def replace(self, df: DataFrame, name: str, partitions: list[str] | None = None) -> None:
        """Write beside, then swap by rename: df may read the table that it replaces."""
        beside = self.path(f".{name}-{uuid.uuid4().hex}")
        w = df.write.mode("overwrite")
        (w.partitionBy(*partitions) if partitions else w).parquet(beside)
        fs, new = self._fs(beside)
        _, old = self._fs(self.path(name))
        if fs.exists(old):
            fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"can't move {beside} to {self.path(name)}")
        self.spark.catalog.refreshByPath(self.path(name))

    def publish(self, df: DataFrame, name: str, partitions: list[str], at_ms: int, order: str = "docId") -> str:
        """An immutable snapshot, then the pointer to it; readers see the old one or the new one, whole."""
        rel = f"snapshots/{name}/{at_ms}-{uuid.uuid4().hex[:8]}"
        df.repartition(*partitions, order).sortWithinPartitions(*partitions, order).write.option("maxRecordsPerFile", self.rows_per_file).partitionBy(*partitions).parquet(self.path(rel))
        self._put(f"{name}.CURRENT.json", json.dumps({"path": rel, "publishedAtMs": at_ms}))
        return rel

    def current(self, name: str) -> str | None:
        fs, p = self._fs(self.path(f"{name}.CURRENT.json"))
        if not fs.exists(p):
            return None
        text = "\n".join(r.value for r in self.spark.read.text(p.toString()).collect())  # one line
        return self.path(json.loads(text)["path"])

    def snapshot(self, name: str, schema: str) -> DataFrame:
        path = self.current(name)
        return self.spark.read.schema(schema).parquet(path) if path else schemas.empty(self.spark, schema)

    def _put(self, name: str, text: str) -> None:
        fs, tmp = self._fs(self.path(f".{name}-{uuid.uuid4().hex}"))
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, to = self._fs(self.path(name))
        fs.delete(to, False)
        if not fs.rename(tmp, to):
            raise OSError(f"can't write {name}")

    def record_metrics(self, row: dict) -> None:
        """The run's metrics and the newest ones before it, as Parquet and as one CSV file, newest first."""
        now = self.spark.createDataFrame([row], schemas.METRICS)
        rows = newest(self.read("metrics", schemas.METRICS), 1).unionByName(now).orderBy(F.desc("runAtMs")).collect()  # two rows
        both = self.spark.createDataFrame(rows, schemas.METRICS).coalesce(1)
        self.replace(both, "metrics")
        lines = [",".join(both.columns), *(",".join(str(r[c]) for c in both.columns) for r in rows)]
        self._put("run_metrics.csv", "\n".join(lines) + "\n")

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Remove all but the newest snapshots."""
        fs, p = self._fs(self.path(f"snapshots/{name}"))
        if fs.exists(p):
            paths = sorted((s.getPath().toString() for s in fs.listStatus(p)), key=lambda x: int(x.rsplit("/", 1)[1].split("-")[0]))
            for old in paths[:-keep]:
                fs.delete(self._fs(old)[1], True)


def newest(metrics: DataFrame, n: int) -> DataFrame:
    return metrics.orderBy(F.desc("runAtMs")).limit(n)


def single_csv(df: DataFrame, store: Store, name: str) -> None:
    """A small frame as one CSV file of exactly that name, with a header."""
    beside = store.path(f".csv-{uuid.uuid4().hex}")
    df.coalesce(1).write.option("header", "true").csv(beside)
    fs, folder = store._fs(beside)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    _, to = store._fs(store.path(name))
    fs.delete(to, False)
    fs.rename(part, to)
    fs.delete(folder, True)
