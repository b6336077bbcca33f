"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"build_incremental"}))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        r = con.sql(SQL[name])
        assert sorted(r.columns) == sorted(df.columns)
        at = [r.columns.index(c) for c in sorted(r.columns)]
        assert rows == sorted(str([plain(x[i]) for i in at]) for x in r.fetchall())


def test_flagship(spark):
    r = QUERIES["build_incremental"](spark, DATA).first()
    assert r.numChangedDocs == 200 and r.indexRows == r.numEmbeddingsWritten == r.numChunksWritten > 200
    assert r.rerunWork == 0 and r.context.startswith("[0] ")


@pytest.mark.parametrize("name", ["hit_blocks", "context_blocks", "context_from_hits", "pair_similarity"])
def test_scores_at_half_a_digit(spark, tmp_path, name):
    """Scores such as 0.06495 and -0.00001 are written with the digits that SQL gives them."""
    scores = [1.0, 0.06495, 0.00015, -0.00001, -0.06495, 0.12345, -0.0000001, 0.00005, 0.99985]
    spark.createDataFrame([(i, f"text {i} of some more words than forty characters hold", "en", "src", 10) for i in range(len(scores))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [s, (1 - s * s) ** 0.5], 0) for i, s in enumerate(scores)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    r = con.sql(SQL[name])
    df = QUERIES[name](spark, str(tmp_path)).select(r.columns)
    assert sorted(map(repr, df.collect())) == sorted(repr(type(df.first())(**dict(zip(r.columns, x, strict=True)))) for x in r.fetchall())


def test_index_join_reads_texts_once(spark):
    df = QUERIES["index_join"](spark, DATA)
    assert "documents.parquet" not in "".join(df.inputFiles())  # they were cut before
