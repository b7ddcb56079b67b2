"""The registered queries against SQL, and the pipeline against its stages done one by one."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import DATA, expected, got  # noqa: E402

import corpus_pipeline  # noqa: E402
from tilespark.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert got(queries.QUERIES[name](spark, DATA)) == expected(queries.ORACLE_SQL[name])


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert [d for *_, d in starts] == sorted(d for *_, d in starts)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, DATA)
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= kept
        kept, frame = ids, docs.where(docs.doc_id.isin(sorted(ids)))
    assert {d for *_, d in starts} == kept
