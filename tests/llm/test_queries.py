"""Registered queries against their DuckDB texts, and the pipeline."""

from __future__ import annotations

from collections import Counter

import oracle
import pytest
from fixtures_llm import documents, empty, shingles

import corpus_pipeline
from gustframe.llm import quality_rules, queries, secret_scan, unigram

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    ok, why = oracle.compare(queries.QUERIES[name](spark, SF), oracle.duck(SF), queries.ORACLE[name])
    assert ok, why


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    good, one, red, mixed, ids = seen[1:]
    assert all(d.columns == columns for d in (good, one, red, mixed))
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == {d for d, k in judged.items() if k}
    texts = [(r.doc_id, shingles(r.text)) for r in one.select("doc_id", "text").collect()]
    by = Counter()
    for _, s in texts:
        by.update(s)
    for i, (_, a) in enumerate(texts):  # nothing similar is left
        if any(by[x] > 1 for x in a):
            assert not any(5 * len(a & b) >= 4 * len(a | b) for _, b in texts[:i])
    assert all(not secret_scan.find_spans(r.text) for r in red.select("text").collect())
    assert red.count() == one.count()
    codec = unigram.Codec(unigram.load_model())
    want = Counter((r.doc_id, tuple(codec.encode(r.text).tolist())) for r in mixed.select("doc_id", "text").collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.select("doc_id", "ids").collect()) == want


def test_pipeline_stages_on_edge_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra
    columns; and a table without rows."""
    edge = documents(spark)
    for docs in (edge, empty(edge)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).cache()
            if name == "sentencepiece":
                assert out.where("not round_trip").count() == 0
            else:
                assert out.columns == edge.columns and dict(out.dtypes) == dict(edge.dtypes)
                given = {tuple(r) for r in edge.collect()}
                assert name == "secret_scan" or {tuple(r) for r in out.collect()} <= given
            docs = out
        assert n or docs.count() == 0


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"] and got.where("not round_trip").count() == 0 and got.count() > 50


def test_entry_has_all_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert [int(n.split("_")[0][2:]) for n in queries.QUERIES] == list(range(1, 14))
