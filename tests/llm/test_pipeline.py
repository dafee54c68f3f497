"""The pipeline end to end on the smallest tables, and its stages against plain versions."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from fairload.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find_items(docs, bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in rows}


def test_run_gives_the_same_twice(spark):
    one, two = ({r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} for _ in range(2))
    assert one == two


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    names = __spark_entry__.queries()
    assert {n for n in names if n.startswith("op")} == set(queries.QUERIES) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_covers_its_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    if name not in ("op1_license_scan", "op6_decontaminate"):
        table, key = ("pages", "page_id") if name.startswith("op5") else ("documents", "doc_id")
        wanted = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
        assert found.count() == wanted.count() == found.select(key).intersect(wanted).count()
