"""Registered queries of this package against DuckDB, and the pipeline stage by stage."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from helpers import near_components

import __spark_entry__ as entry_points
import corpus_pipeline
from tapecheck.llm import queries

SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("no test data", allow_module_level=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = sorted(([r[names.index(c)] for c in columns] for r in rel.fetchall()), key=str)
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=str) == want


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert "pipeline" in entry_points.queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, docs, SF)
        assert df.columns == docs.columns
        left = {r.doc_id: r.text for r in df.collect()}
        assert set(left) <= set(kept) and all(left[i] == texts[i] for i in left)
        if name == "exact dedup":
            assert len(left) == len({t.lower() for t in kept.values()}) == len({t.lower() for t in left.values()})
        elif name == "near dedup":
            assert set(left) == {c for _, c in near_components(list(kept.items()), 5, 80).values()}
        elif name == "decontamination":
            plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(left) == {i for i, t in kept.items() if not any(x in plain(t) for x in items)}
        kept, docs = left, spark.createDataFrame(df.collect(), df.schema)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, t in kept.items() if t.split()}
    assert sum(r.length for r in packed) == sum(len(t.encode().split()) for t in kept.values())


def test_every_stage_takes_odd_and_empty_tables(spark):
    from helpers import documents, odd_rows

    for rows in (odd_rows(), []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert df.columns == docs.columns
            left = df.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                docs = spark.createDataFrame(left, docs.schema)
        assert bool(left) == bool(rows)
