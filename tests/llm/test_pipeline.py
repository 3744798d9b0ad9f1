"""The pipeline, its registration, and queries over a given table."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from gaugeline.llm import catalogue, common


def test_stages_keep_columns_and_shrink(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.saved(stage(spark, docs, sf_dir), "stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0.5 * docs.count() < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_stages_on_odd_rows(spark, odd, sf_dir):
    docs = odd.drop("token").withColumnRenamed("n", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            assert stage(spark, df, sf_dir).count() <= df.count()


def test_names_and_line_oracle(spark, sf_dir):
    assert sorted(int(k[2:].split("_")[0]) for k in catalogue.QUERIES) == list(range(1, 14))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for name, sql in catalogue.ORACLES.items():
        got = catalogue.QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        want = con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)
