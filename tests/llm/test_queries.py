"""The registered queries and the pipeline over the test tables."""

from __future__ import annotations

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from splitloom.llm import simhash
from splitloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == ""


@pytest.mark.parametrize("name", ["op1_mixing", "op6_secrets", "op10_bottomk"])
def test_native_plans_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == columns and 0.8 < clean.count() / docs.count() < 1
    single = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    classes = simhash.near_duplicates(docs).agg(F.countDistinct("component_id")).first()[0]
    assert single.columns == columns and single.count() == classes
    masked = corpus_pipeline.mask_secrets(spark, docs, sf_dir)
    assert masked.columns == columns and masked.count() == docs.count()
    assert masked.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    mixed = corpus_pipeline.mix_languages(spark, docs, sf_dir)
    assert mixed.columns == columns and mixed.select("doc_id").distinct().count() == docs.count()
