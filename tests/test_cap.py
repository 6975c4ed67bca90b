import hashlib

import pytest
from pyspark.sql import functions as F

from splitloom.operators import cap as module
from splitloom.operators.cap import cap_docs_per_target
from splitloom.operators.targets import (
    attach_target,
    docs_per_target_bounds,
    restrict_targets,
    select_targets,
)


def _skewed(spark, rows=6000):
    # One author has a third of all documents.
    author = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), F.col("id") % 40))
    return spark.range(0, rows, 1, 16).select(F.col("id").alias("doc_id"), author.alias("author"))


@pytest.mark.parametrize("n", [1, 7, 50, 1500])
def test_exact_and_reproducible(spark, n):
    docs = _skewed(spark)
    kept = cap_docs_per_target(docs, n, on_short="keep")
    expected = set()
    by_author = {}
    for row in docs.collect():
        by_author.setdefault(row.author, []).append(row.doc_id)
    for author, ids in by_author.items():
        key = {i: hashlib.md5(f"42|document|{i}".encode()).hexdigest() for i in ids}
        expected |= {(author, i) for i in sorted(ids, key=key.get)[:n]}
    assert {(r.author, r.doc_id) for r in kept.collect()} == expected
    again = cap_docs_per_target(docs.repartition(3), n, on_short="keep")
    assert {(r.author, r.doc_id) for r in again.collect()} == expected


@pytest.mark.parametrize("spread", [True, False])
def test_thinning_changes_nothing(spark, monkeypatch, spread):
    # A hot group, one of a few rows, and one without key.
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") < 9, F.lit("few"))
    docs = spark.range(0, 6000, 1, 16).select(
        F.col("id").alias("doc_id"), key.alias("group"), F.lit("A").alias("author")
    )
    expected = set(map(tuple, cap_docs_per_target(docs, 5, keys=["group"]).collect()))
    monkeypatch.setattr(module, "ROWS_WORTH_THINNING", 1)
    if not spread:
        # Draws that all lie late, so that thinning finds too few and gives up.
        order = F.concat(F.lit("f"), F.md5(F.col("doc_id").cast("string")))
        late = docs.withColumn("_draw", order)
        kept = module.first_per_group(late, ["group"], 5)
        assert module._thinned(late, ["group"], 5, None) is late
        assert {r["count"] for r in kept.groupBy("group").count().collect()} == {5}
        return
    assert set(map(tuple, cap_docs_per_target(docs, 5, keys=["group"]).collect())) == expected
    drawn = docs.withColumn("_draw", F.md5(F.col("doc_id").cast("string")))
    assert module._thinned(drawn, ["group"], 5, None).count() < 300


def test_many_documents_per_target(spark, monkeypatch):
    docs = _skewed(spark)
    expected = {n: set(map(tuple, cap_docs_per_target(docs, n, on_short="keep").collect())) for n in (3, 90)}
    monkeypatch.setattr(module, "SMALL_LIMIT", 1)
    for n, rows in expected.items():
        kept = cap_docs_per_target(docs, n, on_short="keep")
        assert kept.columns == docs.columns
        assert set(map(tuple, kept.collect())) == rows
        assert kept.count() == len(rows)
    with pytest.raises(Exception, match="fewer than 1000 documents of a\\d"):
        cap_docs_per_target(docs, 1000).collect()
    assert cap_docs_per_target(docs, 90).count() == len(expected[90])


def test_rows_are_cut_before_they_are_shuffled(spark):
    kept = cap_docs_per_target(_skewed(spark), 7)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert kept.groupBy("author").count().agg(F.min("count"), F.max("count")).first() == (7, 7)


def test_short_targets(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "doc_id long, author string")
    with pytest.raises(Exception, match="fewer than 2 documents of B"):
        cap_docs_per_target(docs, 2).collect()
    kept = cap_docs_per_target(docs, 2, on_short="keep")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    for unlimited in (None, 0):
        assert cap_docs_per_target(docs, unlimited).count() == 4
    with pytest.raises(ValueError):
        cap_docs_per_target(docs, -1)
    with pytest.raises(ValueError):
        cap_docs_per_target(docs, 1, on_short="drop")


def test_targets(spark):
    docs = _skewed(spark)
    names = docs.select("author").distinct()
    assert select_targets(names, 5).count() == 5
    assert select_targets(names, 5, seed=1).collect() != select_targets(names, 5, seed=2).collect()
    with pytest.raises(Exception, match="fewer than 100 targets"):
        select_targets(names, 100).collect()
    bounds = docs_per_target_bounds(cap_docs_per_target(docs, 9)).first()
    assert (bounds.min_docs, bounds.max_docs) == (9, 9)


def test_missing_target_matches_missing_target(spark):
    docs = spark.createDataFrame([(1, "A"), (2, None), (3, "C")], "doc_id long, author string")
    listed = spark.createDataFrame([("A",), (None,)], "author string")
    assert {r.doc_id for r in restrict_targets(docs, listed).collect()} == {1, 2}


def test_attached_name_is_free(spark):
    docs = spark.createDataFrame([(1, 2, 3)], "doc_id int, y_0 int, Y_1 int")
    attached, name = attach_target(docs, F.col("doc_id"))
    assert name == "y_2" and attached.columns[-1] == "y_2"
