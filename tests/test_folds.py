import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from splitloom.operators import folds as module
from splitloom.operators.folds import attach_folds, fold_cuts, stratified_kfold
from splitloom.plans.splits import iter_folds


def expected_folds(labels: list[str], k: int) -> list[int]:
    """By definition: deal the labels, sorted by first occurrence, round robin to k hands."""
    first = list(dict.fromkeys(labels))
    ordered = sorted(first.index(label) for label in labels)
    hands = [ordered[i::k] for i in range(k)]
    queue = {
        label: [i for i in range(k) for _ in range(hands[i].count(n))] for n, label in enumerate(first)
    }
    taken = defaultdict(int)
    result = []
    for label in labels:
        result.append(queue[label][taken[label]])
        taken[label] += 1
    return result


def _table(spark, labels, ids=None):
    ids = ids or range(len(labels))
    return spark.createDataFrame(list(zip(ids, labels, strict=True)), "doc_id long, author string")


def _folds(df):
    return [row.fold for row in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
@pytest.mark.parametrize("k", [2, 5, 7])
def test_equals_the_definition(spark, k, rows_per_bucket):
    draw = random.Random(k)
    # One label has a third of all rows, others are rare.
    labels = [draw.choice("AAAABBCDEFG" + "abcdefghij"[: k + 2]) for _ in range(600)]
    table = _table(spark, labels).repartition(5)
    found = stratified_kfold(table, n_splits=k, rows_per_bucket=rows_per_bucket)
    assert _folds(found) == expected_folds(labels, k)


def test_ids_may_lie_in_clusters(spark):
    draw = random.Random(3)
    labels = [draw.choice("AAAB") for _ in range(400)]
    ids = [i if i < 300 else 2**62 + i * 2**40 for i in range(400)]
    found = stratified_kfold(_table(spark, labels, ids), n_splits=4, rows_per_bucket=25)
    assert _folds(found) == expected_folds(labels, 4)


def test_sorted_labels_and_empty_folds(spark):
    labels = ["A"] * 50 + ["B"] + ["C"] * 3 + ["D"] * 2
    with pytest.warns(UserWarning, match="smallest class has 1"):
        found = stratified_kfold(_table(spark, labels), n_splits=5, rows_per_bucket=7)
    assert _folds(found) == expected_folds(labels, 5)


def test_errors(spark):
    table = _table(spark, ["A", "A", "B", "B"])
    with pytest.raises(ValueError, match="two folds"):
        fold_cuts(table, n_splits=1)
    with pytest.raises(ValueError, match="no class"):
        fold_cuts(table, n_splits=3)
    with pytest.raises(ValueError, match="no class"):
        fold_cuts(table.limit(0))
    with pytest.raises(Exception, match="without target"):
        fold_cuts(_table(spark, ["A", "A", None]), n_splits=2)


def test_same_folds_without_broadcast(spark, monkeypatch):
    draw = random.Random(9)
    labels = [draw.choice("AAAABC") for _ in range(300)]
    monkeypatch.setattr(module, "broadcast_if_small", lambda df: df.hint("merge"))
    found = stratified_kfold(_table(spark, labels), n_splits=3, rows_per_bucket=30)
    assert _folds(found) == expected_folds(labels, 3)


def test_wide_rows_are_not_shuffled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folded = attach_folds(docs, fold_cuts(docs, "source"), "source")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan


def test_folds_for_model_selection(spark):
    labels = ["A", "B"] * 20
    table = _table(spark, labels).withColumn("text", F.lit("x"))
    seen = []
    for _, train, test in iter_folds(table, fold_cuts(table, n_splits=4), 4):
        assert train.count() == 30 and "text" in test.columns
        seen += [row.doc_id for row in test.collect()]
    assert sorted(seen) == list(range(40))


def test_fold_column_drives_model_selection(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    table = _table(spark, ["A", "B"] * 20).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    folded = attach_folds(table, fold_cuts(table, n_splits=4)).withColumn("fold", F.col("fold").cast("int"))
    rows = VectorAssembler(inputCols=["label", "doc_id"], outputCol="features").transform(folded)
    search = CrossValidator(
        estimator=NaiveBayes(), estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(), numFolds=4, foldCol="fold",
    )
    assert len(search.fit(rows).avgMetrics) == 1
