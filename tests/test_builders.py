import pytest
from pyspark.sql import functions as F

from splitloom.operators import joins
from splitloom.operators.validate import fold_leakage, split_leakage, split_summary, validate_splits
from splitloom.plans.splits import cv_split, iter_splits, read_splits, train_test_split


@pytest.fixture(scope="module")
def thousand(spark):
    """A thousand rows of ten targets, the first half for training."""
    return spark.range(0, 1000, 1, 4).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 500, F.lit("train")).otherwise(F.lit("test")).alias("data_type"),
        (F.col("id") % 10).cast("string").alias("y"),
    )


def _halves(table):
    return table.where("data_type = 'train'"), table.where("data_type = 'test'")


def test_limited_train_test_split(spark, thousand):
    splits = train_test_split(*_halves(thousand), target="y", max_targets=4, max_docs_per_target=7)
    assert splits.select("target").distinct().count() == 4
    counts = {
        (r.role, r.target): r["count"] for r in splits.groupBy("role", "target").count().collect()
    }
    assert {n for (role, _), n in counts.items() if role == "train"} == {7}
    assert {n for (role, _), n in counts.items() if role == "test"} == {50}


def test_limited_cross_validation(spark, thousand):
    splits = cv_split(thousand, target="y", max_targets=4, max_docs_per_target=7)
    assert splits.select("target").distinct().count() == 4
    train = splits.where("role = 'train'").groupBy("split_id", "target").count()
    assert train.count() == 20
    assert {r["count"] for r in train.collect()} == {7}
    # Test sides are whole: every document of the four targets exactly once.
    test = splits.where("role = 'test'")
    assert test.count() == 400 == test.select("doc_id").distinct().count()
    both = splits.groupBy("split_id", "doc_id").count().where("count > 1")
    assert both.isEmpty()


def test_unlimited_builders_keep_every_row(spark, thousand):
    assert train_test_split(*_halves(thousand), target="y").count() == 1000
    assert cv_split(thousand, target="y", n_splits=4).count() == 4000


def test_unseen_test_targets_vanish(spark):
    train = spark.createDataFrame([(1, "A"), (2, None)], "doc_id long, author string")
    test = spark.createDataFrame([(3, "A"), (4, "B"), (5, None)], "doc_id long, author string")
    splits = train_test_split(train, test)
    assert sorted(r.doc_id for r in splits.collect()) == [1, 2, 3, 5]
    capped = train_test_split(train, test, max_docs_per_target=1)
    assert sorted(r.doc_id for r in capped.collect()) == [1, 3, 5]


def test_too_many_targets_or_documents_asked(spark, thousand):
    with pytest.raises(Exception, match="fewer than 11 targets"):
        train_test_split(*_halves(thousand), target="y", max_targets=11).collect()
    with pytest.raises(Exception, match="fewer than 51 documents"):
        train_test_split(*_halves(thousand), target="y", max_docs_per_target=51).collect()


def test_no_broadcast_beyond_the_limit(spark, thousand, monkeypatch):
    expected = sorted(train_test_split(*_halves(thousand), target="y", max_targets=4).collect())
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        splits = train_test_split(*_halves(thousand), target="y", max_targets=4)
        plan = splits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert sorted(splits.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_model_selection_loop(spark, thousand):
    splits = cv_split(thousand, target="y", n_splits=3, max_docs_per_target=5).cache()
    seen = 0
    for split_id, train, test in iter_splits(splits, thousand):
        assert train.count() == 50 and "data_type" in train.columns
        seen += test.count()
    assert seen == 1000


def test_the_plan_of_splits_runs_once(spark, thousand, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    splits = cv_split(thousand, target="y", n_splits=4).cache()
    counted = splits.mapInPandas(count, splits.schema)
    path = str(tmp_path / "splits")
    got = {split_id: (train.count(), test.count()) for split_id, train, test in iter_splits(counted, thousand, path=path)}
    assert got == {str(n): (750, 250) for n in range(4)}
    assert ran.value == 4000
    one = read_splits(spark, path).where("split_id = '2' AND role = 'test'")
    assert "PartitionFilters: [isnotnull(split_id" in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(one.collect()) == sorted(splits.where("split_id = '2' AND role = 'test'").collect())


def test_violations_are_counted(spark):
    rows = [
        ("a", "train", 1, "A"), ("a", "train", 2, "A"), ("a", "test", 3, "B"), ("a", "test", 4, None),
        ("b", "train", 1, "A"),
    ]
    splits = spark.createDataFrame(rows, "split_id string, role string, doc_id long, target string")
    found = {(r.split_id, r.rule): r.n_violations for r in validate_splits(splits).collect()}
    assert found["a", "two_train_classes"] == 1
    assert found["a", "test_classes_in_train"] == 2
    assert found["a", "every_row_has_a_target"] == 1
    assert found["a", "two_train_rows"] == 0 and found["b", "two_train_rows"] == 1
    assert found["a", "one_test_row"] == 0 and found["b", "one_test_row"] == 1
    assert split_summary(splits).where("split_id = 'a'").first().n_train_targets == 1


def test_leaks_are_found(spark):
    rows = [("0", "train", "x"), ("0", "train", "x"), ("0", "test", "x"), ("0", "test", "y"), ("0", "test", None)]
    splits = spark.createDataFrame(rows, "split_id string, role string, key string")
    leak = split_leakage(splits, "key").first()
    assert (leak.n_repeated_in_train, leak.n_repeated_in_test, leak.n_on_both_sides) == (1, 0, 1)


def test_fold_leaks_equal_those_of_the_long_form(spark, thousand):
    from splitloom.operators.folds import stratified_kfold
    from splitloom.plans.splits import fan_out_folds

    # A third of the texts are copies of one.
    key = F.when(F.col("doc_id") % 3 == 0, F.lit("copy")).otherwise((F.col("doc_id") % 300).cast("string"))
    folds = stratified_kfold(thousand, "y").withColumn("key", key)
    long = fan_out_folds(folds, 5).join(folds.select("doc_id", "key"), "doc_id")
    assert sorted(fold_leakage(folds, "key", 5).collect()) == sorted(split_leakage(long, "key").collect())


def test_a_builder_that_passes_the_checks(spark, thousand):
    splits = cv_split(thousand, target="y", max_docs_per_target=7)
    assert validate_splits(splits).where("n_violations > 0").isEmpty()
    leaks = split_leakage(splits, "doc_id")
    assert leaks.where("n_on_both_sides + n_repeated_in_train + n_repeated_in_test > 0").isEmpty()
