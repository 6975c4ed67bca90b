import pytest

from splitloom.operators.joins import attach_lookup
from splitloom.operators.predicates import (
    by_value_sets,
    exclude_rows,
    leave_one_out,
    predefined,
    require_values,
)
from splitloom.operators.prepare import drop_incomplete, with_default
from splitloom.operators.validate import validate_language_split, validate_paths
from splitloom.plans.splits import union_sides


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "A", "train"), (2, "B", "test"), (3, None, "train"), (4, "C", None)]
    return spark.createDataFrame(rows, "doc_id long, genre string, side string")


def _ids(df):
    return sorted(row.doc_id for row in df.collect())


def test_missing_value_is_trained_on(docs):
    train, test = leave_one_out(docs, "genre", "B")
    assert (_ids(train), _ids(test)) == ([1, 3, 4], [2])


def test_other_values_are_on_no_side(docs):
    assert [_ids(side) for side in predefined(docs, "side")] == [[1, 3], [2]]
    assert [_ids(side) for side in by_value_sets(docs, "genre", ["A"], ["B"])] == [[1], [2]]
    with pytest.raises(ValueError, match="both sides: A"):
        by_value_sets(docs, "genre", ["A", "B"], ["A"])


def test_values_must_occur(docs):
    require_values(docs, "genre", ["A", "B"], "train")
    with pytest.raises(ValueError, match="invalid test values of genre: X"):
        require_values(docs, "genre", ["A", "X"], "test")


def test_exclusion(spark, docs):
    assert _ids(exclude_rows(docs, "genre", ["A"])) == [2, 3, 4]
    table = spark.createDataFrame([("A",), ("A",), (None,)], "genre string")
    assert _ids(exclude_rows(docs, "genre", table)) == [2, 3, 4]


def test_union_by_name(spark, docs):
    other = spark.createDataFrame([("x", 9)], "extra string, doc_id long")
    both = union_sides(docs, other)
    assert {r.doc_id: r.role for r in both.collect()} == {1: "train", 2: "train", 3: "train", 4: "train", 9: "test"}
    assert both.where("doc_id = 9").first().genre is None


def test_lookup(spark, docs):
    truth = spark.createDataFrame([("A", 1, "new"), ("B", 2, "new")], "key string, n int, side string")
    with pytest.raises(Exception, match="no entry for"):
        attach_lookup(docs, truth, {"genre": "key"}).collect()
    kept = {r.doc_id: (r.n, r.side) for r in attach_lookup(docs, truth, {"genre": "key"}, "keep").collect()}
    assert kept == {1: (1, "new"), 2: (2, "new"), 3: (None, "train"), 4: (None, None)}
    assert attach_lookup(docs, truth.limit(0), {"genre": "key"}).columns == docs.columns
    with pytest.raises(ValueError):
        attach_lookup(docs, truth, {"genre": "key"}, "drop")


def test_incomplete_rows(spark):
    rows = [(1, "text", 1.0), (2, "NA", 1.0), (3, "", 1.0), (4, None, 1.0), (5, "null", 1.0),
            (6, "text", float("nan")), (7, "text", None), (8, "n/a?", 2.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n double")
    assert _ids(drop_incomplete(table)) == [1, 8]


def test_default_column(docs):
    assert with_default(docs, "language", "en").first().language == "en"
    assert with_default(docs, "genre", "en").columns == docs.columns


def test_languages_of_sides(spark):
    rows = [("a", "train", "en"), ("a", "test", "es"), ("b", "train", "es"), ("b", "test", "es")]
    splits = spark.createDataFrame(rows, "split_id string, role string, language string")
    found = {r.split_id: r for r in validate_language_split(splits).collect()}
    assert found["a"].n_shared_languages == 0 and found["b"].n_shared_languages == 1


def test_paths(spark):
    rows = [("x", "x", "t/x_1", "s/x"), ("x", "y", "t/x_1", "s/x"), ("x", "x", None, "s/y")]
    table = spark.createDataFrame(rows, "author string, target string, text_path string, stanza string")
    assert tuple(validate_paths(table).first()) == (3, 1, 2, 2)
