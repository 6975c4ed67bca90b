import random

import pytest
from pyspark.sql import functions as F

from splitloom.operators.heldout import (
    REST,
    one_title_split,
    split_heldout_title,
    split_heldout_titles,
    title_overlap,
    title_plan,
    title_splits,
    untested_titles,
)
from splitloom.operators.validate import split_summary, title_split_languages, title_split_summary, validate_language_split

SCHEMA = "doc_id long, author string, language string, title string"


def _corpus(seed, rows=250):
    draw = random.Random(seed)
    result = []
    for i in range(rows):
        author = draw.choice(["a", "a", "a", "b", "c", "d", "e", None])
        title = None if draw.random() < 0.05 else f"{author}{draw.randrange(6)}"
        language = None if draw.random() < 0.05 else draw.choice(["en", "es", "de"])
        result.append((i, author, language, title))
    return result


def _by_sets(rows, language):
    """Splits as sets of ids: one per title seen on both sides, then the rest."""
    test = [r for r in rows if r[2] == language]
    train = [r for r in rows if r[2] != language]
    titles = {r[3] for r in test} - {None}
    shared = titles & {r[3] for r in train}
    splits = {}
    for title in shared:
        left = [r for r in train if r[3] != title]
        tested = [r for r in test if r[3] == title]
        if {r[1] for r in tested} <= {r[1] for r in left}:
            splits[title] = ({r[0] for r in left}, {r[0] for r in tested})
    splits[REST] = ({r[0] for r in train}, {r[0] for r in test if r[3] in titles - shared})
    return splits


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_set_form(spark, seed):
    rows = _corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    for language in ("en", "es"):
        assigned = split_heldout_title(docs, language).cache()
        # One row per document at most, so that the size stays linear.
        assert assigned.count() == assigned.select("doc_id").distinct().count()
        found = {}
        for split_id, split in title_splits(assigned):
            sides = {"train": set(), "test": set()}
            for row in split.collect():
                sides[row.role].add(row.doc_id)
            found[split_id] = (sides["train"], sides["test"])
        assert found == _by_sets(rows, language)


def _small(spark):
    rows = [
        (1, "a", "en", "t1"), (2, "a", "es", "t1"),  # the only training text of a: no split
        (3, "b", "en", "t2"), (4, "b", "es", "t2"), (5, "b", "es", "t3"),  # a split
        (6, "c", "en", "t4"),  # never trained on, in the rest
        (7, "b", "en", "t5"),  # in the rest
        (8, "b", "en", None),  # never tested
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_coverage(spark):
    docs = _small(spark)
    plan = {r.title: r for r in title_plan(docs, ["en"]).collect()}
    assert {t: r.split_id for t, r in plan.items()} == {"t1": None, "t2": "t2", "t4": REST, "t5": REST}
    assert (plan["t2"].n_test, plan["t2"].n_removed) == (1, 1)
    strict = {r.title: r.split_id for r in title_plan(docs, ["en"], require_coverage=True).collect()}
    assert strict == {"t1": None, "t2": "t2", "t4": None, "t5": REST}
    rest = one_title_split(split_heldout_title(docs, "en", require_coverage=True), REST)
    assert {(r.role, r.doc_id) for r in rest.collect()} == {("train", 2), ("train", 4), ("train", 5), ("test", 7)}


def test_title_sets(spark):
    docs = _small(spark)
    found = title_overlap(docs.where("language = 'es'"), docs.where("language = 'en'"))
    assert {r.title: r.overlaps for r in found.collect()} == {"t1": True, "t2": True, "t4": False, "t5": False}
    assert {r.title for r in untested_titles(docs, ["en"]).collect()} == {"t1", "t3"}
    assert {r.title for r in untested_titles(docs, ["en", "es"]).collect()} == {"t1"}


def test_summaries_of_the_compact_form_equal_those_of_all_rows(spark):
    rng = random.Random(3)
    rows = [
        (n, rng.choice(["A", "B", "C", None]), rng.choice(["en", "de", "fr", None]), rng.choice(["t1", "t2", "t3", "t4", None]))
        for n in range(60)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, author string, language string, title string")
    assigned = split_heldout_titles(docs, ["en", "de", "xx"])
    summary = {tuple(row)[:2]: tuple(row)[2:] for row in title_split_summary(assigned).collect()}
    spoken = assigned.join(docs.select("doc_id", "language"), "doc_id")
    languages = {tuple(row)[:2]: tuple(row)[2:] for row in title_split_languages(spoken).collect()}
    seen = 0
    for name in ("en", "de", "xx"):
        for split_id, split in title_splits(assigned.where(F.col("test_language") == name)):
            seen += 1
            assert summary[name, split_id] == tuple(split_summary(split).first())[1:]
            told = split.join(docs.select("doc_id", "language"), "doc_id")
            assert languages[name, split_id] == tuple(validate_language_split(told).first())[1:]
    assert seen == len(summary) == len(languages)
