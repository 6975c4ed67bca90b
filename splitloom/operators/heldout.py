"""Held-out titles: a work seen in two languages is tested in one, never trained on.

The splits of one test language are described by titles, and by documents in
linear size: each test document belongs to one split, and each training document
is missing from at most one. So one row per document says it all, and every split
is a filter of these rows. Rows for every title and training document, which would
be their product, are never made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitloom.operators.joins import lookup_side

REST = "*rest*"


def title_overlap(train: DataFrame, test: DataFrame, title: str = "title") -> DataFrame:
    """Titles of the test side, and whether the train side has them too."""
    seen = train.select(title, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(title, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    sides = seen.groupBy(title).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.where((F.col("b") == 1) & F.col(title).isNotNull()).select(
        title, (F.col("a") == 1).alias("overlaps")
    )


def title_plan(
    docs: DataFrame,
    test_languages: Sequence[str],
    require_coverage: bool = False,
    author: str = "author",
    language: str = "language",
    title: str = "title",
) -> DataFrame:
    """For every test language and title of it, its split.

    Columns: test_language, title, overlaps, covered, split_id, n_test, n_removed.
    A title on both sides is a split of its own if each of its authors keeps
    another training document, and no split otherwise. All titles of the test
    side alone share one split; `require_coverage` drops those with an author
    who has no training document.
    """
    counts = docs.groupBy(
        F.col(title).alias("title"), F.col(author).alias("author"), F.col(language).alias("language")
    ).agg(F.count("*").alias("n"))
    tests = F.array(*[F.lit(name) for name in test_languages])
    cells = (
        counts.withColumn("test_language", F.explode(tests))
        .withColumn("tested", F.col("language").eqNullSafe(F.col("test_language")))
        .groupBy("test_language", "title", "author")
        .agg(
            F.sum(F.when(F.col("tested"), F.col("n")).otherwise(0)).alias("n_test"),
            F.sum(F.when(F.col("tested"), 0).otherwise(F.col("n"))).alias("n_train"),
        )
    )
    authors = cells.groupBy(
        F.col("test_language").alias("_l"), F.col("author").alias("_a")
    ).agg(F.sum("n_train").alias("n_author"))
    known = cells.join(
        authors,
        (F.col("test_language") == F.col("_l")) & F.col("author").eqNullSafe(F.col("_a")),
    )
    left_over = F.col("n_author") - F.col("n_train")
    titles = (
        known.where(F.col("title").isNotNull())
        .groupBy("test_language", "title")
        .agg(
            F.sum("n_test").alias("n_test"),
            F.sum("n_train").alias("n_removed"),
            F.coalesce(F.bool_and(F.when(F.col("n_test") > 0, left_over > 0)), F.lit(True)).alias("covered"),
        )
        .where("n_test > 0")
        .withColumn("overlaps", F.col("n_removed") > 0)
    )
    rest = ~F.col("overlaps")
    if require_coverage:
        rest = rest & F.col("covered")
    split = F.when(F.col("overlaps") & F.col("covered"), F.col("title")).when(rest, F.lit(REST))
    return titles.select(
        "test_language", "title", "overlaps", "covered", split.alias("split_id"), "n_test", "n_removed"
    )


def split_heldout_titles(
    docs: DataFrame,
    test_languages: Sequence[str],
    require_coverage: bool = False,
    author: str = "author",
    language: str = "language",
    title: str = "title",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(test_language, role, split_id, not_in_split, doc_id, target), a row per language and document.

    A test document has the `split_id` that tests it. A training document has
    none, as it serves all splits but the one in `not_in_split`, if any.
    """
    columns = {"author": author, "language": language, "title": title}
    plan = title_plan(docs, test_languages, require_coverage, **columns)
    side = lookup_side(
        plan.where(F.col("split_id").isNotNull()).select(
            F.col("test_language").alias("_language"), F.col("title").alias("_title"), F.col("split_id").alias("_split")
        )
    )
    names = F.array(*[F.lit(name) for name in test_languages])
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(author).alias("target"),
        F.col(language).alias("_own"),
        F.col(title).alias("title"),
        F.explode(names).alias("test_language"),
    )
    # A train title with a split overlaps, since no title of the rest is in train.
    same = (F.col("test_language") == F.col("_language")) & (F.col("title") == F.col("_title"))
    placed = rows.join(side, same, "left")
    tested = F.col("_own").eqNullSafe(F.col("test_language"))
    return placed.where(~tested | F.col("_split").isNotNull()).select(
        "test_language",
        F.when(tested, F.lit("test")).otherwise(F.lit("train")).alias("role"),
        F.when(tested, F.col("_split")).alias("split_id"),
        F.when(~tested, F.col("_split")).alias("not_in_split"),
        "doc_id",
        "target",
    )


def split_heldout_title(docs: DataFrame, test_language: str, require_coverage: bool = False, **columns: str) -> DataFrame:
    """(role, split_id, not_in_split, doc_id, target), one row per document: the splits of one language."""
    return split_heldout_titles(docs, [test_language], require_coverage, **columns).drop("test_language")


def one_title_split(assigned: DataFrame, split_id: str) -> DataFrame:
    """The plain train and test rows of one split."""
    train = (F.col("role") == "train") & ~F.col("not_in_split").eqNullSafe(split_id)
    test = (F.col("role") == "test") & (F.col("split_id") == split_id)
    return assigned.where(train | test).select(
        F.lit(split_id).alias("split_id"), "role", "doc_id", "target"
    )


def title_splits(assigned: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """Each split in turn. The rest comes last, and always comes."""
    ids = assigned.where((F.col("role") == "test") & (F.col("split_id") != REST))
    for row in ids.select("split_id").distinct().orderBy("split_id").toLocalIterator():
        yield row[0], one_title_split(assigned, row[0])
    yield REST, one_title_split(assigned, REST)


def untested_titles(
    docs: DataFrame, test_languages: Sequence[str], title: str = "title", **columns: str
) -> DataFrame:
    """Titles that no split of any test language tests."""
    plan = title_plan(docs, test_languages, title=title, **columns)
    tested = plan.where(F.col("split_id").isNotNull()).select(F.col("title").alias(title))
    named = docs.where(F.col(title).isNotNull()).select(title).distinct()
    return named.join(tested, title, "left_anti")
