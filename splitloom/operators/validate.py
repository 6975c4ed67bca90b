"""Checks that splits can be trained on and leak nothing, as counts of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.operators.heldout import REST
from splitloom.operators.joins import stored

SPLIT = ("split_id",)


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def split_summary(splits: DataFrame, keys: Sequence[str] = SPLIT) -> DataFrame:
    """Rows and targets of each side, and test targets that training never sees."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    # Missing targets are one group; the count of targets leaves it out.
    targets = splits.groupBy(*keys, "target").agg(
        F.count_if(train).alias("train"), F.count_if(test).alias("test")
    )
    named = F.col("target").isNotNull()
    return targets.groupBy(*keys).agg(
        F.sum("train").alias("n_train"),
        F.sum("test").alias("n_test"),
        F.count_if(named & (F.col("train") > 0)).alias("n_train_targets"),
        F.count_if(named & (F.col("test") > 0)).alias("n_test_targets"),
        F.count_if((F.col("train") == 0) & (F.col("test") > 0)).alias("n_unseen_targets"),
        F.sum(F.when(named, 0).otherwise(F.col("train") + F.col("test"))).alias("n_null_targets"),
    )


def validate_splits(splits: DataFrame, keys: Sequence[str] = SPLIT) -> DataFrame:
    """(keys, rule, n_violations) for every split and structural rule."""
    return violations(split_summary(splits, keys), keys)


def violations(summary: DataFrame, keys: Sequence[str] = SPLIT) -> DataFrame:
    """The same from the rows of `split_summary` or `title_split_summary`."""
    n = F.col
    rules = {
        "two_train_classes": F.when(n("n_train_targets") < 2, 1).otherwise(0),
        "test_classes_in_train": n("n_unseen_targets"),
        "two_train_rows": F.when(n("n_train") < 2, 1).otherwise(0),
        "one_test_row": F.when(n("n_test") < 1, 1).otherwise(0),
        "every_row_has_a_target": n("n_null_targets"),
    }
    listed = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), count.cast("long").alias("n_violations"))
            for rule, count in rules.items()
        ]
    )
    return summary.select(*keys, F.inline(listed))


def _title_cells(assigned: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Per split of the compact title form: rows by value; and the totals of each test language.

    A split trains on all training rows of its language but those removed for it, so only
    values with a tested or a removed row need a cell. `train` is what is left of a value.
    """
    keys = ["test_language", "_value"]
    rows = assigned.select(
        "test_language", F.col(value).alias("_value"), (F.col("role") == "test").alias("_test"),
        F.coalesce("split_id", "not_in_split").alias("split_id"),
    )
    counts = rows.groupBy(*keys, "split_id", "_test").agg(F.count("*").alias("n"))
    counts = stored(counts)
    totals = counts.where("NOT _test").groupBy(*keys).agg(F.sum("n").alias("total"))
    cells = counts.where("split_id IS NOT NULL").groupBy(*keys, "split_id").agg(
        F.sum(F.when(F.col("_test"), F.col("n")).otherwise(0)).alias("test"),
        F.sum(F.when(F.col("_test"), 0).otherwise(F.col("n"))).alias("removed"),
    )
    side = totals.select(F.col("test_language").alias("_l"), F.col("_value").alias("_v"), "total")
    same = (F.col("test_language") == F.col("_l")) & F.col("_value").eqNullSafe(F.col("_v"))
    joined = cells.join(side, same, "left").drop("_l", "_v")
    total = F.coalesce("total", F.lit(0))
    return joined.withColumn("total", total).withColumn("train", total - F.col("removed")), totals


def _title_counts(assigned: DataFrame, cells: DataFrame, totals: DataFrame, *figures: Column) -> DataFrame:
    """One row per split: sums over its cells beside the totals of its language. The rest is a split even if empty."""
    named = F.col("_value").isNotNull()
    by_language = totals.groupBy("test_language").agg(
        F.sum("total").alias("_rows"), F.count_if(named).alias("_values"),
        F.coalesce(F.sum(F.when(~named, F.col("total"))), F.lit(0)).alias("_nameless"),
    )
    rest = assigned.select("test_language", F.lit(REST).alias("split_id")).distinct()
    every = cells.unionByName(rest, allowMissingColumns=True)
    summed = every.groupBy("test_language", "split_id").agg(
        F.coalesce(F.sum("test"), F.lit(0)).alias("n_test"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("_removed"),
        F.count_if(named & (F.col("removed") > 0) & (F.col("train") == 0)).alias("_lost"),
        *figures,
    )
    joined = summed.join(by_language, "test_language", "left").na.fill(0, ["_rows", "_values", "_nameless"])
    return joined.withColumn("n_train", F.col("_rows") - F.col("_removed"))


def title_split_summary(assigned: DataFrame) -> DataFrame:
    """`split_summary` of all held-out title splits, by test language, from their compact form.

    `assigned` is what `split_heldout_titles` gives. What a split trains on is counted as all rows
    less the removed ones, so its rows are never made.
    """
    cells, totals = _title_cells(assigned, "target")
    named = F.col("_value").isNotNull()
    counted = _title_counts(
        assigned, cells, totals,
        F.count_if(named & (F.col("test") > 0)).alias("n_test_targets"),
        F.count_if((F.col("test") > 0) & (F.col("train") == 0)).alias("n_unseen_targets"),
        F.coalesce(F.sum(F.when(~named, F.col("test") - F.col("removed"))), F.lit(0)).alias("_null_rows"),
    )
    return counted.select(
        "test_language", "split_id", "n_train", "n_test", (F.col("_values") - F.col("_lost")).alias("n_train_targets"),
        "n_test_targets", "n_unseen_targets", (F.col("_nameless") + F.col("_null_rows")).alias("n_null_targets"),
    )


def title_split_languages(assigned: DataFrame, language: str = "language") -> DataFrame:
    """`validate_language_split` of all held-out title splits from their compact form, which carries the language."""
    cells, totals = _title_cells(assigned, language)
    counted = _title_counts(
        assigned, cells, totals,
        F.count_if(F.col("test") > 0).alias("n_test_languages"),
        F.count_if((F.col("test") > 0) & (F.col("train") > 0)).alias("n_shared_languages"),
        F.count_if(F.col("_value").isNull() & (F.col("removed") > 0) & (F.col("train") == 0)).alias("_lost_nameless"),
    )
    # Documents without language count as one language, as in the long form.
    nameless = F.when(F.col("_nameless") > 0, 1).otherwise(0)
    return counted.select(
        "test_language", "split_id", (F.col("_values") + nameless - F.col("_lost") - F.col("_lost_nameless")).alias("n_train_languages"),
        "n_test_languages", "n_shared_languages", "n_train", "n_test",
    )


def split_leakage(splits: DataFrame, key: str, keys: Sequence[str] = SPLIT) -> DataFrame:
    """Documents twice on one side or on both, told apart by a key such as a text hash.

    `splits` carries the key. One hot key, copied into many rows, is counted
    inside the scan tasks before anything is shuffled.
    """
    seen = splits.where(F.col(key).isNotNull()).groupBy(*keys, key).agg(
        F.count_if(F.col("role") == "train").alias("train"),
        F.count_if(F.col("role") == "test").alias("test"),
    )
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("train") > 1).alias("n_repeated_in_train"),
        F.count_if(F.col("test") > 1).alias("n_repeated_in_test"),
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("n_on_both_sides"),
    )


def fold_leakage(folds: DataFrame, key: str, n_splits: int) -> DataFrame:
    """`split_leakage` of all splits of a k-fold, from the folds without fanning out."""
    counts = folds.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.count_if(F.col("fold") == i).alias(f"_{i}") for i in range(n_splits)]
    )
    total = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(n_splits)])
    measures = []
    for i in range(n_splits):
        test = F.col(f"_{i}")
        train = total - test
        measures += [
            F.count_if(train > 1).alias(f"r{i}"),
            F.count_if(test > 1).alias(f"t{i}"),
            F.count_if((train > 0) & (test > 0)).alias(f"b{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(str(i)).alias("split_id"),
                F.col(f"r{i}").alias("n_repeated_in_train"),
                F.col(f"t{i}").alias("n_repeated_in_test"),
                F.col(f"b{i}").alias("n_on_both_sides"),
            )
            for i in range(n_splits)
        ]
    )
    return counts.agg(*measures).select(F.inline(rows))


def validate_language_split(
    splits: DataFrame, language: str = "language", keys: Sequence[str] = SPLIT
) -> DataFrame:
    """Languages per side, and how many are on both. `splits` carries the language."""
    seen = splits.groupBy(*keys, language).agg(
        F.count_if(F.col("role") == "train").alias("train"),
        F.count_if(F.col("role") == "test").alias("test"),
    )
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("train") > 0).alias("n_train_languages"),
        F.count_if(F.col("test") > 0).alias("n_test_languages"),
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("n_shared_languages"),
        F.sum("train").alias("n_train"),
        F.sum("test").alias("n_test"),
    )


def validate_paths(
    docs: DataFrame,
    author: str = "author",
    target: str = "target",
    paths: Sequence[str] = ("text_path", "stanza"),
) -> DataFrame:
    """One row: documents whose author is not the target, or is not in a path."""
    checks = [F.count("*").alias("n_docs")]
    differs = ~F.col(author).eqNullSafe(F.col(target))
    checks.append(F.count_if(differs).alias("n_author_is_not_target"))
    for path in paths:
        inside = F.coalesce(F.col(path).contains(F.col(target)), F.lit(False))
        checks.append(F.count_if(~inside).alias(f"n_not_in_{path}"))
    return docs.agg(*checks)
