"""Rules that put documents on the train or the test side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.operators.joins import lookup_side


def leave_one_out(docs: DataFrame, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Test on one value, train on all others. A missing value is another value."""
    held = F.col(column).eqNullSafe(value)
    return docs.where(~held), docs.where(held)


def predefined(
    docs: DataFrame, column: str, train: str = "train", test: str = "test"
) -> tuple[DataFrame, DataFrame]:
    """Sides named in a column; other values are on neither."""
    return docs.where(F.col(column) == train), docs.where(F.col(column) == test)


def by_value_sets(
    docs: DataFrame, column: str, train: Sequence[str], test: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Sides as two disjoint sets of values; other values are on neither."""
    shared = sorted(set(train) & set(test))
    if shared:
        raise ValueError(f"values on both sides: {', '.join(shared)}")
    return docs.where(member(F.col(column), train)), docs.where(member(F.col(column), test))


def member(column: Column, values: Sequence[str]) -> Column:
    return column.isin(*values)


def require_values(docs: DataFrame, column: str, values: Sequence[str], side: str) -> None:
    """Fail unless every value occurs in the column."""
    found = docs.where(member(F.col(column), values)).select(column).distinct().collect()
    missing = sorted(set(values) - {row[0] for row in found})
    if missing:
        raise ValueError(f"invalid {side} values of {column}: {', '.join(missing)}")


def exclude_rows(docs: DataFrame, column: str, excluded: DataFrame | Sequence[str]) -> DataFrame:
    """Drop known bad rows. Rows without the attribute stay."""
    if not isinstance(excluded, DataFrame):
        # A missing path never equals an excluded one.
        return docs.where(~F.col(column).isin(*excluded) | F.col(column).isNull())
    side = lookup_side(excluded.select(F.col(column).alias("_excluded")).distinct())
    return docs.join(side, F.col(column) == F.col("_excluded"), "left_anti")
