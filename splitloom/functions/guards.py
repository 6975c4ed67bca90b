"""Errors that a lazy plan raises when it meets a bad row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject(df: DataFrame, bad: Column, message: str | Column) -> DataFrame:
    """Pass all rows through, and fail the job on the first one that is bad."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def failing(df: DataFrame, bad: Column, message: str | Column) -> DataFrame:
    """No row at all, or the failure of the job. For a union with the real result.

    The condition must read a column that the rows get from a join or an
    aggregation, else Spark tests it before that step.
    """
    return reject(df, bad, message).where(bad)
