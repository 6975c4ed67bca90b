"""Choosing targets and keeping their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitloom.functions.guards import reject
from splitloom.functions.order import seeded_order
from splitloom.functions.paths import fresh_name
from splitloom.operators.joins import lookup_side


def attach_target(docs: DataFrame, target: Column) -> tuple[DataFrame, str]:
    """Add the target under a name that no column has."""
    name = fresh_name(docs.columns)
    return docs.withColumn(name, target), name


def distinct_targets(docs: DataFrame, target: str = "author") -> DataFrame:
    return docs.select(target).distinct()


def select_targets(targets: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n of the distinct targets, in seeded random order. Fewer are an error."""
    column = targets.columns[0]
    order = seeded_order(seed, "target", F.col(column))
    chosen = targets.orderBy(order, column).limit(n)
    # The window sees at most the n chosen rows.
    counted = chosen.withColumn("_n", F.count("*").over(Window.partitionBy()))
    return reject(counted, F.col("_n") < n, f"fewer than {n} targets").drop("_n")


def restrict_targets(docs: DataFrame, targets: DataFrame, target: str = "author") -> DataFrame:
    """Documents whose target is listed. A missing target matches a missing one."""
    side = lookup_side(targets.select(F.col(targets.columns[0]).alias("_listed")))
    return docs.join(side, F.col(target).eqNullSafe(F.col("_listed")), "left_semi")


def docs_per_target(docs: DataFrame, target: str = "author", *keys: str) -> DataFrame:
    return docs.groupBy(*keys, target).agg(F.count("*").alias("n_docs"))


def docs_per_target_bounds(docs: DataFrame, target: str = "author", *keys: str) -> DataFrame:
    """Number of targets, and the fewest and most documents of one."""
    return docs_per_target(docs, target, *keys).groupBy(*keys).agg(
        F.count("*").alias("n_targets"),
        F.min("n_docs").alias("min_docs"),
        F.max("n_docs").alias("max_docs"),
    )
