"""Stratified k-fold as cut points.

Without shuffling, every fold of a class is a block of consecutive documents.
So k document ids per class, where each fold begins, say all about the folds, and
any table, however wide, gets its fold by looking up its class. Only the few
documents around a cut are ever sorted.
"""

from __future__ import annotations

import warnings

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitloom.fixed_values import DEFAULT_FOLDS
from splitloom.functions.guards import reject
from splitloom.operators.joins import broadcast_if_small, stored

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 10_000


def _with_buckets(ids: DataFrame, rows_per_bucket: int) -> tuple[DataFrame, int]:
    """Ranges of ids with about the same number of rows, so that none gets hot.

    The ranges come from a sample; they steer the work and not the result.
    """
    rows = ids.count()
    buckets = min(MAX_BUCKETS, -(-rows // rows_per_bucket))
    if buckets < 2:
        return ids.withColumn("bucket", F.lit(0)), 1
    as_double = ids.withColumn("_id", F.col("doc_id").cast("double"))
    sample = as_double.sample(min(1.0, 500.0 * buckets / rows), seed=1)
    shares = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(sample.approxQuantile("_id", shares, 0.2 / buckets)))
    bucketizer = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol="_id", outputCol="_bucket"
    )
    bucketed = bucketizer.transform(as_double)
    return bucketed.select("doc_id", "target", F.col("_bucket").cast("int").alias("bucket")), buckets


def _sizes_before(classes: DataFrame, buckets: int) -> DataFrame:
    """Add `before`, the size of all classes that begin earlier.

    Summed per bucket of first documents and within each bucket, so that many
    classes do not meet in one task.
    """
    within = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    if buckets == 1:
        return classes.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = classes.groupBy("bucket").agg(F.sum("size").alias("_total"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base")
    )
    # One row per bucket, MAX_BUCKETS at most.
    based = classes.join(F.broadcast(bases), F.col("bucket") == F.col("_b"))
    within = Window.partitionBy("bucket").orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return based.withColumn("before", before).drop("_b", "_base")


def _with_begins(classes: DataFrame, k: int) -> DataFrame:
    """Add `begins`: the rank in its class at which each fold begins."""
    shares = (
        f"transform(sequence(0, {k} - 1), i -> (before + size - 1 - i + {k}) div {k}"
        f" - (before - 1 - i + {k}) div {k})"
    )
    begins = (
        f"transform(sequence(0, {k} - 1),"
        " i -> aggregate(slice(shares, 1, i), 0L, (sum, share) -> sum + share))"
    )
    return classes.withColumn("shares", F.expr(shares)).select("target", "size", F.expr(begins).alias("begins"))


def fold_cuts(
    docs: DataFrame,
    target: str = "author",
    n_splits: int = DEFAULT_FOLDS,
    doc_id: str = "doc_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(target, size, cuts): the document at which each fold of a class begins.

    Folds without a document of the class begin where the next one does, or
    nowhere at the end.
    """
    if n_splits < 2:
        raise ValueError("at least two folds are needed")
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(target).alias("target"))
    ids = reject(ids, F.col("target").isNull(), "a document without target cannot be stratified")
    ids, buckets = _with_buckets(ids, rows_per_bucket)

    cells = ids.groupBy("target", "bucket").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id")
    )
    if buckets > 1:
        # Read twice below, and much smaller than the documents.
        cells = stored(cells)
    classes = cells.groupBy("target").agg(
        F.sum("n").alias("size"), F.min("first_id").alias("first_id"), F.min("bucket").alias("bucket")
    )
    classes = _with_begins(_sizes_before(classes, buckets), n_splits)
    if buckets == 1:
        at_cuts = classes.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("earlier"))
        near = ids
    else:
        up_to_here = Window.partitionBy("target").orderBy("bucket")
        placed = cells.withColumn("until", F.sum("n").over(up_to_here))
        holds_a_cut = F.expr("exists(begins, b -> b >= until - n and b < until)")
        at_cuts = stored(
            placed.join(classes, "target").where(holds_a_cut).select(
                "target", "bucket", "size", "begins", (F.col("until") - F.col("n")).alias("earlier")
            )
        )
        keys = broadcast_if_small(at_cuts.select("target", "bucket"))
        near = ids.join(keys, ["target", "bucket"], "left_semi")
    in_cell = Window.partitionBy("target", "bucket").orderBy("doc_id")
    ranked = near.withColumn("place", F.row_number().over(in_cell).cast("long") - 1)
    found = ranked.join(at_cuts, ["target", "bucket"]).withColumn("rank", F.col("earlier") + F.col("place"))
    times = F.size(F.filter("begins", lambda begin: begin == F.col("rank")))
    result = stored(
        found.withColumn("times", times).where("times > 0").groupBy("target").agg(
            F.max("size").alias("size"),
            F.flatten(F.collect_list(F.array_repeat("doc_id", F.col("times")))).alias("cuts"),
        )
    )
    smallest, largest = result.agg(F.min("size"), F.max("size")).first()
    if largest is None or largest < n_splits:
        raise ValueError(f"no class has as many documents as there are folds ({n_splits})")
    if smallest < n_splits:
        warnings.warn(f"the smallest class has {smallest} documents for {n_splits} folds", stacklevel=2)
    return result


def attach_folds(
    docs: DataFrame, cuts: DataFrame, target: str = "author", doc_id: str = "doc_id"
) -> DataFrame:
    """Add the fold to any table of the same documents; its rows stay where they are."""
    side = broadcast_if_small(cuts.select(F.col("target").alias("_class"), F.col("cuts").alias("_cuts")))
    joined = docs.join(side, F.col(target) == F.col("_class"))
    fold = F.size(F.filter("_cuts", lambda cut: cut <= F.col(doc_id))).cast("long") - 1
    return joined.withColumn("fold", fold).drop("_class", "_cuts")


def stratified_kfold(
    docs: DataFrame,
    target: str = "author",
    n_splits: int = DEFAULT_FOLDS,
    doc_id: str = "doc_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(doc_id, target, fold) for every document."""
    cuts = fold_cuts(docs, target, n_splits, doc_id, rows_per_bucket)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(target).alias("target"))
    return attach_folds(narrow, cuts, "target", "doc_id")
