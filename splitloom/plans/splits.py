"""The split builders. All return (split_id, role, doc_id, target)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.fixed_values import DEFAULT_FOLDS
from splitloom.operators.cap import cap_docs_per_target
from splitloom.operators.folds import ROWS_PER_BUCKET, attach_folds, stratified_kfold
from splitloom.operators.joins import broadcast_if_small
from splitloom.operators.targets import distinct_targets, restrict_targets, select_targets
from splitloom.session import scratch_path

COLUMNS = ("split_id", "role", "doc_id", "target")


def _narrow(docs: DataFrame, target: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(target).alias("target"))


def _sided(docs: DataFrame, role: str) -> DataFrame:
    return docs.withColumn("role", F.lit(role)).select(*COLUMNS)


def union_sides(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sides in one table, columns matched by name, with their role."""
    return train.withColumn("role", F.lit("train")).unionByName(
        test.withColumn("role", F.lit("test")), allowMissingColumns=True
    )


def train_test_split(
    train: DataFrame,
    test: DataFrame,
    target: str = "author",
    max_targets: int | None = None,
    max_docs_per_target: int | None = None,
    seed: int = 42,
    on_short: str = "error",
    doc_id: str = "doc_id",
    split_id: str = "0",
) -> DataFrame:
    """One split. Targets come from the train side; only that side is capped."""
    train, test = _narrow(train, target, doc_id), _narrow(test, target, doc_id)
    targets = distinct_targets(train, "target")
    if max_targets:
        targets = select_targets(targets, max_targets, seed)
        train = restrict_targets(train, targets, "target")
    test = restrict_targets(test, targets, "target")
    train = train.withColumn("split_id", F.lit(split_id))
    train = cap_docs_per_target(
        train, max_docs_per_target, "target", "doc_id", ["split_id"], seed, on_short
    )
    test = test.withColumn("split_id", F.lit(split_id))
    return _sided(train, "train").unionByName(_sided(test, "test"))


def fan_out_folds(folds: DataFrame, n_splits: int) -> DataFrame:
    """Each document once per split: tested in its own fold, trained on in the others."""
    splits = F.sequence(F.lit(0), F.lit(n_splits - 1))
    rows = folds.withColumn("_split", F.explode(splits))
    role = F.when(F.col("_split") == F.col("fold"), F.lit("test")).otherwise(F.lit("train"))
    return rows.select(F.col("_split").cast("string").alias("split_id"), role.alias("role"), "doc_id", "target")


def cv_split(
    docs: DataFrame,
    target: str = "author",
    n_splits: int = DEFAULT_FOLDS,
    max_targets: int | None = None,
    max_docs_per_target: int | None = None,
    seed: int = 42,
    on_short: str = "error",
    doc_id: str = "doc_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Stratified folds. Targets are chosen before folding; train sides are capped."""
    docs = _narrow(docs, target, doc_id)
    if max_targets:
        chosen = select_targets(distinct_targets(docs, "target"), max_targets, seed)
        docs = restrict_targets(docs, chosen, "target")
    folds = stratified_kfold(docs, "target", n_splits, "doc_id", rows_per_bucket)
    splits = fan_out_folds(folds, n_splits)
    if not max_docs_per_target:
        return splits.select(*COLUMNS)
    train = cap_docs_per_target(
        splits.where(F.col("role") == "train"),
        max_docs_per_target, "target", "doc_id", ["split_id"], seed, on_short,
    )
    test = folds.withColumn("split_id", F.col("fold").cast("string"))
    return _sided(train, "train").unionByName(_sided(test, "test"))


def write_splits(splits: DataFrame, path: str) -> None:
    """Write long splits so that each side is a folder of its own; large sides become several files."""
    splits.hint("rebalance", "split_id", "role").write.partitionBy("split_id", "role").parquet(path)


def read_splits(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Splits that `write_splits` wrote; a condition on split and role reads that folder alone."""
    return spark.read.schema(f"doc_id {id_type}, target string, split_id string, role string").parquet(path).select(*COLUMNS)


def iter_splits(
    splits: DataFrame, docs: DataFrame, doc_id: str = "doc_id", path: str | None = None
) -> Iterator[tuple[str, DataFrame, DataFrame]]:
    """(split_id, train, test) with all columns of `docs`, for a model selection loop.

    The plan of the splits runs once, whatever their number: they are written to the path, or to the
    shared folder, and each turn reads its own.
    """
    spark = splits.sparkSession
    path = path or scratch_path(spark, "splits")
    write_splits(splits.select(*COLUMNS), path)
    written = read_splits(spark, path, splits.schema["doc_id"].dataType.simpleString())
    for row in written.select("split_id").distinct().orderBy("split_id").toLocalIterator():
        sides = []
        for role in ("train", "test"):
            ids = written.where((F.col("split_id") == row[0]) & (F.col("role") == role))
            ids = broadcast_if_small(ids.select(F.col("doc_id").alias("_id")))
            sides.append(docs.join(ids, F.col(doc_id) == F.col("_id"), "left_semi"))
        yield row[0], sides[0], sides[1]


def iter_folds(
    docs: DataFrame, cuts: DataFrame, n_splits: int, target: str = "author", doc_id: str = "doc_id"
) -> Iterator[tuple[str, DataFrame, DataFrame]]:
    """Uncapped folds without a join by document; the tables keep all columns."""
    folded = attach_folds(docs, cuts, target, doc_id)
    for fold in range(n_splits):
        yield str(fold), folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
