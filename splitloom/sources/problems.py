"""Collections of attribution problems with candidate and unknown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.fixed_values import LANGUAGE_CODES
from splitloom.functions.guards import failing
from splitloom.functions.paths import part
from splitloom.functions.text import remap
from splitloom.operators.joins import lookup_side
from splitloom.sources.files import decoded, read_files

COLLECTION = "`problem-name` STRING, `language` STRING"
TRUTH = "ground_truth ARRAY<STRUCT<`unknown-text`: STRING, `true-author`: STRING>>"


def truth_entries(truth: DataFrame) -> DataFrame:
    """(problem, ground_truth array) to one row per unknown text."""
    entries = truth.select("problem", F.explode("ground_truth").alias("entry"))
    return entries.select(
        "problem",
        F.col("entry.`unknown-text`").alias("name"),
        F.col("entry.`true-author`").alias("author"),
    )


def problem_documents(collection: DataFrame, truth: DataFrame, files: DataFrame) -> DataFrame:
    """Known texts as train rows, unknown texts with their true author as test rows.

    `collection` has (problem, language), `truth` (problem, ground_truth) and
    `files` the paths <problem>/candidate*/known*.txt and <problem>/unknown/*.
    """
    path = F.col("path")
    texts = decoded(files, "utf-8").select(
        "path", part(path, 1).alias("problem"), part(path, 2).alias("folder"), part(path, 3).alias("name"), "text"
    )
    listed = lookup_side(
        collection.select("problem", remap(F.col("language"), LANGUAGE_CODES).alias("language"))
    )
    known = texts.where(
        F.col("folder").startswith("candidate") & F.col("name").rlike(r"^known.*\.txt$")
    ).withColumnRenamed("folder", "author")
    unknown = texts.where(F.col("folder") == "unknown").drop("folder")
    entries = lookup_side(truth_entries(truth))
    matched = unknown.join(entries, ["problem", "name"])
    # Every entry must have its file, which is checked without reading the texts.
    names = files.select(
        part(path, 1).alias("problem"), part(path, 3).alias("name"), (part(path, 2) == "unknown").alias("_hit")
    )
    checked = entries.join(names.where("_hit"), ["problem", "name"], "left")
    missing = failing(
        checked, F.col("_hit").isNull(), F.concat_ws("/", F.lit("missing file: "), "problem", "name")
    )
    matched = matched.unionByName(missing.drop("_hit"), allowMissingColumns=True)
    # A listed problem without truth would lose its test side.
    given = truth.where("ground_truth IS NOT NULL").select("problem", F.lit(True).alias("_given")).distinct()
    untold = listed.join(given, "problem", "left")
    untold = failing(untold, F.col("_given").isNull(), F.concat(F.lit("no truth for "), "problem"))
    matched = matched.unionByName(untold.select("problem"), allowMissingColumns=True)
    sides = known.withColumn("data_type", F.lit("train")).unionByName(
        matched.withColumn("data_type", F.lit("test"))
    )
    return sides.join(listed, "problem").select(
        "path", "author", "language", "data_type", "problem", "text"
    )


def read_problem_collection(spark: SparkSession, root: str) -> DataFrame:
    root = root.rstrip("/")
    collection = (
        spark.read.schema(COLLECTION)
        .json(f"{root}/collection-info.json", multiLine=True, mode="FAILFAST")
        .select(F.col("problem-name").alias("problem"), "language")
    )
    # File paths in metadata are percent-encoded, those of read files are not.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    truth = (
        spark.read.schema(TRUTH)
        .json(f"{root}/*/ground-truth.json", multiLine=True, mode="FAILFAST")
        .select(part(plain, -2).alias("problem"), "ground_truth")
    )
    known = read_files(spark, root, "known*.txt", below="*/candidate*")
    unknown = read_files(spark, root, "*", below="*/unknown")
    return problem_documents(collection, truth, known.unionByName(unknown))
