"""The driver tables seen as corpora.

`documents` has no title, genre or side, so these follow from `n_chars` and
`doc_id`. Every row gets every attribute; nothing is filtered here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.fixed_values import (
    CMCC_GENRES,
    CMCC_TOPICS,
    GUARDIAN_GENRES,
    GUARDIAN_TOPICS,
    REDDIT_CORPORA,
)

CORPORA = ("reuters-c50", "cmcc", "guardian", "imdb62", "cl_novels", "pan18_attribution", *REDDIT_CORPORA)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: tuple[str, ...], number: Column) -> Column:
    """The value at a position, NULL past the end."""
    return F.get(F.array(*[F.lit(value) for value in values]), number.cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, number = F.col("n_chars"), F.expr("doc_id div 20 % 25")
    quarter = F.expr("n_chars div 4")
    author = F.col("source")
    novelist = F.concat_ws("/", author, F.expr("doc_id div 20 % 25 div 2").cast("string"))
    title = F.concat_ws("-", author, number.cast("string"))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        author.alias("author"),
        F.col("lang").alias("language"),
        F.when(chars % 4 == 0, F.lit("test")).otherwise(F.lit("train")).alias("data_type"),
        F.format_string("problem%05d", quarter % 10 + 1).alias("problem"),
        pick(GUARDIAN_TOPICS + GUARDIAN_GENRES, quarter % 5).alias("category"),
        # The seventh topic is none.
        pick(CMCC_TOPICS, quarter % 7).alias("topic"),
        pick(CMCC_GENRES, F.expr("n_chars div 28 % 6")).alias("genre"),
        title.alias("title"),
        novelist.alias("novelist"),
        F.concat(F.lit("text_raw/"), F.col("doc_id").cast("string"), F.lit("_"), author, F.lit(".txt")).alias("text_path"),
        "n_chars",
        "text",
    )


def all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all corpora, each document in one of them, no text.

    Four authors write them all, so that small corpora can still be folded.
    """
    docs = documents(spark, sf_dir).drop("text")
    docs = docs.withColumn("author", F.concat(F.lit("author"), (F.col("doc_id") % 4).cast("string")))
    corpus = pick(CORPORA, F.col("doc_id") % len(CORPORA))
    docs = docs.withColumn("corpus", corpus)
    other = F.lit(None).cast("string")
    for name, code in REDDIT_CORPORA.items():
        other = F.when(F.col("corpus") == name, F.lit(code)).otherwise(other)
    category = F.when(F.col("corpus") == "reuters-c50", F.col("data_type")).otherwise(F.col("category"))
    # A Reddit corpus knows English and one other language.
    language = F.when(
        other.isNotNull() & (F.col("language") != "en"), other
    ).otherwise(F.col("language"))
    return docs.withColumn("category", category).withColumn("language", language)
