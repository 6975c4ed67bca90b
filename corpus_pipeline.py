"""Documents to packed training sequences, in five stages with a table between each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.catalog.tables import read
from splitloom.llm import mixing, packing, secrets, simhash, toxicity
from splitloom.llm.common import kept
from splitloom.llm.queries import labelled_languages, vocabulary

#: Target weights of the languages. The total is the smallest that needs no document
#: dropped, so scarce languages repeat and the others stay as they are.
WEIGHTS = {"de": 0.17, "en": 0.5, "es": 0.16, "fr": 0.17}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7 go; NULL and empty texts stay."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(F.col("text"), model) < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id."""
    return simhash.one_per_class(docs, words_each=4, max_bits=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become a mask."""
    return secrets.redact(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, in as many copies as its rate, at least one, asks for."""
    labelled = labelled_languages(docs, read(spark, sf_dir, "labels"))
    return mixing.repeated(docs, labelled, WEIGHTS, least=1.0, cover=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: Fitted models and tokenizers have no SQL; tests check what each stage keeps, and its operator by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each reads what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = kept(docs, f"pipeline-{number}")
    return docs
