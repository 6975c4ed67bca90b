"""From raw documents to the metadata and content tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitloom.fixed_values import DEFAULT_LANGUAGE, MISSING_MARKERS, SENTENCES_PER_CHUNK
from splitloom.functions.paths import chunk_file_name, text_file_name
from splitloom.functions.text import chunked, sentences
from splitloom.operators.joins import stored
from splitloom.operators.sentences import SentenceModel, split_sentences


#: Digits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def with_doc_ids(docs: DataFrame, order: Sequence[str] = ("path",), doc_id: str = "doc_id") -> DataFrame:
    """Number rows from 0 by their order, without gaps. NULLs come first; equal rows follow each other.

    Rows are spread by ranges of the order, numbered within each range, and moved up by the rows of
    the ranges before, of which there are as many as partitions. All columns are written once
    on the way, so give it narrow rows.
    """
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.broadcast(sizes.select("_part", before.alias("_before")))
    numbered = placed.withColumn("_part", part).join(moved, "_part")
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return numbered.select(number.alias(doc_id), *[f"`{c}`" for c in docs.columns])


def drop_incomplete(docs: DataFrame, markers: Sequence[str] = MISSING_MARKERS) -> DataFrame:
    """Keep rows where no column is NULL and no text stands for a missing value."""
    complete = F.lit(True)
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        complete = complete & column.isNotNull()
        if isinstance(field.dataType, T.StringType):
            complete = complete & ~column.isin(*markers)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            complete = complete & ~F.isnan(column)
    return docs.where(complete)


def with_default(docs: DataFrame, column: str, value: str) -> DataFrame:
    """Add a constant column, unless it is there already."""
    return docs if column in docs.columns else docs.withColumn(column, F.lit(value))


def chunk_documents(
    docs: DataFrame,
    size: int = SENTENCES_PER_CHUNK,
    author: str = "author",
    language: str = "language",
    title: str = "title",
    text: str = "text",
    model: SentenceModel | None = None,
) -> DataFrame:
    """Cut each text into chunks of whole sentences, numbered from 0.

    Sentences end as the model of `train_sentences` has it; without one at every . ! or ? before a blank.
    """
    if size < 1:
        raise ValueError("a chunk needs at least one sentence")
    others = [c for c in docs.columns if c != text]
    found = sentences(F.col(text)) if model is None else split_sentences(F.col(text), F.col(language), model)
    split = docs.select(*others, found.alias("_sentences"))
    cut = split.select(*others, F.posexplode(chunked(F.col("_sentences"), size)).alias("chunk", text))
    name = chunk_file_name(F.col(author), F.col(language), F.col(title), F.col("chunk"))
    return cut.withColumn("text_path", F.concat(F.lit("text_raw/"), name))


def externalize_text(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", author: str = "author"
) -> DataFrame:
    """Complete documents with the path that names their text, and the text itself last.

    One table takes the place of the many small files. Its columns are stored apart, so that
    readers that need no text never read it, and a text needs no join with its metadata.
    """
    complete = with_default(drop_incomplete(docs), "language", DEFAULT_LANGUAGE)
    path = F.concat(F.lit("text_raw/"), text_file_name(F.col(doc_id), F.col(author)))
    others = [c for c in complete.columns if c not in (text, "text_path")]
    return complete.select(*others, path.alias("text_path"), F.col(text).alias("text"))
