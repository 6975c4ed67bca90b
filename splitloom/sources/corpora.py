"""Ingest jobs: one raw corpus layout each, to one document table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.fixed_values import CMCC_CATEGORIES, CMCC_SUBDIRECTORY, SENTENCES_PER_CHUNK
from splitloom.operators.joins import lookup_side, stored
from splitloom.operators.prepare import chunk_documents, externalize_text, with_doc_ids
from splitloom.operators.sentences import train_sentences
from splitloom.sources.files import read_files
from splitloom.sources.problems import read_problem_collection
from splitloom.sources.tables import read_tsv, under_root
from splitloom.sources.trees import coded_tree, labelled_tree, language_tree, train_test_tree


def reuters(spark: SparkSession, raw: str) -> DataFrame:
    return train_test_tree(read_files(spark, raw))


def guardian(spark: SparkSession, raw: str) -> DataFrame:
    return labelled_tree(read_files(spark, raw))


def cmcc(spark: SparkSession, raw: str) -> DataFrame:
    folders = f"{{{','.join(CMCC_CATEGORIES)}}}/{CMCC_SUBDIRECTORY}"
    return coded_tree(read_files(spark, raw, below=folders))


def imdb62(spark: SparkSession, raw: str, multi_line: bool = False) -> DataFrame:
    """Line breaks in quotes need `multi_line`, with which a file is read by one task."""
    table = read_tsv(spark, under_root(raw, "imdb62.txt"), multi_line=multi_line)
    return table.withColumnRenamed("text_raw", "text")


def novels(spark: SparkSession, raw: str, chunk_size: int = SENTENCES_PER_CHUNK) -> DataFrame:
    """Sentence ends are learnt from the novels themselves, which are read once."""
    texts = stored(language_tree(read_files(spark, raw)))
    return chunk_documents(texts, chunk_size, model=train_sentences(texts))


def pan18(spark: SparkSession, raw: str) -> DataFrame:
    return read_problem_collection(spark, raw)


# Each corpus with its ingest function and the columns that order its documents.
CORPORA = {
    "reuters-c50": (reuters, ("path", "category")),
    "guardian": (guardian, ("path",)),
    "cmcc": (cmcc, ("path",)),
    "imdb62": (imdb62, ("review_id", "item_id", "author", "text")),
    "cl_novels": (novels, ("path", "chunk")),
    "pan18_attribution": (pan18, ("path",)),
}

#: The file that names the version of a corpus that readers see.
POINTER = "current"


def ingest(
    spark: SparkSession, corpus: str, raw: str, output: str, force: bool = False, **options: int
) -> None:
    """Read a raw corpus and write its documents, numbered from 0 in their order before incomplete ones are dropped.

    Raw files are opened once. What orders the documents is numbered apart from their texts, of
    which only a digest takes part.
    """
    if current_version(spark, output) is not None and not force:
        raise ValueError(f"a corpus already exists: {output}")
    read, order = CORPORA[corpus]
    docs = read(spark, raw, **options).withColumn("corpus", F.lit(corpus))
    staged = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    keys = [F.sha2("text", 256).alias("text") if c == "text" else F.col(c) for c in order]
    numbers = with_doc_ids(staged.select("_row", *keys), order).select("doc_id", "_row")
    numbered = staged.join(lookup_side(numbers), "_row").drop("_row", "path")
    if corpus != "cl_novels":
        numbered = externalize_text(numbered)
    write_corpus(numbered, output, force)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def current_version(spark: SparkSession, output: str) -> str | None:
    """The folder that a corpus's pointer names; None without a corpus."""
    system, pointer = _files(spark, under_root(output, POINTER))
    if not system.exists(pointer):
        return None
    return under_root(output, spark.read.text(under_root(output, POINTER)).first().value)


def write_corpus(docs: DataFrame, output: str, force: bool = False) -> None:
    """Write a table of documents as a new version; the pointer to it is put in place last.

    If writing fails, readers go on seeing the version before. An existing corpus is an error
    unless forced. Versions that the pointer named before stay for readers that still use them;
    `drop_old_versions` removes them.
    """
    spark = docs.sparkSession
    if current_version(spark, output) is not None and not force:
        raise ValueError(f"a corpus already exists: {output}")
    version = f"documents-{uuid.uuid4().hex}"
    docs.write.parquet(under_root(output, version))
    system, fresh = _files(spark, under_root(output, f"{version}.pointer"))
    stream = system.create(fresh, True)
    stream.write(version.encode())
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, _files(spark, under_root(output, POINTER))[1], options)


def drop_old_versions(spark: SparkSession, output: str) -> int:
    """Remove the versions of a corpus that its pointer doesn't name; gives their number."""
    now = current_version(spark, output)
    system, top = _files(spark, output)
    old = [
        status.getPath() for status in system.listStatus(top)
        if status.isDirectory() and status.getPath().getName().startswith("documents-") and status.getPath().getName() != str(now).rpartition("/")[2]
    ]
    for path in old:
        system.delete(path, True)
    return len(old)


def load_corpus(spark: SparkSession, output: str, with_text: bool = False) -> DataFrame:
    """The metadata of a written corpus, with its texts only on request."""
    version = current_version(spark, output)
    if version is None:
        raise FileNotFoundError(f"no corpus at {output}")
    docs = spark.read.parquet(version)
    return docs if with_text else docs.drop("text")
