"""Corpora whose directory names are attributes of the documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.fixed_values import (
    CMCC_CATEGORIES,
    CMCC_FILE_NAME,
    CMCC_RENAMED_FILES,
    CMCC_SUBDIRECTORY,
)
from splitloom.functions.guards import reject
from splitloom.functions.paths import base_name, depth, part, stem
from splitloom.functions.text import remap
from splitloom.sources.files import decoded


def _is_text(path: Column, levels: int) -> Column:
    return (depth(path) == levels) & path.endswith(".txt")


def labelled_tree(files: DataFrame, encoding: str = "cp1252") -> DataFrame:
    """<category>/<author>/*.txt"""
    path = F.col("path")
    texts = decoded(files.where(_is_text(path, 3)), encoding)
    return texts.select("path", part(path, 1).alias("category"), part(path, 2).alias("author"), "text")


def find_directory(files: DataFrame, word: str) -> str:
    """The alphabetically first top directory whose name contains a word."""
    path = F.col("path")
    top = F.when(depth(path) > 1, part(path, 1))
    name = files.agg(F.min(F.when(top.contains(word), top))).first()[0]
    if name is None:
        raise ValueError(f"no directory has {word!r} in its name")
    return name


def train_test_tree(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """<*train*>/<author>/*.txt and <*test*>/<author>/*.txt, read in one scan."""
    path = F.col("path")
    top = part(path, 1)
    sides = [
        F.when(top == find_directory(files, side), F.lit(side)) for side in ("train", "test")
    ]
    texts = files.where(_is_text(path, 3)).withColumn(
        "category", F.explode(F.array_compact(F.array(*sides)))
    )
    return decoded(texts, encoding).select("path", "category", part(path, 2).alias("author"), "text")


def language_tree(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """<author>/<language>/<title>.txt"""
    path = F.col("path")
    texts = decoded(files.where(_is_text(path, 3)), encoding)
    return texts.select(
        "path",
        part(path, 1).alias("author"),
        part(path, 2).alias("language"),
        stem(part(path, 3)).alias("title"),
        "text",
    )


def filename_attributes(
    files: DataFrame,
    pattern: str = CMCC_FILE_NAME,
    names: tuple[str, ...] = ("author", "genre", "topic"),
    renamed: Mapping[str, str] = CMCC_RENAMED_FILES,
) -> DataFrame:
    """Attributes coded in the file name. A name that does not fit is an error."""
    name = remap(base_name(F.col("path")), renamed)
    files = reject(
        files, ~name.rlike(pattern), F.concat(F.lit("uncoded file name: "), F.col("path"))
    )
    return files.select(
        "*", *[F.regexp_extract(name, pattern, i + 1).alias(c) for i, c in enumerate(names)]
    )


def coded_tree(files: DataFrame, encoding: str = "cp1252") -> DataFrame:
    """<category>/Correlated/<coded name>.txt for the known categories."""
    path = F.col("path")
    wanted = (
        _is_text(path, 3)
        & part(path, 1).isin(*CMCC_CATEGORIES)
        & (part(path, 2) == CMCC_SUBDIRECTORY)
    )
    texts = filename_attributes(decoded(files.where(wanted), encoding))
    return texts.select("path", part(path, 1).alias("category"), "author", "genre", "topic", "text")
