"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable
from itertools import islice
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.session import scratch_path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and text alone, so that further columns of any name cannot clash; NULL text is empty."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))


def id_bucket(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a NULL id counts as empty text."""
    text = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    return F.crc32(text) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once per row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text between ASCII white space, as an array without empty ones."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda word: word != "")


def per_worker(name: str, make: Callable[[], object]) -> object:
    """What a worker process makes once and keeps over its tasks, also where functions travel with them."""
    store = _made_once()
    if name not in store:
        clear_worker()
        store[name] = make()
        give_back()
    return store[name]


def clear_worker() -> None:
    """Drop what earlier steps have made in this worker process, and give back the memory that is free.

    A worker lives on over the stages of a job, so a step would hold another's tables beside its own.
    """
    store = _made_once()
    if store:
        store.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return free memory to the system, which an idle worker would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def _made_once() -> dict[str, object]:
    module = sys.modules.setdefault("splitloom_made_once", ModuleType("splitloom_made_once"))
    return module.__dict__.setdefault("store", {})


def make_room(remembered: dict, size: int) -> None:
    """Once it is full, a worker forgets the oldest of what it remembers, down to half the size."""
    if len(remembered) >= size:
        for old in list(islice(remembered, len(remembered) - size // 2)):
            del remembered[old]
