"""Names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def part(path: Column, position: int) -> Column:
    """A path part: counted from 1, or from the end if negative. NULL if there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(position))


def under(root: str, path: Column) -> Column:
    """Join a path to a root. An absolute path stays as it is."""
    prefix = root if root.endswith("/") else f"{root}/"
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(prefix), path))


def relative_to(root: str, path: Column) -> Column:
    """The part of a path after its root directory."""
    bare = root.split(":", 1)[-1].rstrip("/")
    while "//" in bare:
        bare = bare.replace("//", "/")
    return F.split(path, rf"\Q{bare}\E/", 2).getItem(1)


def text_file_name(row: Column, author: Column) -> Column:
    return F.concat(row.cast("string"), F.lit("_"), author, F.lit(".txt"))


def chunk_file_name(author: Column, language: Column, title: Column, chunk: Column) -> Column:
    joined = F.concat_ws("_", author, language, title, chunk.cast("string"))
    return F.concat(joined, F.lit(".txt"))


def fresh_name(columns: list[str], prefix: str = "y") -> str:
    """The first of y_0, y_1, ... that is not taken."""
    taken = {name.lower() for name in columns}
    number = 0
    while f"{prefix}_{number}" in taken:
        number += 1
    return f"{prefix}_{number}"
