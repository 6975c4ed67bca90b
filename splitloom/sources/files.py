"""Raw files as rows of (path, content), the path relative to the corpus root.

Every tree operator takes such a frame. It comes from a directory through
`read_files`, or from a table that already holds packed files.

Spark's own file scan skips empty files, and names that begin with `_`, which corpora may
use as any other. Such files are found by listing the tree in tasks and are read beside the scan. Names
that begin with a dot are hidden: file patterns never match them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch, translate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.functions.guards import reject
from splitloom.functions.paths import relative_to
from splitloom.functions.text import cp1252_is_undefined, decode_cp1252
from splitloom.operators.joins import stored

#: Bytes of files that a task hands on at once.
BATCH_BYTES = 16_000_000


def qualified(spark: SparkSession, root: str) -> str:
    """The root with the scheme that Spark gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", found).rstrip("/")


def _opened(root: str):
    """The file system of a qualified root, and the root's path in it."""
    from pyarrow import fs

    if root.startswith("file:///"):
        return fs.LocalFileSystem(), root.removeprefix("file://")
    return fs.FileSystem.from_uri(root)


def unreadable_files(spark: SparkSession, root: str, name_glob: str) -> list[str]:
    """Matching files that a scan skips, listed by the driver where tasks cannot list the file system."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    base = system.getFileStatus(top).getPath().toUri().getPath().rstrip("/")
    found, files = [], system.listFiles(top, True)
    while files.hasNext():
        file = files.next()
        path = file.getPath().toUri().getPath()[len(base) + 1 :]
        if _is_skipped(path.split("/"), file.getLen(), name_glob):
            found.append(path)
    return sorted(found)


def _is_skipped(parts: list[str], size: int, name_glob: str) -> bool:
    """A file that file patterns match and a scan does not, for its name or as it is empty."""
    skipped = size == 0 or any(part.startswith("_") for part in parts)
    hidden = any(part.startswith(".") for part in parts)
    return skipped and not hidden and fnmatch(parts[-1], name_glob) and parts[-1] != "_SUCCESS"


def skipped_by_scan(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame | None:
    """(path, size) of the matching files that a scan of the root skips; None without any.

    The driver lists the root alone, tasks list what is below each of its directories.
    """
    where = qualified(spark, root)
    system, top = _opened(where)
    from pyarrow import fs

    if system.get_file_info(top).type != fs.FileType.Directory:
        return None
    found = system.get_file_info(fs.FileSelector(top))
    start = [(info.path, info.type == fs.FileType.Directory, int(info.size or 0)) for info in found]
    if not start:
        return None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _opened(where)
        for batch in batches:
            for path, is_directory, size in zip(*(batch.column(c).to_pylist() for c in ("path", "is_directory", "size"))):
                infos = own.get_file_info(fs.FileSelector(path, recursive=True)) if is_directory else []
                files = [(info.path, int(info.size or 0)) for info in infos if info.type == fs.FileType.File]
                if not is_directory:
                    files = [(path, size)]
                rows = []
                for name, bytes_ in files:
                    parts = name[len(top) :].strip("/").split("/")
                    if _is_skipped(parts, bytes_, name_glob):
                        rows.append(("/".join(parts), bytes_))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])

    tree = spark.createDataFrame(start, "path string, is_directory boolean, size long")
    files = stored(tree.repartition(max(1, len(start)), "path").mapInArrow(listed, "path string, size long"))
    return None if files.isEmpty() else files


def read_listed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content) of the files of a listing with (path, size), the path relative to the root."""
    where = qualified(spark, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(where)
        for batch in batches:
            names, contents, held = [], [], 0
            for name in batch.column("path").to_pylist():
                with system.open_input_stream(f"{top}/{name}", compression=None) as file:
                    contents.append(file.read())
                names.append(name)
                held += len(contents[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["path", "content"])
                    names, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return files.select("path").mapInArrow(read, "path string, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below a root, which must be empty or new; gives their number.

    A task that runs again writes its files anew. Two rows of one path are an error.
    """
    where = qualified(files.sparkSession, root)
    system, top = _opened(where)
    from pyarrow import fs

    if system.get_file_info(top).type != fs.FileType.NotFound and system.get_file_info(fs.FileSelector(top)):
        raise ValueError(f"not empty: {root}")
    twice = files.groupBy("path").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"several rows of one path: {twice.path}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _opened(where)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    own.create_dir(folder, recursive=True)
                    made.add(folder)
                with own.open_output_stream(f"{top}/{path}", compression=None) as file:
                    file.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    written = files.select("path", "content").mapInArrow(write, "n long")
    return int(written.agg(F.sum("n")).first()[0] or 0)


def _below(pattern: str) -> str:
    """A regular expression for directories that a pattern with * and {a,b} names."""
    expression = []
    for step in pattern.strip("/").split("/"):
        choices = re.fullmatch(r"\{(.*)\}", step)
        options = choices[1].split(",") if choices else [step]
        # A star stays within its step.
        expression.append("(?:" + "|".join(re.sub(r"\\Z$|\\z$", "", translate(o)).replace(".*", "[^/]*") for o in options) + ")")
    return "^" + "/".join(expression) + "/.*"


def read_files(
    spark: SparkSession, root: str, name_glob: str = "*.txt", below: str = ""
) -> DataFrame:
    """All files under `root` (or the directories `below` it) whose name matches.

    Empty files and names with a leading `_` are read, names with a leading dot are not. On a file
    system that only Spark can list the former are an error.
    """
    location = f"{root.rstrip('/')}/{below}" if below else root
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_glob)
        .load(location)
    )
    files = found.select(relative_to(root, F.col("path")).alias("path"), "content")
    # Directories that `below` names are scanned whatever their names begin with.
    files = files.where(~F.col("path").rlike("(^|/)[_.]")) if below else files
    try:
        _opened(qualified(spark, root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError):
        unread = unreadable_files(spark, root, name_glob)
        if unread:
            raise ValueError(f"empty files and names that begin with _ can't be read here: {', '.join(unread[:20])}") from None
        return files
    skipped = skipped_by_scan(spark, root, name_glob)
    if skipped is not None and below:
        skipped = skipped.where(F.col("path").rlike(_below(below)))
    return files if skipped is None else files.unionByName(read_listed(spark, root, skipped))


def decoded(files: DataFrame, encoding: str) -> DataFrame:
    """Replace `content` by `text`. A byte that windows-1252 lacks is an error."""
    content = F.col("content")
    if encoding == "cp1252":
        files = reject(
            files,
            cp1252_is_undefined(content),
            F.concat(F.lit("not windows-1252: "), F.col("path")),
        )
        return files.withColumn("text", decode_cp1252(content)).drop("content")
    if encoding == "utf-8":
        files = reject(
            files,
            ~F.is_valid_utf8(content.cast("string")),
            F.concat(F.lit("not UTF-8: "), F.col("path")),
        )
        # Text files may end their lines in any of the three ways.
        text = F.regexp_replace(content.cast("string"), "\\r\\n?", "\n")
        return files.withColumn("text", text).drop("content")
    raise ValueError(f"encoding must be 'cp1252' or 'utf-8', not {encoding!r}")
