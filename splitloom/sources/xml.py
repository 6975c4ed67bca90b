"""Per-author XML files that hold many documents each."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from xml.etree.ElementTree import Element, ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.functions.guards import reject
from splitloom.functions.paths import base_name, part, stem
from splitloom.operators.joins import attach_lookup, stored
from splitloom.sources.files import read_files
from splitloom.sources.tables import parse_truth, read_truth_lines
from splitloom.sources.trees import find_directory


#: Bytes that the parser is fed at once, and documents that are handed on at once.
FEED_BYTES, BATCH_ROWS = 65_536, 1_000


def path_steps(search_path: str) -> list[tuple[bool, str]]:
    """The steps of an element path: whether each may lie at any depth, and its name or `*`.

    `a/b`, `*`, `.//b` and names with a namespace in braces are understood; there may be one `//`.
    """
    # A path that ends with a slash means all children there.
    search_path += "*" if search_path.endswith("/") else ""
    parts = re.findall(r"//|/|(?:\{[^}]*\})?[^/{}]+", search_path)
    if "".join(parts) != search_path or not search_path:
        raise ValueError(f"not an element path: {search_path!r}")
    steps, anywhere = [], False
    for number, one in enumerate(parts):
        if one == "/" and number:
            continue
        if one == "//" and number:
            anywhere = True
        elif one == "." and number == 0:
            continue
        elif re.fullmatch(r"(\{[^}]*\})?(\*|[\w:-][\w:.-]*)", one):
            steps.append((anywhere, one))
            anywhere = False
        else:
            raise ValueError(f"not an element path: {search_path!r}")
    if anywhere or not steps or sum(deep for deep, _ in steps) > 1:
        raise ValueError(f"not an element path: {search_path!r}")
    return steps


def element_texts(content: bytes, steps: list[tuple[bool, str]]) -> Iterator[tuple[int, str | None]]:
    """Place in the document and text before the first child (None: none) of each element on the path.

    Elements are read as events and forgotten at their end, so that a file's tree is never whole in memory.
    """
    parser = XMLPullParser(("start", "end"))
    # Per open element: the element, the steps that its children may match, its place if it is on the path.
    opened: list[tuple[Element, list[int], int | None]] = []
    count = 0
    for at in range(0, max(1, len(content)), FEED_BYTES):
        parser.feed(content[at : at + FEED_BYTES])
        if at + FEED_BYTES >= len(content):
            parser.close()
        for event, element in parser.read_events():
            if event == "start":
                waiting, place = [0], None
                if opened:
                    waiting = []
                    for step in opened[-1][1]:
                        deep, name = steps[step]
                        if deep:
                            waiting.append(step)
                        if name in ("*", element.tag):
                            if step + 1 == len(steps):
                                place = count
                            else:
                                waiting.append(step + 1)
                count += place is not None
                opened.append((element, waiting, place))
            else:
                _, _, place = opened.pop()
                if place is not None:
                    yield place, element.text
                if opened:
                    opened[-1][0].remove(element)


def xml_documents(files: DataFrame, search_path: str) -> DataFrame:
    """<language>/<author>.xml with one document per element at `search_path`, below the root.

    The text is what stands before an element's first child, NULL if there is nothing. Files of
    one author may come in several rows. A file that is not XML fails the job.
    """
    steps = path_steps(search_path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows: list[tuple[int, str | None]] = []

                def made() -> pa.RecordBatch:
                    columns = [pa.array([path.as_py()] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())]
                    return pa.RecordBatch.from_arrays(columns, ["path", "position", "text"])

                try:
                    for row in element_texts(content.as_py() or b"", steps):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield made()
                            rows.clear()
                except (ParseError, ValueError, LookupError) as error:
                    raise ValueError(f"{path.as_py()}: {error}") from error
                if rows:
                    yield made()

    found = files.where(F.col("path").endswith(".xml")).select("path", "content").mapInArrow(
        parse, "path string, position int, text string"
    )
    path = F.col("path")
    return found.select(
        "path", part(path, -2).alias("language"), stem(base_name(path)).alias("author"), "position", "text"
    )


def language_availability(train: DataFrame, test: DataFrame, language: str) -> DataFrame:
    """Every language, and whether it occurs on either side."""
    sides = train.select(language, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(language, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return sides.groupBy(language).agg(
        (F.max("a") == 1).alias("in_train"), (F.max("b") == 1).alias("in_test")
    )


def resolve_languages(
    train: DataFrame,
    test: DataFrame,
    languages: Sequence[str] | None = None,
    language: str = "language",
) -> list[str]:
    """The asked languages, or those of the train side; each must be on both sides."""
    present = language_availability(train, test, language)
    if languages is None:
        wanted = present.where("in_train")
    else:
        wanted = present.where(F.col(language).isin(*languages))
    rows = {row[language]: row for row in wanted.collect()}
    for name in sorted(rows) if languages is None else languages:
        for side in ("train", "test"):
            if name not in rows or not rows[name][f"in_{side}"]:
                raise ValueError(f"language {name!r} is missing on the {side} side")
    if not rows:
        raise ValueError("no languages found")
    return sorted(rows) if languages is None else list(languages)


def read_xml_corpus(
    spark: SparkSession,
    root: str,
    truth_columns: Sequence[str],
    search_path: str,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Both sides of an XML corpus with the truth of each author attached."""
    files = read_files(spark, root, "*.xml")
    names = {side: find_directory(files, side) for side in ("train", "test")}
    top, folder = part(F.col("path"), 1), part(F.col("path"), 2)
    located = files.select(top.alias("top"), folder.alias("language"))
    languages = resolve_languages(
        *[located.where(F.col("top") == names[side]) for side in ("train", "test")], languages
    )
    # One pass over the files of all sides and languages, and one table of all their truth files.
    wanted = files.where(top.isin(*names.values()) & folder.isin(*languages))
    side = F.when(part(F.col("path"), 1) == names["train"], F.lit("train")).otherwise(F.lit("test"))
    documents = xml_documents(wanted, search_path).withColumn("data_type", side)
    truth = reduce(
        DataFrame.unionByName,
        [
            parse_truth(read_truth_lines(spark, f"{root.rstrip('/')}/{name}", language), truth_columns)
            .select("*", F.lit(side).alias("data_type"), F.lit(language).alias("language"), F.lit(True).alias("_told"))
            for side, name in names.items()
            for language in languages
        ],
    )
    truth = stored(truth)
    told = [F.lit(f"{row.data_type}/{row.language}") for row in truth.select("data_type", "language").distinct().collect()]
    joined = attach_lookup(
        documents, truth, {"data_type": "data_type", "language": "language", "author": truth_columns[0]}, on_missing="keep"
    )
    if not told:
        return joined
    # An author without entry is an error, but an empty truth file tells nothing of its side and language.
    place = F.concat_ws("/", "data_type", "language")
    missing = F.concat(F.lit("no entry for "), place, F.lit("/"), "author")
    return reject(joined, F.col("_told").isNull() & place.isin(*told), missing).drop("_told")
