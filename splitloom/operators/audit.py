"""Does the text look like the language it claims?

Languages are told apart by letter trigrams. Their counts per language are a table that grows
with the languages' words, not with the texts; a text's score is the sum of the logarithms
of its trigrams' smoothed shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from splitloom.operators import joins
from splitloom.operators.joins import broadcast_if_small, stored
from splitloom.operators.sentences import counted_in_tasks, tokens_in

#: One for each letter, with its neighbours: a match takes no characters, so that the next begins one further on.
GRAM = r"(?=([\p{L} ]\p{L}[\p{L} ]))"

#: Characters whose trigrams are looked up together, and cells of a table that gives their places at once.
WINDOW, CELLS = 1 << 19, 1 << 22


def trigrams(text: Column) -> Column:
    """All letter trigrams of a text in lower case; each run of letters has a blank on both sides."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.regexp_extract_all(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(GRAM), F.lit(1))


@dataclass(frozen=True)
class LanguageProfiles:
    """`grams`: (gram, log0, log1, ...), a logarithm for each of the languages, which are in order.

    Is the table `small` enough for each task to hold it?
    """

    languages: tuple[str, ...]
    grams: DataFrame
    small: bool = False


def train_profiles(docs: DataFrame, language: str = "language", text: str = "text") -> LanguageProfiles:
    """Profiles of the languages that documents claim; those without language teach nothing.

    Runs of letters are counted before they are taken apart, so that frequent words cost as
    much as rare ones.
    """
    known = docs.where(F.col(language).isNotNull())
    tokens = counted_in_tasks(known, language, text, "token", tokens_in)
    runs = F.regexp_extract_all(F.lower("token"), F.lit(r"\p{L}+"), F.lit(0))
    words = tokens.select("language", "n", F.explode(runs).alias("run")).groupBy("language", "run").agg(F.sum("n").alias("count"))
    grams = words.select("language", "count", F.explode(trigrams(F.col("run"))).alias("gram"))
    counts = stored(grams.groupBy("gram", "language").agg(F.sum("count").alias("n")))
    sums = {row.language: row.total for row in counts.groupBy("language").agg(F.sum("n").alias("total")).collect()}
    languages = tuple(sorted(sums))
    size = counts.select("gram").distinct().count()
    logs = [
        F.ln((F.coalesce(F.sum(F.when(F.col("language") == name, F.col("n"))), F.lit(0)) + 1.0) / float(sums[name] + size))
        for name in languages
    ]
    table = counts.groupBy("gram").agg(F.count("*").alias("n_languages"), *[log.alias(f"log{n}") for n, log in enumerate(logs)])
    table = stored(table)
    return LanguageProfiles(languages, broadcast_if_small(table), joins.measured_bytes(table) <= joins.BROADCAST_BYTES)


def packed(grams: list[str]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """A number for each character, how many there are, the trigrams as sorted keys, and the order that sorts them."""
    letters = sorted(set("".join(grams)) - {" "})
    # No letter is 0, a letter of no profile is 1.
    number = np.fromiter((chr(code).isalpha() for code in range(0x110000)), np.int32, 0x110000)
    number[[ord(letter) for letter in letters]] = np.arange(2, len(letters) + 2)
    size = len(letters) + 2
    keys = keys_of(*number[np.array([[ord(letter) for letter in gram] for gram in grams])].T, size)
    order = np.argsort(keys)
    return number, size, keys[order], order


def keys_of(first: np.ndarray, middle: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    return (first.astype(np.int64) * size + middle) * size + last


class Scorer:
    """Sums of the logarithms of texts' trigrams, many texts at a time."""

    def __init__(self, number: np.ndarray, size: int, keys: np.ndarray, logs: np.ndarray):
        self.number, self.size, self.sorted, self.logs = number, size, keys, logs
        self.table = None
        if size**3 <= CELLS:
            self.table = np.full(size**3, len(keys), np.int32)
            self.table[keys] = np.arange(len(keys))

    def places(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[keys]
        found = np.searchsorted(self.sorted, keys)
        found[self.sorted[np.minimum(found, len(self.sorted) - 1)] != keys] = len(self.sorted)
        return found

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text: its known trigrams, and a sum for each language. Texts are in lower case."""
        codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), "<u4")
        ends = np.cumsum([1, *(len(text) + 1 for text in texts)])
        count = np.zeros(len(texts), np.int64)
        scores = np.zeros((len(texts), self.logs.shape[1]))
        for start in range(1, len(codes) - 1, WINDOW):
            numbers = self.number[codes[start - 1 : start + WINDOW + 1]]
            before, own, behind = numbers[:-2], numbers[1:-1], numbers[2:]
            at = np.flatnonzero((own > 1) & (before != 1) & (behind != 1))
            places = self.places(keys_of(before[at], own[at], behind[at], self.size))
            known = places < len(self.sorted)
            text = np.searchsorted(ends, at[known] + start, "right") - 1
            # Texts of one window are few, and in order.
            low, high = (text[0], text[-1] + 1) if len(text) else (0, 0)
            if high:
                count[low:high] += np.bincount(text - low)
                for k in range(scores.shape[1]):
                    scores[low:high, k] += np.bincount(text - low, self.logs[places[known], k])
        return count, scores


def scores_in_tasks(docs: DataFrame, profiles: LanguageProfiles, text: str, doc_id: str) -> DataFrame:
    """(doc_id, s0, s1, ...) of each row with a known trigram."""
    table = profiles.grams.toArrow()
    names = [f"s{n}" for n in range(len(profiles.languages))]
    logs = np.stack([table.column(f"log{n}").to_numpy() for n in range(len(names))], 1)
    number, size, keys, order = packed(table.column("gram").to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast((number, size, keys, logs[order]))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text")).where("text IS NOT NULL")
    id_type = texts.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            # Some documents at a time, so that their characters take little memory.
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                count, scores = scorer.sums(part.column("text").to_pylist())
                rows = np.flatnonzero(count)
                ids = part.column("doc_id").take(pa.array(rows)).cast(arrow_id)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(column) for column in scores[rows].T)], ["doc_id", *names])

    schema = ", ".join([f"doc_id {id_type.simpleString()}", *(f"{name} double" for name in names)])
    return texts.mapInArrow(run, schema)


def detect_language(docs: DataFrame, profiles: LanguageProfiles, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, detected): the likeliest language of each document, NULL without a trigram of any profile.

    A document's trigrams are counted and scored in the task that reads it, as long as the profiles
    are small enough to broadcast; else its trigrams are joined. One row per document and task is shuffled. The alphabetically
    first of equally likely languages counts. Rows of one id count as one document.
    """
    key = F.col(doc_id).alias("doc_id")
    if profiles.small and profiles.languages:
        found = scores_in_tasks(docs, profiles, text, doc_id)
    else:
        grams = docs.select(key, F.explode(trigrams(F.col(text))).alias("gram"))
        logs = [F.col(f"log{n}").alias(f"s{n}") for n in range(len(profiles.languages))]
        found = grams.join(profiles.grams, "gram").select("doc_id", *logs)
    scores = [F.sum(f"s{n}").alias(f"s{n}") for n in range(len(profiles.languages))]
    sums = found.groupBy("doc_id").agg(F.count("*").alias("n"), *scores)
    likeliest = F.lit(None).cast("string")
    if profiles.languages:
        scores = [F.struct(F.col(f"s{n}").alias("score"), F.lit(-n), F.lit(name).alias("name")) for n, name in enumerate(profiles.languages)]
        likeliest = F.array_max(F.array(*scores)).getField("name")
    scored = sums.select(F.col("doc_id").alias("_id"), likeliest.alias("detected"))
    every = docs.select(key).distinct()
    return every.join(scored, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "detected")


def language_audit(
    docs: DataFrame,
    profiles: LanguageProfiles | None = None,
    language: str = "language",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Claimed against detected language, with the number of documents and of misses.

    Without profiles they are learnt from the documents' own claims, of which most must be right.
    """
    profiles = profiles or train_profiles(docs, language, text)
    claims = docs.select(F.col(doc_id).alias("doc_id"), F.col(language).alias("language"))
    detected = detect_language(docs, profiles, text, doc_id).withColumnRenamed("doc_id", "_id")
    joined = claims.join(detected, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.groupBy("language", "detected").agg(
        F.count("*").alias("n_docs"), F.count_if(~F.col("language").eqNullSafe(F.col("detected"))).alias("n_misses")
    )
