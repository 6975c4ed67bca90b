"""Sentence ends learnt from texts that nobody has marked.

After Kiss and Strunk (2006): an abbreviation is a short word that goes with its period
more closely than chance has it, measured by likelihood ratios over counts per language;
a frequent sentence starter is a capitalised word that follows sure sentence ends more
often than chance has it. Both come from one pass of aggregation each, in which tasks count
what they read before anything is shuffled. They are applied to a text by built-in functions,
which look only at tokens that may end a sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from splitloom.functions.text import BLANK, BLANKS, LINE_ENDS, ends_with_any, let, strip_blanks
from splitloom.operators.joins import stored

#: From the publication: the least scores of an abbreviation and of a sentence starter, and the
#: share of periods that an abbreviation is tested for.
ABBREVIATION_SCORE, STARTER_SCORE, PERIOD_SHARE = 0.3, 30.0, 0.99
#: Words of a model, which the driver holds and the plan names; more are an error.
MOST_WORDS = 100_000

#: Distinct things that a task counts before it hands them on.
MOST_COUNTED = 400_000

OPENING, CLOSING = "\"'([«„“”‘’", "\"')]»“”‘’"
MARKS = ".!?…"
SOLID = f"[^{BLANK[1:-1]}]"
#: A stretch up to a token with a mark, with that token and the blanks behind it; or the rest.
SEGMENT = f"[^{MARKS}]*+[{MARKS}]{SOLID}*+{BLANK}*+|[^{MARKS}]++"

_PERIOD = ord(".")
_BLANK_BYTES = BLANKS.encode()
_BLANK_RUNS = re.compile(f"[{BLANKS}]+".encode())
_LINE_ENDS = tuple(end.encode() for end in LINE_ENDS)


def tokens_in(text: bytes) -> list[bytes]:
    """What stands between the blanks of a UTF-8 text, stripped as `strip_blanks` has it."""
    for end in _LINE_ENDS:
        if text.endswith(end):
            text = text.removesuffix(end).rstrip(_BLANK_BYTES) + end
            break
    if b"\v" in text:  # no blank here, but one for bytes.split
        return [token for token in _BLANK_RUNS.split(text) if token]
    return text.split()


def dotted_pairs(text: bytes) -> list[bytes]:
    """Each token with a period, and the one behind it, with a space between."""
    tokens = tokens_in(text)
    return [token + b" " + after for token, after in zip(tokens, tokens[1:]) if _PERIOD in token]


def counted_in_tasks(
    docs: DataFrame, language: str, text: str, name: str, find: Callable[[bytes], Iterable[bytes]]
) -> DataFrame:
    """(language, name, n): what is found in the texts, counted where they are read and then summed up."""
    texts = docs.select(F.col(language).alias("language"), F.col(text).cast("binary").alias("text"))
    key = texts.schema["language"].dataType
    arrow_key = to_arrow_type(key)

    def rows(counts: dict[object, Counter]) -> Iterator[pa.RecordBatch]:
        for value, counter in counts.items():
            columns = [pa.array([value] * len(counter), arrow_key), pa.array([*counter], pa.binary()), pa.array([*counter.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["language", name, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[object, Counter] = {}
        held = 0
        for batch in batches:
            for value, content in zip(batch.column("language"), batch.column("text")):
                content = content.as_py()
                if not content:
                    continue
                counter = counts.setdefault(value.as_py(), Counter())
                held -= len(counter)
                counter.update(find(content))
                held += len(counter)
                if held >= MOST_COUNTED:
                    yield from rows(counts)
                    counts, held = {}, 0
        yield from rows(counts)

    parts = texts.mapInArrow(run, f"language {key.simpleString()}, {name} binary, n long")
    return parts.groupBy("language", F.col(name).cast("string").alias(name)).agg(F.sum("n").alias("n"))


def core_of(token: Column) -> Column:
    """A token without quotes and brackets around it."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def word_of(core: Column) -> Column:
    return F.lower(F.rtrim(core, F.lit(".,;:!?…")))


def has_period(core: Column) -> Column:
    return core.endswith(".") & ~core.endswith("..")


def is_word(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def _ln(value: Column) -> Column:
    # A share of zero only occurs with a count of zero, for which the product counts as zero.
    return F.when(value > 0, F.ln(value)).otherwise(0.0)


def word_counts(docs: DataFrame, language: str = "language", text: str = "text") -> DataFrame:
    """(language, word, n_period, n_plain): how often each word has a period behind it, and how often not."""
    # Tokens are counted as they stand first, so that each is looked at once.
    counted = counted_in_tasks(docs, language, text, "token", tokens_in)
    core = core_of(F.col("token"))
    words = counted.select("language", word_of(core).alias("word"), has_period(core).alias("period"), "n")
    return words.where(is_word(F.col("word"))).groupBy("language", "word").agg(
        F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("n_period"),
        F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("n_plain"),
    )


def abbreviations(counts: DataFrame) -> DataFrame:
    """The words of `word_counts` that are abbreviations, with their scores.

    The likelihood ratio shrinks with the word's length and with each time it stands without a
    period, and grows with periods inside it.
    """
    sums = counts.groupBy("language").agg(
        F.sum("n_period").alias("periods"), F.sum(F.col("n_period") + F.col("n_plain")).alias("total")
    )
    joined = counts.where("n_period > 0").alias("c").join(F.broadcast(sums.alias("s")), F.expr("c.language <=> s.language"))
    letters = F.length(F.replace("word", F.lit("."))).cast("double")
    share = F.col("periods") / F.col("total")
    chance = F.col("n_period") * _ln(share) + F.col("n_plain") * _ln(1 - share)
    bound = F.col("n_period") * math.log(PERIOD_SHARE) + F.col("n_plain") * math.log(1 - PERIOD_SHARE)
    inner = F.length("word") - letters
    score = 2 * (bound - chance) * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_plain"))
    scored = joined.select("c.language", "word", "n_period", "n_plain", score.alias("score"))
    return scored.where(F.col("score") >= ABBREVIATION_SCORE)


def sentence_starters(
    docs: DataFrame, counts: DataFrame, known: Mapping[str | None, frozenset[str]], language: str = "language", text: str = "text"
) -> DataFrame:
    """(language, word, n_after, n_all, score): capitalised words that follow sentence ends more than chance has it.

    A sentence ends for sure at a period behind a word of several letters that is no abbreviation.
    """
    rows = counted_in_tasks(docs, language, text, "pair", dotted_pairs)
    core, following = (core_of(F.substring_index("pair", " ", n)) for n in (1, -1))
    word = word_of(core)
    sure = has_period(core) & (F.length(F.replace(word, F.lit("."))) > 1) & is_word(word)
    ends = rows.where(sure & ~known_word(known, F.col("language"), word))
    after = ends.groupBy("language", word_of(following).alias("word")).agg(
        F.sum(F.when(following.rlike(r"^\p{Lu}"), F.col("n")).otherwise(0)).alias("n_after"), F.sum("n").alias("n_ends")
    )
    after = stored(after)
    sums = counts.groupBy("language").agg(F.sum(F.col("n_period") + F.col("n_plain")).alias("total"))
    ends_by = after.groupBy("language").agg(F.sum("n_ends").alias("ends"))
    sums = sums.alias("t").join(ends_by.alias("e"), F.expr("t.language <=> e.language")).select("t.language", "total", "ends")
    found = after.where(is_word(F.col("word")) & (F.col("n_after") > 0)).alias("a").join(
        counts.alias("c"), F.expr("a.language <=> c.language AND a.word = c.word")
    ).join(F.broadcast(sums.alias("s")), F.expr("a.language <=> s.language"))
    a, b, c, n = (F.col(x).cast("double") for x in ("n_after", "ends", "n_all", "total"))
    rows = found.select(
        "a.language", "a.word", "n_after", (F.col("n_period") + F.col("n_plain")).alias("n_all"), "ends", "total"
    )

    def likelihood(hits: Column, trials: Column, share: Column) -> Column:
        return hits * _ln(share) + (trials - hits) * _ln(1 - share)

    score = 2 * (
        likelihood(a, b, a / b) + likelihood(c - a, n - b, (c - a) / (n - b)) - likelihood(a, b, c / n) - likelihood(c - a, n - b, c / n)
    )
    rows = rows.withColumn("score", score)
    return rows.where((F.col("score") >= STARTER_SCORE) & (a / b > c / n)).drop("ends", "total")


def known_word(known: Mapping[str | None, frozenset[str]], language: Column, word: Column) -> Column:
    """Is it one of the words known of its language?"""
    found = F.lit(False)
    for name, words in sorted(known.items(), key=str):
        if words:
            found = found | (language.eqNullSafe(F.lit(name)) & word.isin(*sorted(words)))
    return found


@dataclass(frozen=True)
class SentenceModel:
    """Abbreviations and frequent sentence starters per language, in lower case and without the last period."""

    abbreviations: Mapping[str | None, frozenset[str]]
    starters: Mapping[str | None, frozenset[str]]


def words_by_language(table: DataFrame) -> dict[str | None, frozenset[str]]:
    """The words of a model's table, on the driver; too many are an error."""
    rows = table.select("language", "word").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words of a sentence model")
    found: dict[str | None, set[str]] = {}
    for name, word in rows:
        found.setdefault(name, set()).add(word)
    return {name: frozenset(words) for name, words in found.items()}


def train_sentences(docs: DataFrame, language: str = "language", text: str = "text") -> SentenceModel:
    """Learn from the texts themselves, each language for itself."""
    counts = stored(word_counts(docs, language, text))
    known = words_by_language(abbreviations(counts))
    return SentenceModel(known, words_by_language(sentence_starters(docs, counts, known, language, text)))


def without_end(text: Column) -> Column:
    """A text without the blanks behind it, which are spaces mostly."""
    bare = F.rtrim(text)
    return F.when(ends_with_any(bare, BLANKS), F.rtrim(text, F.lit(BLANKS))).otherwise(bare)


def end_token(text: Column, n: int) -> Column:
    """The first (1) or last (-1) token of a text without blanks there."""
    for blank in BLANKS:
        text = F.substring_index(text, blank, n)
    return text


def segments_of(text: Column) -> Column:
    """A text cut behind each token with a mark, which alone may end a sentence; blanks stay behind the token."""

    def bare(text: Column) -> Column:
        return F.when(ends_with_any(text, BLANKS + LINE_ENDS), strip_blanks(text)).otherwise(F.ltrim(text, F.lit(BLANKS)))

    return F.regexp_extract_all(let(text, bare), F.lit(SEGMENT), F.lit(0))


def split_sentences(text: Column, language: Column, model: SentenceModel) -> Column:
    """The sentences of a text, as they stand in it, without the blanks between them.

    One ends at ! or ? and at a period, but not behind an abbreviation, a single letter or an
    ellipsis, unless a capitalised sentence starter follows, nor behind a number before a small
    letter. No text, no sentence.
    """

    def ends(segment: Column, following: Column) -> Column:
        core = core_of(end_token(without_end(segment), -1))
        return F.when(following.isNull(), True).otherwise(let(core, lambda core: decided(core, following)))

    def decided(core: Column, following: Column) -> Column:
        word, after = word_of(core), core_of(end_token(following, 1))
        starts = after.rlike(r"^\p{Lu}") & known_word(model.starters, language, word_of(after))
        doubtful = core.endswith("..") | core.endswith("…") | word.rlike(r"^\p{L}\z") | known_word(model.abbreviations, language, word)
        return (
            F.when(core.endswith("!") | core.endswith("?"), True)
            .when(~(core.endswith(".") | core.endswith("…")), False)
            .when(doubtful, starts)
            .otherwise(~(word.rlike(r"^[0-9]+\z") & after.rlike(r"^\p{Ll}")))
        )

    def cut(held: Column) -> Column:
        flags = F.zip_with(held, F.slice(held, F.lit(2), F.size(held)), ends)
        places = F.filter(F.transform(flags, lambda flag, i: F.when(flag, i + 1)), lambda place: place.isNotNull())
        cuts = let(F.struct(held.alias("segments"), places.alias("places")), joined)
        return F.when(F.size(held) > 0, cuts).otherwise(F.array().cast("array<string>"))

    def joined(both: Column) -> Column:
        def sentence(end: Column, k: Column) -> Column:
            before = F.coalesce(F.get(both["places"], k - 1), F.lit(0))
            whole = F.array_join(F.slice(both["segments"], before + 1, end - before), "")
            return let(whole, lambda one: F.when(ends_with_any(one, LINE_ENDS), strip_blanks(one)).otherwise(without_end(one)))

        return F.transform(both["places"], sentence)

    return let(segments_of(text), cut)
