"""Sentence ends learnt from drawn texts whose true ends are known."""

import random

import pytest
from pyspark.sql import functions as F

from splitloom.catalog.queries import QUERIES
from splitloom.operators import sentences
from splitloom.operators.prepare import chunk_documents

NOUNS = "haus weg stadt fluss garten brief morgen freund stein abend wagen berg".split()
VERBS = "geht liegt kommt steht sieht findet bringt nimmt".split()


def drawn(count: int, short: list[str], seed: int = 1) -> list[str]:
    """Sentences of random words, some with an abbreviation before a word or a name."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = [rng.choice(["der", "die", "das"]), rng.choice(NOUNS), rng.choice(VERBS), rng.choice(NOUNS), rng.choice(VERBS)]
        if rng.random() < 0.4:
            words[3:3] = [rng.choice(short), rng.choice(NOUNS + ["Berlin", "Meier"])]
        words[0] = words[0].capitalize()
        out.append(" ".join(words) + rng.choice([".", ".", ".", ".", "!", "?"]))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    rows = [("de", " ".join(drawn(400, ["z. B.", "bzw.", "Dr.", "usw..."], seed))) for seed in range(6)]
    rows += [("en", " ".join(drawn(400, ["Mr.", "approx."], seed))) for seed in range(6)] + [("de", None), ("en", "")]
    docs = spark.createDataFrame(rows, "language string, text string")
    return docs, sentences.train_sentences(docs)


def split(spark, model, text, language="de"):
    row = spark.createDataFrame([(text, language)], "text string, language string")
    return row.select(sentences.split_sentences(F.col("text"), F.col("language"), model).alias("s")).first().s


def test_learns_abbreviations_per_language(trained):
    _, model = trained
    assert {"bzw", "dr"} <= model.abbreviations["de"] and {"mr", "approx"} <= model.abbreviations["en"]
    assert not model.abbreviations["de"] & {*NOUNS, *VERBS} and "mr" not in model.abbreviations["de"]
    assert {"der", "die", "das"} <= model.starters["de"]


def test_finds_the_sentences_that_were_drawn(spark, trained):
    _, model = trained
    for language, short in (("de", ["z. B.", "bzw.", "Dr.", "usw..."]), ("en", ["Mr.", "approx."])):
        fresh = drawn(300, short, seed=99)
        assert split(spark, model, "  " + " ".join(fresh) + "\n", language) == fresh
    # Without the model each abbreviation ends a sentence.
    plain = sentences.SentenceModel({}, {})
    assert len(split(spark, plain, "Er sah Dr. Meier. Er ging.")) == 3


def test_special_cases(spark, trained):
    _, model = trained
    cases = {
        "Das gilt z. B. hier. Die Stadt liegt dort.": ["Das gilt z. B. hier.", "Die Stadt liegt dort."],
        "Er ging... und kam. Das war gut": ["Er ging... und kam.", "Das war gut"],
        "Er ging... Das Haus steht.": ["Er ging...", "Das Haus steht."],
        "Am 3. mai kam er. Am 3. Mai ging er.": ["Am 3. mai kam er.", "Am 3.", "Mai ging er."],
        "„Der Weg?“ Er \t ging!\n(Das war es.)  Die Stadt.": ["„Der Weg?“", "Er \t ging!", "(Das war es.)", "Die Stadt."],
        "1.5 Liter v2.0": ["1.5 Liter v2.0"],
        "...": ["..."],
        "": [], " \n": [], "x" * 50_000 + ". Das": ["x" * 50_000 + ".", "Das"],
    }
    for text, want in cases.items():
        assert split(spark, model, text) == want
    # A language that was not seen has no words of its own.
    assert split(spark, model, "Siehe Dr. Meier. Er ging.", "xx") == ["Siehe Dr.", "Meier.", "Er ging."]
    assert split(spark, model, None) == []


def test_chunks_of_learnt_sentences(spark, trained):
    _, model = trained
    fresh = drawn(25, ["bzw.", "Dr."], seed=5)
    rows = spark.createDataFrame(
        [(1, "a", "de", "t", " ".join(fresh))], "doc_id long, author string, language string, title string, text string"
    )
    found = chunk_documents(rows, 10, model=model).orderBy("chunk").collect()
    assert [row.text for row in found] == [" ".join(fresh[i : i + 10]) for i in range(0, 25, 10)]


def test_only_tokens_with_a_mark_are_looked_at(spark):
    """A segment holds all tokens up to one that may end a sentence."""
    text = " Wort" * 5_000 + " Dr. Meier!\n Das " + "und so weiter " * 5_000 + "v2.0 "
    row = spark.createDataFrame([(text,)], "text string").select(sentences.segments_of(F.col("text")).alias("s")).first()
    assert len(row.s) == 3 and "".join(row.s) == text.strip() and row.s[1] == "Meier!\n "


def test_odd_blanks_and_ends_of_lines(spark):
    plain = sentences.SentenceModel({}, {})
    cases = {
        "\fAb.\r\nDa. \u2028": ["Ab.", "Da.\u2028"], "Ab. \x85\r\n": ["Ab.", "\x85"], "a\vb. c": ["a\vb.", "c"], "Ab? \t\f ": ["Ab?"],
        "Ab.“\n„Da!" : ["Ab.“", "„Da!"], "…a? b": ["…a?", "b"],
    }
    for text, want in cases.items():
        assert split(spark, plain, text) == want


def test_tasks_count_before_the_shuffle(spark, monkeypatch):
    """Each task hands on a token once, or a bounded table of them at a time, with the same sums."""
    rows = [("de", "Ab a. b\va \x85"), (None, "a. a. b"), ("de", None), ("en", ""), ("de", "a. c \u2028")] * 50
    docs = spark.createDataFrame(rows, "language string, text string").coalesce(2)
    plan = sentences.counted_in_tasks(docs, "language", "text", "token", sentences.tokens_in)
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    want = {
        ("de", "Ab"): 50, ("de", "a."): 100, ("de", "b\va\x85"): 50, ("de", "c\u2028"): 50, (None, "a."): 100, (None, "b"): 50,
    }
    assert {(r.language, r.token): r.n for r in plan.collect()} == want
    monkeypatch.setattr(sentences, "MOST_COUNTED", 3)
    again = sentences.counted_in_tasks(docs, "language", "text", "token", sentences.tokens_in)
    assert {(r.language, r.token): r.n for r in again.collect()} == want
    pairs = sentences.counted_in_tasks(docs, "language", "text", "pair", sentences.dotted_pairs)
    assert {(r.language, r.pair): r.n for r in pairs.collect()} == {
        ("de", "a. b\va\x85"): 50, ("de", "a. c\u2028"): 50, (None, "a. a."): 50, (None, "a. b"): 50,
    }


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(sentences, "MOST_WORDS", 2)
    table = spark.createDataFrame([("de", w) for w in "abc"], "language string, word string")
    with pytest.raises(ValueError):
        sentences.words_by_language(table)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "language string, text string")
    assert sentences.train_sentences(docs) == sentences.SentenceModel({}, {})


def test_query_learns_what_was_put_in(spark, sf_dir):
    rows = QUERIES["train_sentences"](spark, sf_dir).collect()
    short = {(r.language, r.word) for r in rows if r.kind == "abbreviation"}
    assert {("de", "bzw"), ("en", "mr"), ("fr", "mr"), ("es", "mr")} <= short
    assert any(r.kind == "starter" for r in rows)
