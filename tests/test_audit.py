"""Languages by trigrams: held-out documents, a hand count, and odd rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from splitloom.catalog.queries import QUERIES
from splitloom.operators import audit

TEXTS = [
    (1, "en", "The cat and the dog are friends with that bird. The weather was fine this morning."),
    (2, "de", "Der Hund und das Pferd sind nicht auf dem Feld. Das Wetter war heute Morgen schön."),
    (3, "fr", "Les chats et le chien sont dans une maison avec des fleurs. Il faisait beau ce matin."),
    (4, "es", "El perro y los gatos son para una casa con las flores. Hacía buen tiempo esta mañana."),
]
SCHEMA = "doc_id long, language string, text string"


def test_held_out_documents(spark, sf_dir):
    rows = QUERIES["detect_language"](spark, sf_dir).collect()
    fresh = [row for row in rows if row.held_out]
    assert len(fresh) > 100
    assert sum(row.language == row.detected for row in fresh) >= 0.95 * len(fresh)


def grams_of(text):
    runs = "".join(c if c.isalpha() else "\n" for c in text.lower()).split()
    return [f" {run} "[n : n + 3] for run in runs for n in range(len(run))]


def test_scores_by_hand(spark):
    taught = spark.createDataFrame(TEXTS, SCHEMA)
    fresh = [(1, None, "Das Pferd und der Hund"), (2, None, "the dog, the bird"), (3, None, "una casa"), (4, None, "le chien")]
    counts = {language: Counter(grams_of(text)) for _, language, text in TEXTS}
    known = {gram for one in counts.values() for gram in one}

    def best(text):
        grams = [gram for gram in grams_of(text) if gram in known]
        scores = {
            name: sum(math.log((one[gram] + 1) / (one.total() + len(known))) for gram in grams) for name, one in counts.items()
        }
        return max(sorted(scores), key=scores.get) if grams else None

    found = audit.detect_language(spark.createDataFrame(fresh, SCHEMA), audit.train_profiles(taught))
    assert dict(map(tuple, found.collect())) == {n: best(text) for n, _, text in fresh} == {1: "de", 2: "en", 3: "es", 4: "fr"}


def test_odd_rows(spark):
    taught = spark.createDataFrame([*TEXTS, (9, None, "no language"), (8, "en", None)], SCHEMA)
    profiles = audit.train_profiles(taught)
    odd = [(1, "x", ""), (2, "x", None), (3, "x", "12345 ???"), (None, "x", "the dog"), (5, "x", "дом"), (6, "x", "the" * 30_000), (6, "x", "the")]
    found = {row.doc_id: row.detected for row in audit.detect_language(spark.createDataFrame(odd, SCHEMA), profiles).collect()}
    assert found == {1: None, 2: None, 3: None, None: "en", 5: None, 6: "en"}
    empty = spark.createDataFrame([], SCHEMA)
    assert audit.detect_language(empty, profiles).collect() == []
    nothing = audit.detect_language(taught, audit.train_profiles(empty)).collect()
    assert {row.detected for row in nothing} == {None}
    assert audit.language_audit(empty).collect() == []


@pytest.mark.parametrize("limit", [None, 0])
def test_same_without_broadcast(spark, sf_dir, limit, monkeypatch):
    from splitloom.operators import joins

    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rows = QUERIES["language_audit"](spark, sf_dir).collect()
    right = sum(row.n_docs - row.n_misses for row in rows)
    assert right >= 0.95 * sum(row.n_docs for row in rows)


def test_trigrams_are_scored_where_they_are_read(spark, monkeypatch):
    """No row per trigram; the same languages as by a join, over windows' edges and for letters of many scripts."""
    profiles = audit.train_profiles(spark.createDataFrame(TEXTS, SCHEMA))
    odd = ["", "a", "ÉTÉ İSTANBUL ΑΣ ß", "Το σπίτι", "дом the", "日本 der", "x\u0301y", "1a2", "😀 und"]
    texts = [(n, None, f"{one} {text} {two}") for n, (one, two) in enumerate((a, b) for a in odd for b in odd) for _, _, text in TEXTS[n % 4 :][:1]]
    rows = spark.createDataFrame(texts + [(n + 1000, None, one) for n, one in enumerate(odd)], SCHEMA)
    found = audit.detect_language(rows, profiles)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    joined = audit.detect_language(rows, audit.LanguageProfiles(profiles.languages, profiles.grams))
    want = sorted(map(tuple, joined.collect()))
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(audit, "WINDOW", 7)
    monkeypatch.setattr(audit, "CELLS", 0)
    assert sorted(map(tuple, audit.detect_language(rows, profiles).collect())) == want


def test_wrong_claims_stand_out(spark):
    rows = [(n, language, text) for n, (_, language, text) in enumerate(TEXTS * 5)] + [(99, "en", TEXTS[1][2])]
    found = audit.language_audit(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in found.where("n_misses > 0").collect()] == [("en", "de", 1, 1)]
    assert found.agg(F.sum("n_docs")).first()[0] == 21
