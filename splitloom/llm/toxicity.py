"""Toxicity from confirmed examples and unlabelled text: non-negative PU learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import clear_worker, give_back, id_bucket, kept, texts_of

#: Bounds of the fitting sample: confirmed documents, and unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 12_000
BUCKETS = 1 << 20
#: A feature is kept if so many confirmed documents have it, if the estimated share of toxic
#: documents among those that have it is so high, and so many standard errors off chance.
LEAST_DOCS, LEAST_SHARE, LEAST_ERRORS = 5, 0.5, 3.0
MOST_FEATURES = 20_000
PREFIXES = (4, 5, 6)
REMEMBERED = 100_000
HASHES = 16
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(chunk: str) -> tuple[int, ...]:
    """Buckets of each run of letters in a chunk: the lower-cased word, and its first four to six letters."""
    out = []
    for word in _LETTERS.findall(chunk.lower()):
        out.append(crc32(word.encode()) % BUCKETS)
        out += [crc32(f"{word[:n]}*".encode()) % BUCKETS for n in PREFIXES if len(word) >= n]
    return tuple(out)


def document_features(text: str, known: dict[str, tuple[int, ...]]) -> set[int]:
    found: set[int] = set()
    for chunk in set(text.split()):
        own = known.get(chunk)
        if own is None:
            if len(known) >= REMEMBERED:
                known.clear()
            own = known[chunk] = word_features(chunk)
        found.update(own)
    return found


@dataclass
class Model:
    """Weights of the kept buckets."""

    weights: dict[int, float]
    bias: float

    def score(self, text: str, known: dict[str, tuple[int, ...]]) -> float:
        """Probability between 0 and 1; `known` remembers which kept buckets a chunk has."""
        hits: set[int] = set()
        for chunk in set(text.split()):
            own = known.get(chunk)
            if own is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = known[chunk] = tuple(x for x in word_features(chunk) if x in self.weights)
            if own:
                hits.update(own)
        total = self.bias + sum(self.weights[x] for x in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def min_hashes(features: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    factors = np.random.default_rng(7).integers(1, 1 << 31, hashes, dtype=np.int64) | 1
    if not len(features):
        return np.zeros(hashes, np.int64)
    return np.array([((features.astype(np.int64) * factor) & 0xFFFFFFFF).min() for factor in factors])


def near_copies(signatures: np.ndarray, same: int = 8) -> np.ndarray:
    """Which rows agree in half of their min-hashes or more with an earlier row that is none of these."""
    kept = np.zeros(len(signatures), bool)
    for n, own in enumerate(signatures):
        kept[n] = not ((signatures[:n][kept[:n]] == own).sum(axis=1) >= same).any()
    return ~kept


def _sums(ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(rows, weights=weights[ids], minlength=count)


def nn_pu_fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float, steps: int = 400,
    rate: float = 0.1, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model by the non-negative PU risk with logistic loss.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second part
    turns negative, the step goes up its gradient instead, as the estimator asks.
    """
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (positive, unlabelled)]
    rows = [np.repeat(np.arange(len(x)), [len(one) for one in x]) for x in (positive, unlabelled)]
    counts = [max(1, len(positive)), max(1, len(unlabelled))]
    weights, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        p, u = (1 / (1 + np.exp(-(_sums(flat[k], rows[k], weights, counts[k]) + bias))) for k in (0, 1))
        negative = np.log1p(np.exp(np.log(np.maximum(u, 1e-12) / np.maximum(1 - u, 1e-12)))).mean()
        taken = prior * -np.log(np.maximum(1 - p, 1e-12)).mean()
        # d/dg of softplus(g) is sigmoid(g); of softplus(-g), sigmoid(g) - 1.
        up, down = prior * (p - 1) / counts[0], (u / counts[1], -prior * p / counts[0])
        if negative - taken < 0:
            at_p, at_u = -down[1], -down[0]
        else:
            at_p, at_u = up + down[1], down[0]
        gradient = np.bincount(flat[0], weights=at_p[rows[0]], minlength=features)
        gradient += np.bincount(flat[1], weights=at_u[rows[1]], minlength=features)
        gradient = np.append(gradient + decay * weights / max(1, features), at_p.sum() + at_u.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def marking_features(counts: pd.DataFrame, positives: int, unlabelled: int, prior: float) -> np.ndarray:
    """Buckets (feature, p, u documents that have it) that mark confirmed documents, the strongest first, then sorted."""
    p = (counts["p"].to_numpy() + 0.5) / (positives + 1)
    u = (counts["u"].to_numpy() + 0.5) / (unlabelled + 1)
    spread = np.sqrt(p * (1 - p) / (positives + 1) + u * (1 - u) / (unlabelled + 1))
    strength = (p - u) / spread
    good = (prior * p >= LEAST_SHARE * u) & (strength >= LEAST_ERRORS)
    features = counts["feature"].to_numpy()[good]
    order = np.lexsort((features, -strength[good]))[:MOST_FEATURES]
    return np.sort(features[order])


def _sample(ids: DataFrame, most: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _featurised(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clear_worker()
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [np.array(sorted(document_features(t, known)), np.int32) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype(str),
                    "confirmed": batch["confirmed"],
                    "features": found,
                    "hashes": [min_hashes(one) for one in found],
                }
            )

    return texts.mapInPandas(run, "doc_id string, confirmed boolean, features array<int>, hashes array<long>")


def fit_sample(sample: DataFrame, prior: float) -> Model:
    """Keep features that mark confirmed documents, then fit them by the PU risk.

    Near copies of confirmed documents are left out: one much-copied text would make
    markers of all its words. Counts are made by Spark; of each document the driver
    only sees the kept features.
    """
    signs = sample.where("confirmed").select("doc_id", "hashes").orderBy("doc_id").toPandas()
    copies = near_copies(np.array(signs["hashes"].tolist(), np.int64).reshape(len(signs), HASHES))
    dropped = sorted(set(signs["doc_id"][copies]) - set(signs["doc_id"][~copies]))
    if dropped:
        # At most as many ids as confirmed documents in the sample. From a list of rows, executors would start a
        # second kind of Python workers, whose daemon stays.
        gone = pa.table({"doc_id": pa.array(dropped, pa.string()), "confirmed": pa.array([True] * len(dropped))})
        gone = sample.sparkSession.createDataFrame(gone, "doc_id string, confirmed boolean")
        sample = sample.join(F.broadcast(gone), ["doc_id", "confirmed"], "left_anti")
    sizes = {row.confirmed: row["count"] for row in sample.groupBy("confirmed").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model({}, float(np.log(prior / (1 - prior))))
    flags = [F.sum(F.when(F.col("confirmed") == side, 1).otherwise(0)).alias(name) for name, side in (("p", True), ("u", False))]
    counts = sample.select("confirmed", F.explode("features").alias("feature")).groupBy("feature").agg(*flags)
    kept_features = marking_features(counts.where(F.col("p") >= LEAST_DOCS).toPandas(), sizes[True], sizes[False], prior)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(kept_features, one)).astype(np.int32) for one in batch["features"]]
            yield pd.DataFrame({"confirmed": batch["confirmed"], "places": own})

    small = sample.select("confirmed", "features").mapInPandas(placed, "confirmed boolean, places array<int>").toPandas()
    sides = [[np.asarray(x, np.int64) for x in small["places"][small["confirmed"] == side]] for side in (True, False)]
    weights, bias = nn_pu_fit(*sides, len(kept_features), prior)
    return Model({int(x): float(w) for x, w in zip(kept_features, weights)}, bias)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on a bounded sample: at most so many confirmed documents and so many others.

    `labels` has doc_id and toxic (1 for confirmed); several rows of one document count
    as confirmed if any is. NULL labels and ids are skipped. The class prior is the
    share of confirmed documents among the labelled ones. Without a confirmed or an
    unlabelled document the model has no features and scores the prior.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("confirmed"))
    share = known.agg(F.avg(F.col("confirmed").cast("double"))).first()[0]
    prior = min(0.5, max(1e-4, share or 0.0))
    texts = texts_of(docs).where("doc_id IS NOT NULL")
    one = _sample(known.where("confirmed").select("doc_id"), positives)
    other = _sample(texts.select("doc_id").distinct(), unlabelled)
    # At most `positives` + `unlabelled` ids.
    chosen = one.select("doc_id", F.lit(True).alias("confirmed")).unionByName(
        other.select("doc_id", F.lit(False).alias("confirmed"))
    )
    sample = kept(_featurised(texts.join(F.broadcast(chosen), "doc_id")), "toxicity-sample")
    return fit_sample(sample, prior)


def score_column(text: Column, model: Model) -> Column:
    """The score of whole texts; NULL and empty texts score the bias."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        clear_worker()
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pa.array([model.score(value.as_py() or "", known) for value in texts], pa.float64())
        texts = None
        known.clear()
        give_back()

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted; only rows not held out are learnt from.

    Held out by default: crc32 of the id as text has remainder 1 by 3. Repeated rows
    are scored each; a NULL id is scored, never learnt from. Empty tables give no
    rows. Further columns are left out.
    """
    held_out = id_bucket("doc_id", 3) == 1 if held_out is None else held_out
    texts = texts_of(docs)
    model = fit(texts.where(~held_out), labels.where(~held_out))
    scored = texts.select("doc_id", held_out.alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
