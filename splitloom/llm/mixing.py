"""Soft-membership mixing: document rates that bring expected domain tokens to target weights."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import kept, let
from splitloom.operators.joins import broadcast_if_small

#: Bound of the labelled rows that fit the classifier, and its size.
LABELLED, FEATURES = 20_000, 4_096
#: Documents whose posteriors have equal whole parts of this number share a rate.
PARTS = 50
#: Steps of the fit, Newton steps and halvings in each, and the first step's length by the inverse curvature.
STEPS, NEWTON_STEPS, HALVINGS, FIRST_LENGTH = 20, 30, 6, 300.0
#: Targets are met to this share, or the squares proven to be within this share of the least.
TOLERANCE, CERTIFIED = 1e-4, 5e-3


#: White space between words.
SPACE = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """The lower-cased words of a text; NULL and blank texts have none."""
    inner = F.btrim(F.lower(text), F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _sampled(labelled: DataFrame, label: Column, most: int) -> DataFrame:
    """(text, label): at most `most` distinct texts of a known label, those of the least hashes.

    Hashes are compared before any text is moved, and copies of a text meet within
    their tasks first, so that a hot text sends few rows. A text with several labels
    has the least one.
    """
    key = F.col("text_hash") if "text_hash" in labelled.columns else F.xxhash64("text")
    known = labelled.select("text", label.alias("label"), key.alias("hash")).where("label >= 0")
    last = known.select("hash").distinct().orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    few = known.where(F.col("hash") <= F.lit(last).cast("long"))
    chosen = few.groupBy("hash").agg(F.min("label").alias("label"), F.min(F.struct("label", "text")).alias("row"))
    return chosen.select("row.text", "label")


def _linear(buckets: Column, weights: np.ndarray, bias: float) -> Column:
    """The bias plus the mean weight of the buckets, as sum over an array."""
    table = F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda a, x: a + F.get(table, x))
    return F.lit(float(bias)) + total / F.greatest(F.size(buckets), F.lit(1))


def _softmax(scores: list[Column]) -> Column:
    def shares(all_scores: Column) -> Column:
        top = F.array_max(all_scores)
        powers = F.transform(all_scores, lambda s: F.exp(s - top))
        return let(powers, lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y)))

    return let(F.array(*scores), shares)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """Add `tokens` (words), `posterior` and `parts`, its whole parts of PARTS, one per domain each.

    `labelled` has text and domain; at most LABELLED distinct texts of known domains fit a
    multinomial logistic regression over hashed words. A `text_hash` (xxhash64 of the text),
    where a join that made `labelled` had it already, keeps texts out of that join. Without two domains to tell
    apart, every document has the shares of the labels, or equal ones without any.
    The parts are rounded down, and the likeliest domain takes what is left.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    hashing = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=FEATURES)
    normal = Normalizer(inputCol="__tf", outputCol="__x", p=1.0)
    sample = _sampled(labelled, place.cast("double"), LABELLED).withColumn("__words", F.transform(_words(F.col("text")), lambda word: F.hash(word)))
    sample = kept(normal.transform(hashing.transform(sample)).select("__x", "label"), "mixing-sample")
    seen = {int(row.label): row.n for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # The regression's buckets: its hash of whole numbers is the one of SQL.
    bucket = lambda word: F.pmod(F.hash(F.hash(word)), F.lit(FEATURES))
    words = docs.withColumn("__words", F.transform(_words(F.col("text")), bucket))
    if len(seen) < 2:
        total = sum(seen.values())
        flat = [F.lit(seen.get(n, 0) / total if total else 1 / len(domains)) for n in range(len(domains))]
        share = F.array(*flat)
    else:
        # Domains without a label get no weight.
        order = sorted(seen)
        dense = F.array_position(F.array(*[F.lit(float(n)) for n in order]), F.col("label")) - 1
        regression = LogisticRegression(
            featuresCol="__x", labelCol="label", family="multinomial", maxIter=30, regParam=1e-5
        )
        model = regression.fit(sample.select("__x", dense.cast("double").alias("label")))
        weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        # Only differences to the last domain count, so that one has the score zero.
        scores = let(
            F.col("__words"),
            lambda found: _softmax(
                [_linear(found, weights[n] - weights[-1], bias[n] - bias[-1]) for n in range(len(order) - 1)]
                + [F.lit(0.0)]
            ),
        )
        share = let(
            scores,
            lambda p: F.array(*[F.get(p, F.lit(order.index(n))) if n in seen else F.lit(0.0) for n in range(len(domains))]),
        )

    def rounded(p: Column) -> Column:
        floors = F.transform(p, lambda x: F.floor(x * PARTS).cast("int"))
        top = F.array_position(p, F.array_max(p)) - 1
        rest = PARTS - F.aggregate(floors, F.lit(0), lambda a, x: a + x)
        return F.transform(floors, lambda x, i: x + F.when(i == top, rest).otherwise(0))

    known = words.withColumns({"tokens": F.size("__words").cast("long"), "posterior": share})
    return known.withColumn("parts", let(F.col("posterior"), rounded)).drop("__words")


def cells_of(rows: DataFrame, count: int) -> DataFrame:
    """(parts, tokens, posterior) per distinct parts: the tokens of all its rows and the mean posterior of a token."""
    mean = [
        F.coalesce(F.sum(F.col("tokens") * F.get("posterior", F.lit(n))) / F.nullif(F.sum("tokens"), F.lit(0)),
                   F.avg(F.get("posterior", F.lit(n))))
        for n in range(count)
    ]
    return rows.groupBy("parts").agg(F.sum("tokens").alias("tokens"), F.array(*mean).alias("posterior"))


def _rate(path: list[list[float]], least: float) -> Column:
    """The rate of a cell's mean posterior after the steps in `path`, each projected."""
    start = F.lit(max(1.0, least))
    if not path:
        return start
    share = [F.get("posterior", F.lit(n)) for n in range(len(path[0]))]
    moves = F.transform(
        F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in path]),
        lambda step: sum([share[n] * F.get(step, F.lit(n)) for n in range(len(path[0]))], F.lit(0.0)),
    )
    return F.aggregate(moves, start, lambda rate, move: F.greatest(F.lit(float(least)), rate - move))


@dataclass
class Sums:
    """What a move leaves, summed over the cells; see `_looks`."""

    potential: float
    settled: float
    expected: np.ndarray
    gram: np.ndarray
    lowest: float


def _looks(cells: DataFrame, least: float, path: list[list[float]], moves: list[np.ndarray]) -> list[Sums]:
    """Sums over the cells for each of a few moves after the steps in `path`, in one pass.

    A cell's rate goes from r to u = r - (posterior . move), or to the least one. `potential` is the sum of
    tokens times an integral of that rate by u, `settled` what it is once the rate is u, `expected` the tokens of each domain, `gram` the products of
    posteriors where u is above the least, and `lowest` the least inner product with the move.
    """
    count = len(moves[0])
    share = [F.get("posterior", F.lit(n)) for n in range(count)]
    tries = F.array(*[F.array(*[F.lit(float(x)) for x in move]) for move in moves])
    along = sum([share[n] * F.get("move", F.lit(n)) for n in range(count)], F.lit(0.0))
    rows = cells.where("tokens > 0").withColumn("rate", _rate(path, least)).select("*", F.posexplode(tries).alias("n", "move"))
    moved = rows.withColumn("along", along).withColumn("u", F.col("rate") - F.col("along"))
    bound, tokens, free = F.lit(float(least)), F.col("tokens"), F.col("u") > least
    area = F.when(free, F.col("u") * F.col("u") / 2).otherwise(bound * F.col("u") - bound * bound / 2)
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    found = moved.groupBy("n").agg(
        F.sum(tokens * area).alias("potential"),
        F.sum(tokens * F.greatest("u", bound) * F.greatest("u", bound) / 2).alias("settled"), F.min("along").alias("lowest"),
        *[F.sum(tokens * F.greatest("u", bound) * share[a]).alias(f"e{a}") for a in range(count)],
        *[F.sum(F.when(free, tokens * share[a] * share[b]).otherwise(0.0)).alias(f"g{a}_{b}") for a, b in pairs],
    )
    sums = [Sums(0.0, 0.0, np.zeros(count), np.zeros((count, count)), 0.0) for _ in moves]
    for row in found.collect():
        gram = np.zeros((count, count))
        for a, b in pairs:
            gram[a, b] = gram[b, a] = row[f"g{a}_{b}"]
        sums[row.n] = Sums(row.potential, row.settled, np.array([row[f"e{a}"] for a in range(count)]), gram, row.lowest)
    return sums


def projected_steps(
    look: Callable[[list[list[float]], list[np.ndarray]], list[Sums]], targets: list[float], least: float
) -> list[list[float]]:
    """Steps of implicit projected gradient to the least squares of the gaps, each by its target.

    A step takes the gradient where it ends, so that a long one stays stable: its move solves
    move = length * gap(after the move) / target, one equation per domain, by Newton's method
    with halvings on the potential. Steps grow tenfold while they help and shrink otherwise. They end when every
    target is met to TOLERANCE, or when the dual problem proves that the squares are within CERTIFIED of
    the least there are: adding one number to all multipliers adds it to every cell's slope, as
    posteriors sum to one, so that any gap gives a bound.
    """
    aim = np.array(targets)
    scale = np.maximum(aim, 1e-9 * max(aim.sum(), 1.0))
    nowhere = np.zeros(len(aim))
    path: list[list[float]] = []
    here = look(path, [nowhere])[0]
    have = here.expected / max(1.0, least)
    if not have.any():
        return path
    length = FIRST_LENGTH / (have / scale).sum()
    for _ in range(STEPS):
        gap = here.expected - aim
        slope, squares = gap / scale, (gap**2 / scale).sum()
        if np.abs(slope).max() < TOLERANCE:
            break
        multiplier = slope - min(0.0, look(path, [slope])[0].lowest)
        bound = least * (have @ multiplier) - multiplier @ aim - (multiplier**2 * scale).sum() / 2
        if squares / 2 - bound <= CERTIFIED * squares / 2:
            break
        move, after = nowhere, here

        def left(at: np.ndarray, sums: Sums) -> np.ndarray:
            return at * scale / length + aim - sums.expected

        def height(at: np.ndarray, sums: Sums) -> float:
            return (at**2 * scale).sum() / 2 / length + aim @ at + sums.potential

        def error(at: np.ndarray, sums: Sums) -> float:
            return np.abs(left(at, sums) / np.sqrt(scale)).max()

        for _ in range(NEWTON_STEPS):
            if error(move, after) <= 1e-3 * np.abs((after.expected - aim) / np.sqrt(scale)).max():
                break
            way = np.linalg.lstsq(after.gram + np.diag(scale / length), left(move, after), rcond=None)[0]
            tries = [move - way / 2.0**n for n in range(HALVINGS)]
            seen = look(path, tries)
            heights = [height(at, sums) for at, sums in zip(tries, seen)]
            best, now = int(np.argmin(heights)), height(move, after)
            if heights[best] >= now - 1e-11 * abs(now):  # equal but for rounding
                errors = [error(at, sums) for at, sums in zip(tries, seen)]
                best = int(np.argmin(errors))
                if errors[best] >= error(move, after):
                    break
            move, after = tries[best], seen[best]
        if ((after.expected - aim) ** 2 / scale).sum() < squares:
            path, length = [*path, move.tolist()], length * 10
            here = replace(after, potential=after.settled)
        else:
            length /= 30
    return path


def fit_rates(cells: DataFrame, targets: list[float], least: float = 0.0) -> list[list[float]]:
    """Projected gradient for the least squares over domains of expected less target tokens.

    `cells` has (posterior, tokens): the tokens of all documents that share a rate, and the
    unrounded mean posterior of such a token, so that sums over cells are those over documents.
    The gradient of a rate, by its tokens, holds nothing else. Each pass sums over the cells where
    they lie; only sums per domain reach the driver. Targets that rates of at least the least one
    can't meet are missed by the least squares. Returns the steps, which give each rate.
    """
    return projected_steps(partial(_looks, cells, least), targets, least)


def covering_total(have: list[float], weights: list[float]) -> float:
    """The smallest total at which no domain's target is below what it has."""
    return max([h / w for h, w in zip(have, weights) if w > 0], default=0.0)


def mix(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None,
    least: float = 0.0, cover: bool = False, seed: int = 1,
) -> DataFrame:
    """Add tokens, posterior, parts, rate and copies to the rows of `docs`.

    `weights` maps domains to target weights of any positive sum. `total` is the
    expected number of tokens to reach; by default that of the input, or with `cover`
    the smallest that needs no domain cut. `least` is the lower bound of a rate.
    `copies` is the rate rounded up or down by a hash of id and text, so that its
    expectation is the rate.

    NULL and empty texts have no tokens and the rate of their posterior. NULL ids are
    rows like others. Repeated rows have equal rates and copies. An empty table gives no
    rows. Columns of `docs` named tokens, posterior, parts, rate or copies are replaced.
    """
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    domains = sorted(weights)
    aim = [weights[d] / sum(weights.values()) for d in domains]
    rows = kept(posteriors(docs, labelled, domains), "mixing")
    stored = kept(cells_of(rows, len(domains)), "mixing-cells")
    cells = stored.persist()
    share = [F.get("posterior", F.lit(n)) for n in range(len(domains))]
    have = [float(x or 0) for x in cells.agg(*[F.sum(F.col("tokens") * s) for s in share]).first()]
    if total is None:
        total = covering_total(have, aim) if cover else sum(have)
    path = fit_rates(cells, [a * total for a in aim], least) if total else []
    cells.unpersist()
    rates = stored.select(F.col("parts").alias("__parts"), _rate(path, least).alias("rate"))
    plain = rows.drop("rate")
    rated = plain.join(broadcast_if_small(rates), plain["parts"] == F.col("__parts")).drop("__parts")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def repeated(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None,
    least: float = 0.0, cover: bool = False, seed: int = 1,
) -> DataFrame:
    """The rows of `docs`, each as often as its copies by `mix`, with the columns of `docs` as they are.

    Columns of any name keep their values, also those that `mix` would replace.
    """
    own = ("doc_id", "text")
    plain = docs.toDF(*[c if c in own else f"__own{n}" for n, c in enumerate(docs.columns)])
    mixed = mix(plain, labelled, weights, total, least, cover, seed).where("copies > 0")
    rows = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*[F.col(a).alias(b) for a, b in zip(plain.columns, docs.columns)])
