"""Join sides whose size is measured before they are broadcast."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitloom.functions.guards import reject
from splitloom.session import shared_folder

BROADCAST_BYTES = 64 * 1024 * 1024


def stored(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, out of reach of a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured_bytes(df: DataFrame) -> int:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.sum(F.octet_length(F.to_json(row)))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast a join side if it measures small.

    Beyond the limit the join shuffles, and adaptive execution splits hot keys
    of the other side.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def lookup_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A join side computed once, so that measuring it costs no second run."""
    return broadcast_if_small(stored(df), limit)


def attach_lookup(
    docs: DataFrame, lookup: DataFrame, on: Mapping[str, str], on_missing: str = "error"
) -> DataFrame:
    """Add the columns of a lookup with unique keys; they replace columns of that name.

    `on` maps columns of `docs` to columns of `lookup`. A document without entry
    is an error, unless `on_missing` is "keep"; two entries of one key are, too. An empty
    lookup adds nothing.
    """
    if on_missing not in ("error", "keep"):
        raise ValueError("on_missing must be 'error' or 'keep'")
    side = lookup_side(
        lookup.select(*[F.col(c).alias(f"_r_{c}") for c in lookup.columns], F.lit(True).alias("_hit"))
    )
    if side.isEmpty():
        return docs
    keys = [F.col(f"_r_{right}") for right in on.values()]
    twice = side.groupBy(*keys).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"several entries for {list(twice[:-1])}")
    match = [F.col(left) == F.col(f"_r_{right}") for left, right in on.items()]
    joined = docs.join(side, match, "left")
    if on_missing == "error":
        keys = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
        joined = reject(joined, F.col("_hit").isNull(), F.concat(F.lit("no entry for "), keys))
    for column in lookup.columns:
        new = F.col(f"_r_{column}")
        if column in docs.columns:
            new = F.when(F.col("_hit"), new).otherwise(F.col(column))
        joined = joined.withColumn(column, new)
    return joined.drop("_hit", *[f"_r_{c}" for c in lookup.columns])
