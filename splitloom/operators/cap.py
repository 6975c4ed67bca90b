"""Exact limits on the number of documents per target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitloom.functions.guards import failing, reject
from splitloom.functions.order import seeded_order
from splitloom.operators.joins import broadcast_if_small, lookup_side, stored

# Up to this rank Spark cuts groups inside the scan tasks.
SMALL_LIMIT = 1000

# Below this many rows it costs more to thin them out than to sort them.
ROWS_WORTH_THINNING = 1_000_000


def first_per_group(
    docs: DataFrame, keys: Sequence[str], n: int, doc_id: str = "doc_id", own: str | None = None
) -> DataFrame:
    """The first n rows of every group by `_draw`, however large the group.

    `own` names a column with a limit for each group, none above n. A group that
    holds most rows never meets in one task.
    """
    if n > SMALL_LIMIT:
        return _first_by_prefix(docs, keys, n, doc_id, own)
    # Cut to n rows per group inside each scan task, then per group and share of
    # the tasks, and only then per group.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = _thinned(docs, keys, n, own).withColumn("_share", F.spark_partition_id() % shares)
    for grouping in ([*keys, "_share"], list(keys)):
        window = Window.partitionBy(*grouping).orderBy("_draw", doc_id)
        shared = shared.withColumn("_rank", F.row_number().over(window))
        limit = F.col("_rank") <= n
        if own:
            limit = limit & (F.col("_rank") <= F.col(own))
        shared = shared.where(limit).drop("_rank")
    return shared.drop("_share")


def _thinned(docs: DataFrame, keys: Sequence[str], n: int, own: str | None) -> DataFrame:
    """Leave out rows of large groups that draw too late to be among the first n.

    Draws are evenly spread, so the size of a group tells below which draw about
    twice as many rows lie as are wanted. Whether enough lie there is counted; if
    a single group were short of rows, all rows would stay.
    """
    wanted = F.col(own) if own else F.lit(n)
    sizes = docs.groupBy(*keys, wanted.cast("long").alias("_wanted")).agg(F.count("*").alias("_size"))
    sizes = stored(sizes)
    plenty = 2 * F.col("_wanted") + 64
    total, rest = sizes.agg(F.sum("_size"), F.sum(F.least("_size", plenty))).first()
    if not total or total < ROWS_WORTH_THINNING or rest * 4 > total:
        return docs
    digits = F.lpad(F.lower(F.hex((plenty / F.col("_size") * 16.0**12).cast("long"))), 12, "0")
    # Every hexadecimal draw lies below "g".
    bound = F.when(F.col("_size") > plenty, digits).otherwise(F.lit("g"))
    names = [F.col(key).alias(f"_k_{key}") for key in keys]
    enough = F.least("_size", "_wanted").alias("_enough")
    bounds = broadcast_if_small(sizes.select(*names, bound.alias("_bound"), enough))
    same = [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys]
    early = docs.join(bounds, [*same, F.col("_draw") < F.col("_bound")])
    early = stored(early.select(*docs.columns, "_enough"))
    found = early.groupBy(*keys).agg(F.count("*").alias("_found"), F.max("_enough").alias("_enough"))
    groups, short = found.agg(F.count("*"), F.count_if(F.col("_found") < F.col("_enough"))).first()
    if short or groups < bounds.count():
        return docs
    return early.drop("_enough")


def _first_by_prefix(
    docs: DataFrame, keys: Sequence[str], n: int, doc_id: str, own: str | None
) -> DataFrame:
    """The same for many rows per group, which are never sorted as a whole.

    Draws are evenly spread. Counting them by their first digits tells which
    prefix holds the n-th one; rows before it stay, rows after it go, and only
    the rows of that one prefix are ranked.
    """
    limit = F.col(own).cast("long") if own else F.lit(n).cast("long")
    docs = docs.withColumn("_prefix", F.substring("_draw", 1, 3)).withColumn("_limit", limit)
    cells = docs.groupBy(*keys, "_limit", "_prefix").agg(F.count("*").alias("_count"))
    in_order = Window.partitionBy(*keys).orderBy("_prefix")
    room = F.col("_limit") - (F.sum("_count").over(in_order) - F.col("_count"))
    edges = cells.withColumn("_room", room).where("_room >= 0 and _count > _room")
    # The first prefix that does not fit, if all before it did.
    edges = edges.groupBy(*[F.col(key).alias(f"_k_{key}") for key in keys]).agg(
        F.min("_prefix").alias("_edge"), F.min_by("_room", "_prefix").alias("_room")
    )
    same = [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys]
    placed = docs.join(lookup_side(edges), same, "left").drop(*[f"_k_{key}" for key in keys])
    before = placed.where(F.col("_edge").isNull() | (F.col("_prefix") < F.col("_edge")))
    window = Window.partitionBy(*keys).orderBy("_draw", doc_id)
    at_edge = placed.where(F.col("_prefix") == F.col("_edge"))
    at_edge = at_edge.withColumn("_rank", F.row_number().over(window)).where("_rank <= _room")
    kept = before.unionByName(at_edge.drop("_rank"))
    return kept.drop("_prefix", "_limit", "_edge", "_room")


def reject_short(kept: DataFrame, groups: Sequence[str], n: int, own: str | None = None) -> DataFrame:
    """Fail if a group was cut to fewer rows than its limit."""
    limit = F.col(own) if own else F.lit(n)
    message = F.concat(
        F.lit("fewer than "), limit.cast("string"), F.lit(" documents of "), F.concat_ws(", ", *groups)
    )
    if n <= SMALL_LIMIT:
        # Counted on at most n rows per group, partitioned as they are already.
        counted = kept.withColumn("_n", F.count("*").over(Window.partitionBy(*groups)))
        return reject(counted, F.col("_n") < limit, message).drop("_n")
    by = [*groups, own] if own else list(groups)
    counted = kept.groupBy(*by).agg(F.count("*").alias("_n"))
    short = failing(counted, F.col("_n") < limit, message).select(by)
    return kept.unionByName(short, allowMissingColumns=True)


def cap_docs_per_target(
    docs: DataFrame,
    n: int | None,
    target: str = "author",
    doc_id: str = "doc_id",
    keys: Sequence[str] = (),
    seed: int = 42,
    on_short: str = "error",
) -> DataFrame:
    """Exactly n documents of every target, drawn without replacement.

    `keys` names further grouping columns, such as the split. A target with
    fewer documents is an error, unless `on_short` is "keep". Documents without
    target are dropped. None and 0 set no limit.
    """
    if on_short not in ("error", "keep"):
        raise ValueError("on_short must be 'error' or 'keep'")
    if not n:
        return docs
    if n < 0:
        raise ValueError("the limit must not be negative")
    groups = [*keys, target]
    draw = seeded_order(seed, "document", *[F.col(k) for k in keys], F.col(doc_id))
    ordered = docs.where(F.col(target).isNotNull()).withColumn("_draw", draw)
    kept = first_per_group(ordered, groups, n, doc_id).drop("_draw")
    return reject_short(kept, groups, n) if on_short == "error" else kept
