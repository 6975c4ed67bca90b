"""Minimax contiguous sharding: the smallest capacity that a greedy walk can hold, filled evenly."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import kept
from splitloom.session import scratch_path

#: Bits of the leading hash that order the groups: at most 2 ** 18 sizes reach the driver.
CELL_BITS = 18
ROWS_PER_FILE = 2_000_000


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Shards that a walk opens when each takes as much as it can hold."""
    shards, room = 1, capacity
    for size in sizes:
        if size > room:
            shards, room = shards + 1, capacity
        room -= size
    return shards


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which the walk needs no more than `shards`."""
    low, high = max([*sizes, -(-sum(sizes) // shards)]), max(sum(sizes), 1)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _level(sizes: np.ndarray, shards: int) -> float:
    """The bytes of a shard if those sizes that are above it have a shard each and the rest is spread evenly."""
    level = sizes.sum() / shards
    while True:
        large = sizes > level
        left = shards - int(large.sum())
        lower = sizes[~large].sum() / left if left > 0 else level
        if lower >= level or left <= 0:
            return level
        level = lower


def _aim(sizes: np.ndarray, shards: int) -> float:
    """The bytes of the first shard: an even share of what comes before the next size that is above the level."""
    level = _level(sizes, shards) if shards > 0 else float(sizes.sum())
    large = np.flatnonzero(sizes > level)
    if not len(large):
        return level
    before = sizes[: large[0]].sum()
    return before / max(1, round(before / level)) if large[0] else float(sizes[0])


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """Positions at which the second and each later shard begins; there may be fewer than asked.

    No shard is above the least capacity. A shard ends where it is nearest to an even share of what
    is left, as long as the rest still fits into the shards that are left.
    """
    capacity, count = smallest_capacity(sizes, shards), len(sizes)
    # The shards that a walk from each position needs, by the end of its first one.
    needed, end, held = [0] * (count + 1), count, 0
    for at in range(count - 1, -1, -1):
        held += sizes[at]
        while held > capacity:
            end -= 1
            held -= sizes[end]
        needed[at] = 1 + needed[end]
    array, cuts = np.array(sizes, dtype=np.int64), []
    filled, left, aim = 0, shards, _aim(array, shards)
    for at, size in enumerate(sizes):
        nearest = filled + size - aim > aim - filled
        spare = left - 1 >= needed[at]
        if filled and (filled + size > capacity or spare and (nearest or count - at < left)):
            cuts.append(at)
            filled, left = 0, left - 1
            aim = _aim(array[at:], left)
        filled += size
    return cuts


def _cell(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS)


def minimax_shards(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (and the text): near-equal bytes, equal texts together.

    Groups of equal texts are ordered by a hash. The atomic sizes of the walk are those
    of its leading 18 bits, each of whole groups; their number is bounded whatever the
    input, so they alone reach the driver. The rows are written by shard to the shared
    folder, in files of bounded rows, and a slot is the file's first slot plus the
    row's place in the file: nothing is sorted, and no group meets in one task.

    The size is the text's UTF-8 bytes plus 8; NULL has none and groups with empty
    texts' hash of its own. Its text_crc32 is that of no bytes, 0. Repeated rows have a
    slot each; NULL ids are kept. An empty table gives no rows. Further columns of
    the input are left out.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_column}`")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        _cell(text).cast("int").alias("cell"),
        *([text.alias("text")] if with_text else []),
    )
    cells = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    cells.sort(key=lambda row: row.cell)
    if not cells:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("cell")
    begins = [cells[at].cell for at in cut_points([row.bytes for row in cells], shards)]
    shard = sum([(F.col("cell") >= begin).cast("int") for begin in begins], F.lit(0))
    # Files of a shard: as many as its rows ask for, so that a large shard has many writers.
    total = sum(row.n for row in cells)
    parts = max(1, math.ceil(total / ROWS_PER_FILE))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    path = scratch_path(spark, "shards")
    placed = rows.withColumn("shard", shard).drop("cell")
    if parts > 1:
        placed = placed.repartition(shards * parts, "shard", salt)
    placed.write.partitionBy("shard").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    written = spark.read.schema(placed.schema).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    files = sorted(
        (row.shard, row.file, row.n) for row in written.groupBy("shard", "file").agg(F.count("*").alias("n")).collect()
    )
    firsts, before = [], {}
    for number, file, count in files:
        firsts.append((file, before.get(number, 0)))
        before[number] = before.get(number, 0) + count
    # One row per written file, each of up to two million rows.
    table = F.broadcast(spark.createDataFrame(firsts, "file string, first long"))
    return written.join(table, "file").withColumn("slot", F.col("first") + F.col("row")).drop("file", "first", "row")
