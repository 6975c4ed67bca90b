"""SimHash fingerprints, and links between near ones by hashing of Hamming balls.

Two fingerprints at distance d <= 2r have a word in the middle, at most r bits from
either. So every distinct fingerprint emits all words within r bits, equal words meet,
and who meets is linked. The shuffle key is the leading bits of such a word: a
fingerprint is sent once to each cell that holds any of its variants, and the cell
spells out the rest of them. That is the same set of variants with far fewer rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import clear_worker, give_back, kept, texts_of
from splitloom.llm.components import component_roots

BITS = 64
SEED = 42
#: Hashes that are gathered before their bits are counted, and whose bits are spelt out at once.
FLUSH, COUNTED_AT_ONCE = 32_000, 8_000
#: Variants that a cell sorts at once.
SORT_AT_ONCE = 2_000_000


def shingle_hashes(text: str, words_each: int) -> list[int]:
    """XXH64 of every shingle of lower-cased (A-Z only) words split at ASCII space."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda total, size: total + size + 1))
    starts = [0, *(end + 1 for end in ends)]
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :])]


def majority_bits(hashes: Sequence[int], sizes: list[int]) -> np.ndarray:
    """One word per run of hashes: the bits that over half of the run have set.

    Bits take 64 bytes a hash and more, so they are counted block by block; a run may span blocks.
    """
    out = np.zeros(len(sizes), np.uint64)
    runs = np.asarray(sizes)
    full = np.flatnonzero(runs)
    if len(full):
        words = np.asarray(hashes, np.uint64)
        ends = np.cumsum(runs[full])
        starts = ends - runs[full]
        counts = np.zeros((len(full), BITS), np.int64)
        for low in range(0, len(words), COUNTED_AT_ONCE):
            block = words[low : low + COUNTED_AT_ONCE]
            some = slice(np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(block)))
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[some] += np.add.reduceat(bits, np.maximum(starts[some] - low, 0), axis=0, dtype=np.int32)
        bits = 2 * counts > runs[full][:, None]
        out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_column(text: Column, words_each: int = 4) -> Column:
    """The fingerprint of whole texts as a long; no words give zero."""

    def words(texts: pa.Array) -> pa.Array:
        done, hashes, sizes = [], array("Q"), []
        for value in texts:
            own = shingle_hashes(value.as_py() or "", words_each)
            hashes.extend(own)
            sizes.append(len(own))
            if len(hashes) >= FLUSH:
                done.append(majority_bits(hashes, sizes))
                hashes, sizes = array("Q"), []
        done.append(majority_bits(hashes, sizes))
        return pa.array(np.concatenate(done).view(np.int64))

    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        clear_worker()
        yield from map(words, batches)
        give_back()

    return fingerprint(text)


def flips(bits: int, most: int) -> list[int]:
    """All masks of at most so many of the lowest bits."""
    return [sum(1 << i for i in pick) for n in range(most + 1) for pick in combinations(range(bits), n)]


def signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def _stars(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where variants are equal, link each owner to the smallest owner."""
    order = np.lexsort((owners, keys)) if len(keys) < 1000 else np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    least = np.minimum.reduceat(owners, starts)[run]
    linked = owners != least
    return least[linked], owners[linked]


def cell_links(words: np.ndarray, cell: int, prefix: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints that have a variant in this cell.

    `words` are distinct and sorted. The variants are sorted in slices of their low
    bits, so that memory stays bounded however many fingerprints a cell has.
    """
    low = BITS - prefix
    inside = words & np.uint64((1 << low) - 1)
    spent = np.bitwise_count((words >> np.uint64(low)) ^ np.uint64(cell))
    masks = [np.array(flips(low, radius - n), np.uint64) for n in range(radius + 1)]
    total = sum(int((spent == n).sum()) * len(masks[n]) for n in range(radius + 1))
    slices = 1 << max(0, (total // SORT_AT_ONCE).bit_length())
    shift = np.uint64(low - (slices.bit_length() - 1))
    left, right = [], []
    for part in range(slices):
        keys, owners = [], []
        for n in range(radius + 1):
            at = np.flatnonzero(spent == n)
            for some in np.array_split(at, max(1, len(at) * len(masks[n]) // SORT_AT_ONCE)):
                variants = (inside[some][:, None] ^ masks[n]).ravel()
                whose = np.repeat(some.astype(np.int32), len(masks[n]))
                if slices > 1:
                    here = (variants >> shift) == np.uint64(part)
                    variants, whose = variants[here], whose[here]
                keys.append(variants)
                owners.append(whose)
        keys = np.concatenate(keys)
        if len(keys):
            a, b = _stars(keys, np.concatenate(owners))
            left.append(a)
            right.append(b)
    if not left:
        return words[:0], words[:0]
    pairs = np.unique(np.concatenate(left).astype(np.int64) << np.int64(32) | np.concatenate(right).astype(np.int64))
    return words[pairs >> np.int64(32)], words[pairs & np.int64(0xFFFFFFFF)]


def near_links(words: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) to verified links (a, b): a spanning set of all pairs at `max_bits` or less.

    All owners of one variant lie within the limit of each other, so a star to the
    smallest of them loses no link between components. `max_bits` is even or is
    rounded up for the search; the distance check then removes what is too far,
    for which odd limits emit all pairs of a variant only through their stars'
    centres; so odd limits are rejected.
    """
    if max_bits % 2 or not 0 < max_bits <= 8:
        raise ValueError("max_bits must be 2, 4, 6 or 8")
    radius = max_bits // 2
    count = words.count()
    # Cells grow with the fingerprints, so that a cell's share stays the same.
    prefix = min(24, max(4, (count // 64).bit_length()))
    masks = F.array(*[F.lit(mask).cast("long") for mask in flips(prefix, radius)])
    low = BITS - prefix
    cells = words.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.shiftrightunsigned("fp", low)))).alias("cell"))

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64))
        a, b = cell_links(own, int(key[0]), prefix, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = cells.groupBy("cell").applyInPandas(link, "a long, b long").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def link_classes(fingerprints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, root) of every distinct fingerprint; one root per connected class."""
    words = fingerprints.select("fp").distinct()
    roots = component_roots(near_links(words, max_bits))
    return words.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = 4, max_bits: int = 4
) -> DataFrame:
    """Per row: doc_id, fp (long), fingerprint (16 hex digits), component_id (least id of its class).

    NULL and empty texts have fingerprint zero and link like others. A NULL id is
    never the least, unless the class has no other. Repeated rows stay, each with the
    class. An empty table gives no rows. Further columns of the input are left out.
    """
    texts = texts_of(docs, id_column, text_column)
    marked = kept(texts.select("doc_id", fingerprint_column(F.col("text"), words_each).alias("fp")), "simhash")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = kept(least.join(link_classes(marked, max_bits), "fp"), "simhash-classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_class(docs: DataFrame, words_each: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of `docs` with one of each class of near duplicates: the least doc_id, its first row."""
    columns = docs.columns
    marked = kept(docs.withColumn("__simhash_fp", fingerprint_column(F.coalesce("text", F.lit("")), words_each)), "simhash-docs")
    rows = marked.select(
        F.col("__simhash_fp").alias("fp"),
        F.struct(
            F.col("doc_id").isNull().alias("none"),
            "doc_id",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("place"),
    )
    least = rows.groupBy("fp").agg(F.min("place").alias("place"))
    classes = least.join(link_classes(rows, max_bits), "fp")
    chosen = classes.groupBy("root").agg(F.min("place").alias("place"))
    chosen = chosen.select(F.col("place.file").alias("__simhash_file"), F.col("place.row").alias("__simhash_row"))
    placed = marked.select("*", F.col("_metadata.file_path").alias("__simhash_file"), F.col("_metadata.row_index").alias("__simhash_row"))
    return placed.join(chosen, ["__simhash_file", "__simhash_row"], "left_semi").select(*[f"`{c}`" for c in columns])
