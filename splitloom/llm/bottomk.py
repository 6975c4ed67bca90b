"""Bottom-k sketches of word shingles, with built-in functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitloom.llm.common import let, texts_of, words_of

WORDS, K = 5, 256


def shingle_hashes(text: Column, words_each: int = WORDS) -> Column:
    """A hash for each run of `words_each` lower-cased words; fewer words hash whole, none give none."""

    def runs(hashes: Column) -> Column:
        count = F.size(hashes) - (words_each - 1)
        each = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(hashes, i + n) for n in range(words_each)])
        )
        return F.when(count >= 1, each).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(F.transform(words_of(F.lower(text)), lambda word: F.xxhash64(word)), runs)


def sketch(text: Column, k: int = K, words_each: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words_each))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sketched sets; exact where neither sketch is full.

    Two empty sketches have 1, an empty and a filled one 0.
    """
    whole = (F.size(a) < k) & (F.size(b) < k)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, F.when(whole, F.lit(2 * k)).otherwise(F.lit(k)))

    def share(pair: Column) -> Column:
        low, both = pair["low"], pair["both"]
        return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(low, both)).cast("double") / F.size(low)
        )

    return let(F.struct(union.alias("low"), F.array_intersect(a, b).alias("both")), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = (F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    like = resemblance(a, b, k)
    shared = like / (like + 1) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def merge_sketches(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key for the union of its parts: (key, sketch).

    Each task first keeps k hashes per key, so a hot key sends few rows. NULL sketches
    add nothing; a key without any hash has an empty sketch.
    """
    hashes = parts.select(key, F.explode_outer(column).alias("hash")).distinct()
    order = Window.partitionBy(key).orderBy(F.col("hash").asc_nulls_last())
    lowest = hashes.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    return lowest.groupBy(key).agg(F.sort_array(F.array_agg("hash")).alias(column))


def digest(a: Column) -> Column:
    """A sketch as text: its hashes of eight bytes each, in base 64."""
    whole = F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(whole, ""))), "\r\n", "")


def ranged(texts: DataFrame, buckets: int) -> DataFrame:
    """Add `order`, a hash of the text, and `bucket`, which ascends by descending doc_id and then by `order`.

    An id that has the rows of several buckets, or NULL ids that do, get as many buckets, by ranges of the hash.
    """
    doc_id = F.col("doc_id")
    shares = [n / buckets for n in range(1, buckets)]
    seen = texts.agg(
        F.percentile_approx("doc_id", shares, 10_000).alias("bounds"), F.count("*").alias("rows"),
        F.count_if(doc_id.isNull()).alias("missing"),
    ).first()
    repeats = Counter(seen.bounds or [])
    bounds = sorted(repeats)
    base = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: doc_id < b)) if bounds else F.lit(0)
    parts = F.lit(0)
    for bound, times in repeats.items():
        if times > 1:
            parts = F.when(doc_id == bound, F.lit(times)).otherwise(parts)
    missing = max(1, buckets * seen.missing // max(seen.rows, 1))
    parts = F.when(doc_id.isNull(), F.lit(missing)).otherwise(parts)
    place = F.least(F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * parts), parts - 1)
    # Greater ids of the range of a frequent id come before all of its parts.
    part = F.when(parts > 0, place + 1).otherwise(F.lit(0))
    low = F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(base)
    return texts.withColumn("order", F.xxhash64("text")).withColumn("bucket", (low * (buckets + 2) + part).cast("long"))


def with_next(texts: DataFrame, buckets: int, add) -> DataFrame:
    """Rows (doc_id, text) with the next row by descending doc_id as `next`; the last one's next is the first.

    Rows go to ranges of ids; the first row of each range also goes to the range
    before, so that no range needs another. `add` gives the columns that rows need
    of each other, computed after the shuffle. Ids are numbers. Rows of one id are ordered by a hash of
    their text; NULL ids come last. Rows of a frequent id are dealt over ranges of that hash; only rows of
    equal id and text stay together.
    """
    doc_id = F.col("doc_id")
    keyed = ranged(texts, buckets).withColumn("guard", F.lit(False))
    order = F.struct(F.coalesce(-doc_id, F.lit(0)).alias("id"), "order")
    firsts = keyed.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text", "order"), order).alias("row"))
    filled = sorted(row.bucket for row in keyed.select("bucket").distinct().collect())
    before = {b: filled[n - 1] for n, b in enumerate(filled)}
    place = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(p)) for b, p in before.items()], F.lit(0))
    guards = firsts.select("row.doc_id", "row.text", place.alias("bucket"), "row.order", F.lit(True).alias("guard"))
    dealt = keyed.unionByName(guards.select(*keyed.columns)).repartition("bucket")
    # The range's order must not depend on the wrapped-round first row.
    ranked = Window.partitionBy("bucket").orderBy("guard", doc_id.desc_nulls_last(), "order")
    ready = dealt.withColumns(add)
    following = F.lead(F.struct("text", *add)).over(ranked)
    return ready.withColumn("next", following).where("NOT guard").drop("bucket", "order", "guard")


def fingerprint_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, buckets: int | None = None
) -> DataFrame:
    """Sketches of every text and of its edited text: the last third replaced from the next document.

    Per row: doc_id, n_chars, edited (text), sketch, edited_sketch, next_sketch. NULL
    texts are empty and have empty sketches. Repeated rows follow each other. A single
    row is its own next. An empty table gives no rows. Further columns of the input are
    left out. No row is shuffled more than once.
    """
    texts = texts_of(docs, id_column, text_column)
    if buckets is None:
        buckets = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(texts, max(2, buckets), {"sketch": sketch(F.col("text"), k)})
    third = F.expr("length(text) div 3")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.length("text") - third).cast("int")),
        F.substring("next.text", F.lit(1), third.cast("int")),
    )
    edits = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    return edits.withColumn("edited_sketch", sketch(F.col("edited"), k))
