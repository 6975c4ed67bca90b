"""Context-tree weighting over bytes, trained and applied by block-wise requests.

A byte is eight binary decisions; each has a tree whose branches are the preceding
bytes. A node holds counts of zeros and ones, their Krichevsky-Trofimov estimate, and
the weight by which the tree stops there: half the estimate against half the product of
its children. All of it follows from the counts of byte strings of the full depth plus
the next byte. These are a distributed table that grows with the corpus; texts ask it,
block by block, for the probabilities of the strings they hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import give_back, kept

#: Context bytes; a string of context and next byte fits a long.
DEPTH = 5
END = b"\n"
#: Neighbouring rows that a block is taken from, fewer for long texts, and bytes that are worked on at once.
BLOCK_ROWS, LONG_ROWS, LONG_BYTES = 32_768, 256, 65_536
CHUNK_BYTES, CONDENSE_BYTES = 1_000_000, 2_000_000
#: Distinct strings that a task holds before it hands them on; a block may then come in parts.
HELD_STRINGS = 2_500_000

COUNTS = "block long, gram long, word binary, n long"


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII space with A-Z lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END]


def grams_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each body's byte strings, the next byte lowest and nearer context below farther, and the bodies' lengths.

    Before a body stand ends of earlier ones.
    """
    pad = END * DEPTH
    raw = np.frombuffer(b"".join([pad + body for body in bodies]), np.uint8)
    sizes = np.array([len(body) for body in bodies], np.int64)
    wide = np.zeros(len(raw), np.uint64)
    for back in range(DEPTH + 1):
        wide[back:] |= raw[: len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    real = np.ones(len(raw), bool)
    starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    for n in range(DEPTH):
        real[starts + n] = False
    return wide[real], sizes


def body_of(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens[:-1]) + END


class Held:
    """Distinct strings and words of one block so far, with their counts in training rows."""

    def __init__(self) -> None:
        self.bodies: dict[bool, list[bytes]] = {True: [], False: []}
        self.waiting = 0
        self.words: Counter = Counter()
        self.grams, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def size(self) -> int:
        return len(self.grams) + len(self.words)

    def add(self, tokens: list[bytes], train: bool) -> None:
        if train:
            self.words.update(tokens)
        else:
            for token in tokens:
                self.words.setdefault(token, 0)
        body = body_of(tokens)
        self.bodies[train].append(body)
        self.waiting += len(body)
        if self.waiting > CONDENSE_BYTES:
            self.condense()

    def condense(self) -> None:
        """Fold the bodies at hand into the distinct strings."""
        found = [(self.grams, self.n)]
        for train, own in self.bodies.items():
            if own:
                keys, counts = np.unique(grams_of(own)[0], return_counts=True)
                found.append((keys, counts if train else np.zeros(len(keys), np.int64)))
                own.clear()
        self.grams, place = np.unique(np.concatenate([keys for keys, _ in found]), return_inverse=True)
        counted = np.concatenate([counts for _, counts in found])
        self.n = np.bincount(place, weights=counted, minlength=len(self.grams)).astype(np.int64)
        self.waiting = 0


def count_strings(docs: DataFrame) -> DataFrame:
    """(block, gram or word, n): what each block holds, with its count in training rows, which may be 0."""

    def batch_of(block: int, grams: np.ndarray, words: list[bytes], n: list) -> pa.RecordBatch:
        empty = pa.nulls(len(words), pa.int64())
        gram = pa.concat_arrays([pa.array(grams.view(np.int64)), empty])
        word = pa.concat_arrays([pa.nulls(len(grams), pa.binary()), pa.array(words, pa.binary())])
        count = pa.array(np.concatenate([np.asarray(part, np.int64) for part in n]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(gram), block, np.int64)), gram, word, count], ["block", "gram", "word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Held] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for block, own in state.items():
                own.condense()
                words = sorted(own.words)  # as the strings are: runs in order are cheap to shuffle and to sort
                whole = batch_of(block, own.grams, words, [own.n, [*map(own.words.__getitem__, words)]])
                for at in range(0, len(whole), 100_000):
                    yield whole.slice(at, 100_000)
            state.clear()
            size = 0

        for batch in batches:
            for block, train, text in zip(*(batch.column(name) for name in ("block", "train", "text"))):
                own = state.setdefault(block.as_py(), Held())
                before = own.size()
                own.add(tokens_of(text.as_py()), train.as_py())
                size += own.size() - before
                if size > HELD_STRINGS:
                    yield from flush()
        yield from flush()
        give_back()

    return docs.select("block", "train", "text").mapInArrow(run, COUNTS)


def gathered(counts: DataFrame) -> DataFrame:
    """(gram or word, n, blocks): each string once, with its count in training rows and the blocks that hold it.

    Blocks come in few parts, so adding up before the shuffle would save little; no list is longer than there are blocks.
    """
    blocks = F.array_distinct(F.collect_list("block"))
    return counts.repartition("gram", "word").groupBy("gram", "word").agg(F.sum("n").alias("n"), blocks.alias("blocks"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence."""
    steps = sum(np.log(x + n) for n in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - steps


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of nodes, and the weight of stopping there."""
    total = np.logaddexp(own, children) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


def node_keys(grams: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the eight nodes of each string at a depth: context, and the byte's bits so far behind a one."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    byte = grams & np.uint64(255)
    levels = np.arange(8, dtype=np.uint64)[:, None]
    heads = (np.uint64(1) << levels) | (byte[None] >> (np.uint64(8) - levels))
    return (context[None] << np.uint64(8)) | heads


def bits_of(grams: np.ndarray) -> np.ndarray:
    return ((grams & np.uint64(255))[None] >> (np.uint64(7) - np.arange(8, dtype=np.uint64)[:, None])) & np.uint64(1)


class Nodes:
    """The nodes of one depth."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        self.depth = depth
        self.keys, place = np.unique(node_keys(grams, depth).ravel(), return_inverse=True)
        bits, repeated = bits_of(grams).ravel().astype(float), np.tile(counts.astype(float), 8)
        self.total = np.bincount(place, weights=repeated, minlength=len(self.keys))
        self.ones = np.bincount(place, weights=repeated * bits, minlength=len(self.keys))
        self.log, self.stop = log_kt(self.total - self.ones, self.ones), np.ones(len(self.keys))

    def weigh(self, deeper: Nodes) -> None:
        """Mix with the next depth, whose nodes are already weighed."""
        short = np.uint64((1 << 8 * self.depth) - 1)
        parent = (((deeper.keys >> np.uint64(8)) & short) << np.uint64(8)) | (deeper.keys & np.uint64(255))
        below = np.bincount(np.searchsorted(self.keys, parent), weights=deeper.log, minlength=len(self.keys))
        self.log, self.stop = weighted(self.log, below)

    def mix(self, grams: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of each string's bits here, given those from the depths below (NaN: none)."""
        keys = node_keys(grams, self.depth)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        bits = bits_of(grams).astype(float)
        own = (bits * self.ones[at] + (1 - bits) * (self.total[at] - self.ones[at]) + 0.5) / (self.total[at] + 1)
        both = np.where(np.isnan(deeper), own, self.stop[at] * own + (1 - self.stop[at]) * deeper)
        return np.where(here, both, deeper)


def subtree(grams: np.ndarray, counts: np.ndarray, top: int) -> list[Nodes]:
    """Weighed nodes of the depths from `top` to DEPTH of all contexts given."""
    nodes = [Nodes(grams, counts, depth) for depth in range(top, DEPTH + 1)]
    for upper, deeper in zip(nodes[-2::-1], nodes[:0:-1]):
        upper.weigh(deeper)
    return nodes


class Crown:
    """Depths 0 and 1, at most 257 contexts of 255 nodes: the part that all subtrees share."""

    def __init__(self, rows: pd.DataFrame):
        ones, total, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        at = rows["near"].to_numpy(int), rows["head"].to_numpy(int)
        ones[at], total[at], below[at] = rows["ones"], rows["total"], rows["log"]
        log, self.stop1 = weighted(log_kt(total - ones, ones), below)
        self.ones1, self.total1 = ones, total
        self.ones0, self.total0 = ones.sum(axis=0), total.sum(axis=0)
        log = np.where(total > 0, log, 0.0).sum(axis=0)
        self.stop0 = weighted(log_kt(self.total0 - self.ones0, self.ones0), log)[1]

    def mix(self, grams: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        keys = node_keys(grams, 1)
        near, head = (keys >> np.uint64(8)).astype(int), (keys & np.uint64(255)).astype(int)
        bits = bits_of(grams).astype(float)
        for ones, total, stop in (
            (self.ones1[near, head], self.total1[near, head], self.stop1[near, head]),
            (self.ones0[head], self.total0[head], self.stop0[head]),
        ):
            own = (bits * ones + (1 - bits) * (total - ones) + 0.5) / (total + 1)
            both = np.where(np.isnan(deeper), own, stop * own + (1 - stop) * deeper)
            deeper = np.where(total > 0, both, deeper)
        return np.where(np.isnan(deeper), 0.5, deeper)


def _crown(strings: DataFrame) -> Crown:
    """Sums over the subtrees of all two-byte contexts, of which there are at most 65,536."""

    def roots(rows: pd.DataFrame) -> pd.DataFrame:
        top = subtree(rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(), 2)[0]
        return pd.DataFrame(
            {
                "near": ((top.keys >> np.uint64(8)) & np.uint64(255)).astype(np.int32),
                "head": (top.keys & np.uint64(255)).astype(np.int32),
                "ones": top.ones, "total": top.total, "log": top.log,
            }
        )

    schema = "near int, head int, ones double, total double, log double"
    tops = strings.where("n > 0").groupBy("pair").applyInPandas(roots, schema)
    return Crown(tops.groupBy("near", "head").agg(*[F.sum(c).alias(c) for c in ("ones", "total", "log")]).toPandas())


def string_probabilities(counts: DataFrame) -> DataFrame:
    """(gram, n) to (gram, value): log10 of the next byte's probability after its context.

    Strings with n = 0 are not learnt from, only asked for. A context that was never
    seen has no node; the mix then ends at the deepest that was. A task holds the
    strings of one pair of nearest bytes. The counts are read twice, so they should be stored.
    """
    strings = counts.withColumn("pair", F.shiftright("gram", 8).bitwiseAND(0xFFFF))
    crown = _crown(strings)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        grams, n = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy()
        seen = n > 0
        nodes = subtree(grams[seen], n[seen], 2) if seen.any() else []
        out = []
        for part in np.array_split(grams, max(1, len(grams) // 100_000)):
            p = np.full((8, len(part)), np.nan)
            for level in nodes[::-1]:
                p = level.mix(part, p)
            out.append(np.log10(crown.mix(part, p)).sum(axis=0))
        return pd.DataFrame({"gram": rows["gram"], "value": np.concatenate(out)})

    return strings.groupBy("pair").applyInPandas(answer, "gram long, value double")


class Places:
    """Where numbers lie in a list without repeats: open addressing, many numbers at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        waiting, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        # Multiplication by a large odd number spreads neighbouring numbers.
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, all of which must be there."""
        at = self._first(wanted)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != wanted)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != wanted[wrong]]
        return found


SCORES = (
    "doc_id {id}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double, bits_per_byte double"
)


def score(docs: DataFrame) -> DataFrame:
    """Learn from the rows with `train` and score all of them.

    `docs` has doc_id, text, train (boolean) and block (long), which groups some thousand
    rows, always the same. Per row: doc_id, train, n_tokens, n_known, train_tokens,
    base_score (log10 by add-one word counts), score (log10 by the tree), and
    bits_per_byte, the code length of the lower-cased words with single spaces and an end.

    NULL and empty texts are the end alone. Repeated rows are scored each, and learnt
    from each. Without training rows every bit has probability one half. An empty table
    gives no rows.
    """
    rows = docs.select("doc_id", "text", "train", "block")
    strings = kept(gathered(count_strings(rows)), "ctw-strings")
    grams, words = strings.where("gram IS NOT NULL"), strings.where("gram IS NULL")
    sums = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    total, distinct = int(sums.n or 0), int(sums.v or 0)
    values = string_probabilities(grams.select("gram", "n"))
    block = F.explode("blocks").alias("block")
    asked = grams.select("gram", "blocks").join(values, "gram").select(block, "gram", F.lit(None).cast("binary").alias("word"), "value")
    named = words.select(block, "gram", "word", F.col("n").cast("double").alias("value"))
    answers = asked.unionByName(named)
    id_type = rows.schema["doc_id"].dataType
    schema = SCORES.format(id=id_type.simpleString())

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        is_word = found.column("gram").is_null()
        gram_rows, word_rows = found.filter(pa.compute.invert(is_word)), found.filter(is_word)
        strings = gram_rows.column("gram").to_numpy().view(np.uint64)
        places, logs = Places(strings), gram_rows.column("value").to_numpy()
        counts = dict(zip(word_rows.column("word").to_pylist(), word_rows.column("value").to_numpy()))
        n_tokens, n_known, base, scores, lengths = [], [], [], [], []
        bodies, held = [], 0

        def flush() -> None:
            nonlocal bodies, held
            if bodies:
                grams, sizes = grams_of(bodies)
                at = logs[places.of(grams)]
                scores.append(np.add.reduceat(at, np.cumsum(sizes) - sizes))
                lengths.append(sizes)
            bodies, held = [], 0

        for column in texts.column("text").iterchunks():
            for text in column:
                tokens = tokens_of(text.as_py())
                c = np.array([*map(counts.__getitem__, tokens)])
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                base.append(float(np.log10((c + 1) / (total + distinct + 1)).sum()))
                bodies.append(body_of(tokens))
                held += len(bodies[-1])
                if held > CHUNK_BYTES:
                    flush()
        flush()
        result = np.concatenate(scores)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "train": texts.column("train"),
                "n_tokens": n_tokens,
                "n_known": n_known,
                "train_tokens": np.full(len(result), total),
                "base_score": base,
                "score": result,
                "bits_per_byte": -result / math.log10(2) / np.concatenate(lengths),
            }
        )

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def stored_blocks(scan: DataFrame, *alike: str, text: str = "text", rows: int = BLOCK_ROWS) -> Column:
    """A block number for the rows of a table read from files: neighbouring rows of one file.

    Rows that differ in one of the columns `alike` go apart, as like texts share more strings; so do
    long texts, of which a block has fewer.
    """
    long = F.coalesce(F.octet_length(text) >= LONG_BYTES, F.lit(False))
    size = F.when(long, LONG_ROWS).otherwise(rows)
    return F.xxhash64(scan["_metadata.file_path"], long, F.floor(scan["_metadata.row_index"] / size), *alike)
