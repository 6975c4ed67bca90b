"""Tokens of two tokenizers over the same bytes, and how they line up.

A text is encoded by a byte-level vocabulary (A) and by a sentence-piece model (B), which
puts a space before it; so A reads the text with that space. Both give spans: A counts
characters, B bytes of whole characters. Where several tokens lie within one character,
their own bytes say where each ends.

Neither has a token over the edge of a character that isn't white space and a following
space, nor of a Latin letter and a following mark; so a text falls into units there, and
both end a token at the end of each. Units are aligned once by a worker and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from splitloom.llm.common import kept, make_room, per_worker, texts_of
from splitloom.llm.packing import byte_letters

#: A text's units begin with a space behind something that is not white space, or with a mark behind a letter.
#: A last space stays with what is before it, as the model puts no space before an empty text.
LETTER, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", "[,.;:!?]"
UNITS = re.compile(rf"(?<=\S)(?= (?!\Z))|(?<={LETTER})(?={MARK})")
#: A unit that any mark may follow.
BEFORE_MARK = " a"
#: Units that a worker remembers; the older half goes when it is full. Longer ones are not remembered.
REMEMBERED, LONGEST = 300_000, 100
#: New units that are encoded as one text.
TOGETHER = 2_000
#: How a sentence-piece model writes a space and a byte.
PIECE_SPACE, PIECE_BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: Documents that are aligned or looked up at once.
DOCUMENTS = 100


#: What the two vocabularies make of a unit: its numbers of tokens, its groups and its links.
Unit = tuple[int, int, str, bytes]


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from the byte ends of their spans, and how many bytes each token has.

    Where a span ends behind what its token's own bytes reach, or before, the token is part of a
    character that it shares with its neighbours, and its own bytes decide.
    """
    own = np.cumsum(sizes)
    return np.where(coarse == own, coarse, own)


def named(ids: np.ndarray, cuts: np.ndarray, inner: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id as text with what stands behind it, which differs at the last of a group; and its group's number."""
    group = np.zeros(len(ids), np.int64)
    group[cuts[:-1] + 1] = 1
    found = inner[ids]
    found[cuts] = last[ids[cuts]]
    return found, np.cumsum(group)


def pair_code(tokenizer, pieces) -> tuple[int, str]:
    """A pair of ids as one number: A's times the number of pieces, plus B's; and the type that holds it."""
    base = pieces.get_piece_size()
    return base, "<u4" if tokenizer.get_vocab_size() * base <= 1 << 32 else "<u8"


def opened(byte_level: str, piece_model: str) -> tuple:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=piece_model)


class Aligner:
    """Both tokenizers, and units already aligned."""

    def __init__(self, byte_level: str, piece_model: str):
        self.a, self.b = opened(byte_level, piece_model)
        self.a.encode_special_tokens = True
        self.base, self.pair_type = pair_code(self.a, self.b)
        back = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.a_bytes = {n: bytes(map(back.get, t)) for t, n in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = {}
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            byte = PIECE_BYTE.fullmatch(piece)
            self.b_bytes[number] = bytes.fromhex(byte[1]) if byte else piece.replace(PIECE_SPACE, " ").encode()
            if PIECE_SPACE in piece.lstrip(PIECE_SPACE) or re.search(LETTER + MARK, piece):
                raise ValueError(f"a piece reaches over the edge of a unit: {piece!r}")
        sizes = (max(self.a_bytes) + 1, max(self.b_bytes) + 1)
        self.a_sizes, self.b_sizes = (
            np.array([len(table.get(n, b"")) for n in range(size)]) for table, size in zip((self.a_bytes, self.b_bytes), sizes)
        )
        self.names = {end: np.array([f"{n}{end}" for n in range(max(sizes))], object) for end in ",|;"}
        self.lengths = np.array([len(str(n)) + 1 for n in range(max(sizes))])
        self.known: dict[str, Unit | None] = {}

    def spans_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends from character offsets."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, ends = np.array(found.ids, np.int64), np.array([end for _, end in found.offsets], np.int64)
        if not text.isascii():
            chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
            bytes_each = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            ends = refined(np.concatenate([[0], np.cumsum(bytes_each)])[ends], self.a_sizes[ids])
        return ids, ends

    def spans_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends from spans of the proto, behind the space that the model puts first."""
        pieces = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        ids = np.array([piece.id for piece in pieces], np.int64)
        ends = np.array([piece.end for piece in pieces], np.int64) + 1
        return ids, ends if text.isascii() else refined(ends, self.b_sizes[ids])

    def together(self, units: list[str]) -> list[Unit] | None:
        """Units encoded side by side; None if a vocabulary does not give them back byte for byte."""
        text = "".join(units)
        raw = text.encode()
        a, a_ends = self.spans_a(text)
        b, b_ends = self.spans_b(text)
        whole = [b"".join([table[n] for n in ids.tolist()]) for table, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        if whole != [raw, raw]:
            return None
        # No token is empty, so at each shared end there is one pair of tokens.
        shared, in_a, in_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        links = (a[in_a] * self.base + b[in_b]).astype(self.pair_type)
        a_names, a_groups = named(a, in_a, self.names[","], self.names["|"])
        b_names, b_groups = named(b, in_b, self.names[","], self.names[";"])
        order = np.argsort(np.concatenate([2 * a_groups, 2 * b_groups + 1]), kind="stable")
        groups = "".join(np.concatenate([a_names, b_names])[order].tolist())
        # Both end a token at the end of each unit, so everything falls into units there.
        ends = np.cumsum([len(unit) for unit in units] if text.isascii() else [len(unit.encode()) for unit in units])
        cuts = [np.searchsorted(places, ends, side="right") for places in (a_ends, b_ends, shared)]
        letters = sum(np.concatenate([[0], np.cumsum(self.lengths[ids])])[cut] for ids, cut in ((a, cuts[0]), (b, cuts[1])))
        out, before = [], (0, 0, 0, 0)
        for here in zip(*[cut.tolist() for cut in cuts], letters.tolist()):
            out.append(
                (here[0] - before[0], here[1] - before[1], groups[before[3] : here[3] - 1], links[before[2] : here[2]].tobytes())
            )
            before = here
        return out

    def align(self, units: list[str]) -> list[Unit | None]:
        """What each unit is among others; None if a vocabulary doesn't give it back byte for byte."""
        found: dict[str, Unit | None] = {}

        def learn(some: list[str]) -> None:
            chain = [part for unit in some for part in ((unit,) if unit[0] == " " else (BEFORE_MARK, unit))]
            found.update(zip(chain, self.together(chain) or []))

        # A unit at the end of a text may end with white space; then the next space would be no edge.
        inner = [unit for unit in units if not unit[-1].isspace()]
        for at in range(0, len(inner), TOGETHER):
            learn(inner[at : at + TOGETHER])
        for unit in units:
            if unit not in found:
                learn([unit])
        return [found.get(unit) for unit in units]

    def documents(self, texts: list[str | None]) -> list[list[Unit]]:
        """The aligned units of each whole text; none if it has no tokens."""
        cut = [UNITS.split(" " + text) if text else [] for text in texts]
        new = list({unit for units in cut for unit in units if unit not in self.known})
        self.known.update(zip(new, self.align(new)))
        out = []
        for units in cut:
            found = [*map(self.known.__getitem__, units)]
            out.append([] if None in found else found)
        for unit in new:
            if len(unit) > LONGEST:
                del self.known[unit]
        make_room(self.known, REMEMBERED)
        return out


def aligner(byte_level: str, piece_model: str) -> Aligner:
    return per_worker(f"aligner {byte_level} {piece_model}", lambda: Aligner(byte_level, piece_model))


def align(
    docs: DataFrame, byte_level: str, piece_model: str, id_column: str = "doc_id", text_column: str = "text", with_groups: bool = True
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups or groups_sha256, links) of each text.

    `groups` has the ids between the places where both vocabularies end a token, as
    `a1,a2|b1;a3|b2,b3`; without them there is their digest, '' for none. `links` has the
    pairs of tokens that end together, as `pair_code` has them, little-endian.

    NULL and empty texts, and texts that a vocabulary does not give back byte for byte, have no
    tokens. A NULL id stays NULL, repeated rows stay repeated, an empty table gives no rows, further
    columns are left out. Texts are aligned whole, whatever their length.
    """
    texts = texts_of(docs, id_column, text_column)
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, piece_model)
        for batch in batches:
            for at in range(0, len(batch), DOCUMENTS):
                some = batch.slice(at, DOCUMENTS)
                found = own.documents(some.column("text").to_pylist())
                # Per document: both numbers, groups and links of its units.
                parts = [[*zip(*units)] or [(), (), (), ()] for units in found]
                groups = [";".join(part[2]) for part in parts]
                columns = {
                    "doc_id": some.column("doc_id").cast(id_type),
                    "n_a": pa.array([sum(part[0]) for part in parts], pa.int64()),
                    "n_b": pa.array([sum(part[1]) for part in parts], pa.int64()),
                    "n_groups": pa.array([one.count("|") for one in groups], pa.int64()),
                }
                if with_groups:
                    columns["groups"] = pa.array(groups, pa.string())
                else:
                    columns["groups_sha256"] = pa.array([sha256(one.encode()).hexdigest() if one else "" for one in groups], pa.string())
                columns["links"] = pa.array([b"".join(part[3]) for part in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    shown = "groups" if with_groups else "groups_sha256"
    id_name = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_name}, n_a long, n_b long, n_groups long, {shown} string, links binary")


def link_counts(aligned: DataFrame, pair_type: str) -> DataFrame:
    """(pair, count) over all documents: how many links hold the pair of ids.

    Each task counts before the shuffle. Of tokens that end together one's bytes end with the
    other's, so the number of pairs is bounded by the vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 10 * DOCUMENTS):
                links = b"".join(batch.column("links").slice(at, 10 * DOCUMENTS).to_pylist())
                own, n = np.unique(np.frombuffer(links, pair_type), return_counts=True)
                pairs, place = np.unique(np.concatenate([pairs, own.astype(np.int64)]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "n": pa.array(counts, pa.int64())})

    counted = aligned.select("links").mapInArrow(run, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("count"))


SCORED = (
    "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def score(docs: DataFrame, byte_level: str, piece_model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, and how the links stand among those of all documents.

    `n_best` counts the links whose pair is the most frequent of its B id, ties included;
    `count_sum` adds up the counts of all links. Odd rows are as in `align`.

    Aligned documents are written out; the counts of pairs, which the vocabularies bound,
    go to every task.
    """
    aligned = kept(align(docs, byte_level, piece_model, id_column, text_column, with_groups=False), "aligned")
    base, pair_type = pair_code(*opened(byte_level, piece_model))
    counts = link_counts(aligned, pair_type)
    best = F.max("count").over(Window.partitionBy(F.col("pair") % base))
    table = counts.withColumn("best", F.col("count") == best).orderBy("pair").toArrow()
    pairs, n = (table.column(c).to_numpy() for c in ("pair", "count"))
    pairs = pairs.astype(pair_type)
    is_best = table.column("best").to_numpy().astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((pairs, n, is_best))
    id_type = to_arrow_type(aligned.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, is_best = sent.value
        for whole in batches:
            for at in range(0, len(whole), DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                links = [np.searchsorted(pairs, np.frombuffer(one, pair_type)) for one in batch.column("links").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").cast(id_type),
                        **{name: batch.column(name) for name in ("n_a", "n_b", "n_groups")},
                        "n_links": [len(one) for one in links],
                        "n_best": [int(is_best[one].sum()) for one in links],
                        "count_sum": [int(n[one].sum()) for one in links],
                        "groups_sha256": batch.column("groups_sha256"),
                    }
                )

    return aligned.mapInArrow(run, SCORED.format(id=aligned.schema["doc_id"].dataType.simpleString()))

