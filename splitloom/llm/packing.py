"""Packing of token ids into fixed sequences, balanced by the cost of attention."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from splitloom.llm.common import make_room, per_worker, texts_of

SEQUENCE = 2048
END_ID = 1
#: Tokens that are packed together; a task holds one such bucket at a time.
BUCKET_TOKENS = 4_000_000
#: Cost of a document of n tokens in a sequence: LINEAR * n + QUADRATIC * n * n.
#: Linear work of a layer goes with 12 times its squared width, attention with twice
#: its width, which gives 6 * width to 1; the width here is 768.
LINEAR, QUADRATIC = 6 * 768.0, 1.0
#: Distinct runs of plain text, and other space-separated pieces, whose ids a worker remembers. It lives on in other
#: stages with what it remembers, until another step needs the room: 48 MB at most with runs of ten letters, 68 with 500,000 of them; a run not remembered costs 5 microseconds.
REMEMBERED_RUNS, REMEMBERED = 300_000, 100_000
#: Pieces that are given back at once.
PIECES_AT_ONCE = 1_000
#: Special tokens of the vocabulary, which may hold for whole texts only.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: Chunks that hold only Latin-1 without apostrophe and wider spaces, and how they fall into
#: runs: letters, single digits, and the rest, as the vocabulary's pattern has it.
PLAIN = re.compile("[!-&(-~\u00a1-\u00ff]+")
RUNS = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^a-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+")
#: The same over whole texts, whose white space is left out; texts of such chunks alone, and the chunks that are not plain.
SPACES = " \t-\r"
TEXT_RUNS = re.compile(RUNS.pattern.replace("[^a-z", f"[^{SPACES}a-z"))
PLAIN_TEXT = re.compile(f"[{SPACES}{PLAIN.pattern[1:-2]}]*+")
HARD = re.compile(f"(?<![^{SPACES}])({PLAIN.pattern[:-1]}*+[^{SPACES}{PLAIN.pattern[1:-2]}][^{SPACES}]*+)")

PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, ids array<int>"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, then from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(byte) if byte in own else chr(next(rest)) for byte in range(256)]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of whole texts as uint32.

    The vocabulary's pre-tokenizer never joins over ASCII space. Latin-1 text without
    apostrophe is taken apart here by the same rules (normal form and lower case are plain
    there); each new run asks the vocabulary's model once and is remembered. Other chunks between spaces go
    through the whole tokenizer once, as do texts that hold a special token.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, "".join(byte_letters())
    chunks: dict[str, bytes] = {}
    runs: dict[str, bytes] = {}

    def of_run(run: str) -> bytes:
        # ASCII letters stand for themselves.
        word = run if run.isascii() else run.encode().decode("latin-1").translate(letters)
        return pack_ids([token.id for token in model.tokenize(word)])

    def learn_runs(new: set[str]) -> dict[str, bytes]:
        return {run: of_run(run) for run in new}

    def learn_chunks(new: set[str]) -> dict[str, bytes]:
        encoded = tokenizer.encode_batch_fast([*new], add_special_tokens=False)
        return {chunk: pack_ids(one.ids) for chunk, one in zip(new, encoded)}

    def ids_of(known: dict[str, bytes], size: int, learn: Callable[[set[str]], dict[str, bytes]], pieces: list[str]) -> list[bytes]:
        found = [*map(known.get, pieces)]
        if None in found:
            missing = [n for n, ids in enumerate(found) if ids is None]
            make_room(known, size)
            known.update(learn({pieces[n] for n in missing}))
            for n in missing:
                found[n] = known[pieces[n]]
        return found

    def plain_ids(text: str) -> bytes:
        return b"".join(ids_of(runs, REMEMBERED_RUNS, learn_runs, TEXT_RUNS.findall(text.lower())))

    def encode(text: str) -> np.ndarray:
        if "<|" in text and any(token in text for token in SPECIAL):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if PLAIN_TEXT.fullmatch(text):
            return np.frombuffer(plain_ids(text), "<u4")
        # Every second part is a chunk that is not plain.
        parts = HARD.split(text)
        hard = ids_of(chunks, REMEMBERED, learn_chunks, parts[1::2])
        found = [plain_ids(parts[0])]
        for chunk, part in zip(hard, parts[2::2]):
            found += (chunk, plain_ids(part))
        return np.frombuffer(b"".join(found), "<u4")

    return encode


@dataclass
class Piece:
    item: int
    start: int
    length: int
    sequence: int
    offset: int


def balanced(lengths: list[int], room: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[Piece]:
    """Place items, each cut into at most `room` tokens, into as few sequences as their sum needs.

    Full cuts take a sequence of their own. The rest goes in descending order of
    length to the cheapest sequence that still has room for it; ties go to the lower
    index. What fits nowhere whole fills the free places, cheapest first.
    """
    pieces, rests, used = [], [], 0
    for item, length in enumerate(lengths):
        full, rest = divmod(length, room)
        for n in range(full):
            pieces.append(Piece(item, n * room, room, used, 0))
            used += 1
        if rest:
            rests.append((rest, item, full * room))
    count = -(-sum(rest for rest, _, _ in rests) // room)
    free = np.full(count, room, np.int64)
    cost = np.zeros(count)
    late = []

    def put(at: int, item: int, start: int, length: int) -> None:
        pieces.append(Piece(item, start, length, used + at, int(room - free[at])))
        free[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for rest, item, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        at = int(np.argmin(np.where(free >= rest, cost, np.inf)))
        if free[at] >= rest:
            put(at, item, start, rest)
        else:
            late.append((rest, item, start))
    for rest, item, start in late:
        while rest:
            at = int(np.argmin(np.where(free > 0, cost, np.inf)))
            length = int(min(rest, free[at]))
            put(at, item, start, length)
            start, rest = start + length, rest - length
    return pieces


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    room: int = SEQUENCE,
    bucket_tokens: int = BUCKET_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it lies in its document and its sequence, and its ids if wanted.

    Each task packs what it reads, a bucket of tokens at a time, so nothing is
    shuffled and no key can be hot. A bucket leaves at most one sequence's worth of
    room free. A sequence_id holds the task's number in its upper bits, so that a task
    that runs again gives the same rows.

    NULL and empty texts are the end id alone. Repeated rows are packed each. A NULL
    id stays NULL. A text of any length is cut. An empty table gives no rows. Further
    columns of the input are left out.
    """
    texts = texts_of(docs, id_column, text_column)
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)
    schema = PIECES.format(id=texts.schema["doc_id"].dataType.simpleString())
    if not with_ids:
        schema = schema.removesuffix(", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(f"encoder {vocabulary}", lambda: encoder(vocabulary))
        first = TaskContext.get().partitionId() << 32
        ids, names, total = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, ids, names, total
            placed = balanced([len(one) for one in ids], room)
            for some in range(0, len(placed), PIECES_AT_ONCE):
                part = placed[some : some + PIECES_AT_ONCE]
                cuts = [ids[p.item][p.start : p.start + p.length] for p in part]
                columns = {
                    "doc_id": pa.array([names[p.item] for p in part], id_type),
                    "start": [p.start for p in part],
                    "length": [p.length for p in part],
                    "ids_crc32": [zlib.crc32(cut.tobytes()) for cut in cuts],
                    "doc_tokens": [len(ids[p.item]) for p in part],
                    "sequence_id": [first + p.sequence for p in part],
                    "offset": [p.offset for p in part],
                }
                if with_ids:
                    ends = np.cumsum([0, *map(len, cuts)], dtype=np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(ends, np.concatenate(cuts).astype(np.int32, copy=False))
                yield pa.RecordBatch.from_pydict(columns)
            first += 1 + max((p.sequence for p in placed), default=-1)
            ids, names, total = [], [], 0

        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                names.append(name.as_py())
                ids.append(np.append(encode(text.as_py()), np.array([END_ID], "<u4")))
                total += len(ids[-1])
                if total >= bucket_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    return texts.mapInArrow(run, schema)
