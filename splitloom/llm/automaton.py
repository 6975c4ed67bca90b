"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges produce. It starts with
one state in which every symbol loops. Each merge of a and b, in order, is a gadget: the
arc of a leads to a copy of its state that lacks the arc of b, and wherever a may follow,
the new token ab may, too, leading to where a and then b led.

An arc's state follows from its token alone, so that a table of tokens holds all arcs, and a
state is its original less one banned token. A ban holds for what is later built with the
banned token in front. So each state's arcs are a set of bans, and nothing of the size of
tokens by tokens is stored.

Of each string just one token sequence is accepted, and so of each prefix of a word: every
place in a word that the arcs can reach has one state, and a place that leads nowhere need not
be reached twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from splitloom.llm.common import make_room, per_worker, texts_of
from splitloom.llm.packing import PLAIN, RUNS, SPECIAL, byte_letters

#: Chunks between spaces, and words, that a worker remembers; the older half goes when it is full.
REMEMBERED = 300_000
#: Transitions that are remembered as answered.
ARCS = 1_000_000
#: A letter at the end of a word is a symbol of its own: the letter this much further on.
AT_END = 0x1000


class Automaton:
    """Compiled merges. Tokens are numbers of the vocabulary; strings of symbols are its keys."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.word_end = word_end
        self.ids = {self.symbols(token): number for token, number in vocabulary.items()}
        size = max(vocabulary.values(), default=-1) + 1
        # By token: the token it begins with, the merge that made it (0: a symbol), the state its arc leads to.
        self.front, self.made, self.target = [-1] * size, [0] * size, [0] * size
        # By state: the state it was copied from, the token it bans, the merge that did so.
        self.copied, self.banned, self.since = [-1], [-1], [0]
        self._allowed: dict[int, bool] = {}
        # Tokens that some sequence has: symbols, and what a gadget has made.
        self.found = set(vocabulary.values()) - {vocabulary[a + b] for a, b in merges}
        for number, (a, b) in enumerate(merges, 1):
            self._gadget(vocabulary[a], vocabulary[b], vocabulary[a + b], number)
        arcs = {token: number for token, number in self.ids.items() if number in self.found}
        self.prefixes = {token[:n]: -1 for token in arcs for n in range(1, len(token))} | arcs

    def symbols(self, token: str) -> str:
        """A token as a string with one character per symbol."""
        if self.word_end and token.endswith(self.word_end) and len(token) > len(self.word_end):
            bare = token[: -len(self.word_end)]
            return bare[:-1] + chr(ord(bare[-1]) + AT_END)
        return token

    def _gadget(self, a: int, b: int, ab: int, number: int) -> None:
        before = self.target[a]
        if a not in self.found or not self.follows(before, b):
            return  # no accepted sequence has a and b side by side
        self.found.add(ab)
        self.front[ab], self.made[ab] = a, number
        self.target[ab] = before if a == b else self.target[b]
        self.copied.append(before)
        self.banned.append(b)
        self.since.append(number)
        self.target[a] = len(self.copied) - 1

    def bans(self, state: int) -> Iterator[tuple[int, int]]:
        while state:
            yield self.banned[state], self.since[state]
            state = self.copied[state]

    def follows(self, state: int, token: int) -> bool:
        """Is there an arc of the token? Not if it, or a token it was built on while banned, is banned."""
        if token not in self.found:
            return False
        heads = {token: 1 << 62}
        while token >= 0:
            made, front = self.made[token], self.front[token]
            if front >= 0:
                heads[front] = made
            token = front
        # A head is banned for the tokens built on it from the ban on; the token itself from any time.
        return not any(since <= heads.get(token, -1) for token, since in self.bans(state))

    def arc(self, state: int, token: int) -> bool:
        """`follows`, remembered: one entry of the table of transitions."""
        key = state << 20 | token
        known = self._allowed.get(key)
        if known is None:
            make_room(self._allowed, ARCS)
            known = self._allowed[key] = self.follows(state, token)
        return known

    def encode(self, word: str) -> list[int]:
        """Token ids of a word of base symbols, the last of which is at its end if the vocabulary knows ends."""
        if self.word_end:
            word = word[:-1] + chr(ord(word[-1]) + AT_END)
        size, at, state, out = len(word), 0, 0, []
        prefixes, allowed, arc, target = self.prefixes, self._allowed, self.arc, self.target
        # The arcs not tried yet at each token so far; places that lead nowhere. A place has one state.
        untried: list[tuple[int, int, list[int]]] = []
        dead: set[int] = set()
        while at < size:
            arcs = []
            for end in range(at + 1, size + 1):
                token = prefixes.get(word[at:end])
                if token is None:
                    break
                if token >= 0:
                    arcs.append(end << 20 | token)
            while True:
                # The longest arc is tried first, as it is the right one nearly always.
                while arcs:
                    end, token = divmod(arcs.pop(), 1 << 20)
                    if end not in dead:
                        known = allowed.get(state << 20 | token)
                        if known or (known is None and arc(state, token)):
                            break
                else:
                    dead.add(at)
                    at, state, arcs = untried.pop()
                    out.pop()
                    continue
                break
            untried.append((at, state, arcs))
            out.append(token)
            at, state = end, target[token]
        return out


class Codec:
    """Ids of whole texts by an automaton, and their text again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a vocabulary of plain merges is needed")
        pairs = [tuple(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        self.automaton = Automaton(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        self.letters = "".join(byte_letters())
        self.special = {token["content"]: token["id"] for token in described["added_tokens"]}
        if set(self.special) != set(SPECIAL) or described.get("decoder"):
            raise ValueError("the special tokens or the decoder are not those that are known here")
        labels = {number: token for token, number in {**model["vocab"], **self.special}.items()}
        self.labels = [labels.get(number, "") for number in range(max(labels) + 1)]
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one pre-split word, whose letters stand for bytes."""
        found = self.words.get(word)
        if found is None:
            make_room(self.words, REMEMBERED)
            found = self.words[word] = np.array(self.automaton.encode(word), "<u4").tobytes()
        return found

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk without special tokens, as the vocabulary's normal form and pattern have them."""
        if PLAIN.fullmatch(chunk):
            return [run.encode().decode("latin-1").translate(self.letters) for run in RUNS.findall(chunk.lower())]
        normal = self.tokenizer.normalizer.normalize_str(chunk)
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens; chunks between ASCII spaces never share a word."""
        pieces = text.encode().split()
        try:
            return b"".join(map(self.chunks.__getitem__, pieces))
        except KeyError:
            pass
        out = []
        for piece in pieces:
            found = self.chunks.get(piece)
            if found is None:
                make_room(self.chunks, REMEMBERED)
                found = self.chunks[piece] = b"".join([self.word(word) for word in self.split(piece.decode())])
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian uint32; a special token's string in the text is that token."""
        parts, at = [], 0
        while True:
            places = [(text.find(token, at), token) for token in self.special]
            place, token = min([p for p in places if p[0] >= 0], default=(len(text), ""))
            parts.append(self.plain(text[at:place]))
            if not token:
                return np.frombuffer(b"".join(parts), "<u4")
            parts.append(np.array([self.special[token]], "<u4").tobytes())
            at = place + len(token)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, with a space between; the vocabulary names no other decoder."""
        return " ".join([self.labels[number] for number in ids.tolist()])


def codec(path: str) -> Codec:
    """Compiled once in each worker process."""
    return per_worker(f"codec {path}", lambda: Codec(path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text; the ids are little-endian uint32 in one binary.

    A NULL text is empty; an empty one has no ids and decodes to ''. A NULL id stays NULL, repeated
    rows stay repeated, an empty table gives no rows, further columns are left out. Texts and
    words of any length are encoded whole, in time proportional to their length.
    """
    texts = texts_of(docs, id_column, text_column)
    id_type = to_arrow_type(texts.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            # Some documents at a time, so that their ids and texts take little memory.
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                encoded = [own.encode(text.as_py()) for text in part.column("text")]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").cast(id_type),
                        "n_tokens": pa.array([len(ids) for ids in encoded], pa.int64()),
                        "ids": pa.array([ids.tobytes() for ids in encoded], pa.binary()),
                        "decoded": pa.array([own.decode(ids) for ids in encoded], pa.string()),
                    }
                )

    id_name = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_name}, n_tokens long, ids binary, decoded string")
