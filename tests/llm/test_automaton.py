"""The token automaton against the library and against merging by rank."""

from __future__ import annotations

import json
import random
from hashlib import sha256

import numpy as np
import pytest

from splitloom.llm import automaton
from splitloom.llm.queries import QUERIES, vocabulary

ODD = [
    "Hello Wörld <|endoftext|>x İΣ Σ. É", "a<|startoftext|><|startoftext|>b<|endoftext|>", "", None, "   ", "aaaaaaaaaaaaaaaaaaaa",
    "漢字😀 é ́ x", "it's I'LL 'tis 123½²", "x\x1cy\x85z　w\x00", "a" * 5000 + "ab" * 3000, "-" * 700 + "==--==" * 50, "word " * 4000,
]


def merged(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The merge with the least rank, leftmost first, until none is left."""
    parts = list(word)
    while True:
        found = min(((rank[pair], n) for n, pair in enumerate(zip(parts, parts[1:])) if pair in rank), default=None)
        if found is None:
            return parts
        n = found[1]
        parts[n : n + 2] = [parts[n] + parts[n + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_any_merges(seed):
    rng = random.Random(seed)
    letters, merges = "abc"[: rng.randint(1, 3)], []
    tokens = list(letters)
    for _ in range(rng.randint(1, 25)):
        pair = (rng.choice(tokens), rng.choice(tokens))
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    compiled = automaton.Automaton({token: n for n, token in enumerate(tokens)}, merges)
    rank = {pair: n for n, pair in enumerate(merges)}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert [tokens[n] for n in compiled.encode(word)] == merged(word, rank)


def test_each_string_has_one_accepted_sequence():
    tokens = ["a", "b", "ab", "aa", "aab", "ba"]
    compiled = automaton.Automaton({t: n for n, t in enumerate(tokens)}, [("a", "b"), ("a", "a"), ("aa", "b"), ("b", "a")])

    def sequences(word, state=0):
        if not word:
            yield ()
        for n, token in enumerate(tokens):
            if word.startswith(token) and compiled.follows(state, n):
                for rest in sequences(word[len(token) :], compiled.target[n]):
                    yield (n, *rest)

    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        assert list(sequences(word)) == [tuple(compiled.encode(word))]


def test_codec_is_the_tokenizer(spark):
    own = automaton.Codec(vocabulary())
    rng = random.Random(1)
    texts = [t for t in ODD if t is not None]
    texts += ["".join(rng.choice("abcdeé st in'0.-́Ａß") for _ in range(200)) for _ in range(100)]
    for text in texts:
        ids = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, "<u4")) == own.tokenizer.decode(ids, skip_special_tokens=False)


def test_rows(spark):
    rows = [(n, t, 1, "x") for n, t in enumerate(ODD)] + [(None, "a b", None, None), (0, ODD[0], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    tokenizer = automaton.Codec(vocabulary()).tokenizer
    want = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in automaton.encode(docs, vocabulary()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert automaton.encode(docs.limit(0), vocabulary()).collect() == []


def test_query_digests_what_the_tokenizer_gives(spark, sf_dir):
    tokenizer = automaton.Codec(vocabulary()).tokenizer
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {row.doc_id: tuple(row)[1:] for row in QUERIES["op12_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest())
        assert got[doc_id] == want


def test_caches_forget_the_older_half(monkeypatch):
    monkeypatch.setattr(automaton, "REMEMBERED", 6)
    monkeypatch.setattr(automaton, "ARCS", 10)
    own = automaton.Codec(vocabulary())
    for text in [t for t in ODD if t] * 2:
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.chunks) <= 6 and len(own.words) <= 6


def test_other_kinds_of_vocabulary_are_errors(tmp_path):
    with open(vocabulary()) as file:
        described = json.load(file)
    described["decoder"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "v.json").write_text(json.dumps(described))
    with pytest.raises(ValueError):
        automaton.Codec(str(tmp_path / "v.json"))
