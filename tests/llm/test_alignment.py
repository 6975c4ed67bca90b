"""Tokens of two vocabularies against whole texts encoded at once."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import pytest

from splitloom.llm import alignment
from splitloom.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    "a  b", "  a b ", " ", "x ", "a\nb", "x▁y", "á  b", "ab\x00c d", "ﬁ２", "<s> hi </s><unk>\t<0x41> <|endoftext|>", "a\r\n b",
    "漢字😀 x", "b́  c", "a,b.c ×, é; ², don't, 's. ,x", "so,\nand.\n\nthen: ", "\x1c a\x1c b", "trail \n", " \n x", "''s 's", "", None, "word " * 3000, "x" * 20_000, "é😀" * 4000,
]


def some_texts() -> list[str | None]:
    rng = random.Random(4)
    drawn = ["".join(rng.choice("abé st  \n'.漢😀 \t\xa0Ä") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [*ODD, *drawn, *drawn[:5], *["The river runs below the stone house. " * n for n in (1, 2, 3)]]


def brute(texts):
    """Whole texts, their tokens' bytes added up, every pair of tokens that ends together."""
    own = alignment.Aligner(A, B)
    encoded = []
    for text in texts:
        a = own.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = own.b.encode(text or "")
        parts = [[own.a_bytes[n] for n in a], [own.b_bytes[n] for n in b]]
        if not text or any(b"".join(part) != (" " + text).encode() for part in parts):
            encoded.append(None)
            continue
        ends = [list(accumulate(map(len, part))) for part in parts]
        encoded.append((list(zip(a, ends[0])), list(zip(b, ends[1]))))
    links = [[(x, y) for y, end in two for x, at in one if at == end] for one, two in [e if e and len(e[0]) < 3000 else ([], []) for e in encoded]]
    for n, found in enumerate(encoded):
        if found and len(found[0]) >= 3000:  # too long for all pairs
            at = dict((end, x) for x, end in found[0])
            links[n] = [(at[end], y) for y, end in found[1] if end in at]
    counts = Counter(pair for one in links for pair in one)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for found, own_links in zip(encoded, links):
        if not found:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts, groups, low = sorted({e for _, e in found[0]} & {e for _, e in found[1]}), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, e in side if low < e <= cut) for side in found))
            low = cut
        out.append(
            (
                len(found[0]), len(found[1]), len(groups), len(own_links), sum(counts[p] == best[p[1]] for p in own_links),
                sum(counts[p] for p in own_links), sha256(";".join(groups).encode()).hexdigest(),
            )
        )
    return out


def test_scores_equal_brute_force(spark):
    texts = [t if t is None or len(t) < 5000 else t[:4000] for t in some_texts()]
    rows = [(n, t, "n", 1) for n, t in enumerate(texts)] + [(None, "a b", None, None), (3, texts[3], "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, links long")
    got = sorted((tuple(row) for row in alignment.score(docs.repartition(3), A, B).collect()), key=str)
    want = sorted(((row[0], *found) for row, found in zip(rows, brute([row[1] for row in rows]))), key=str)
    assert got == want
    assert sum(row[1] == 0 for row in got) == 3  # NULL, empty, and one with a mark for spaces


def test_long_texts_are_whole(spark):
    texts = [("word é " * 40_000).strip(), "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: row for row in alignment.align(docs, A, B).collect()}
    for n, text in enumerate(texts):
        assert got[n].n_b == len(alignment.Aligner(A, B).b.encode(text))
        assert got[n].n_a == len(alignment.Aligner(A, B).a.encode(" " + text).ids)


def test_forgotten_units_come_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 8)
    own, other = alignment.Aligner(A, B), alignment.Aligner(A, B)
    texts = [t for t in some_texts() if t and len(t) < 200]
    assert [own.documents([t])[0] for t in texts] == other.documents(texts)
    own.documents([texts[-1]])
    assert len(own.known) <= 8


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_without_tokens(spark, rows):
    found = alignment.score(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert [tuple(row) for row in sorted(found)] == [(n, 0, 0, 0, 0, 0, 0, "") for n, _ in rows]


def test_spans_within_a_character_are_refined():
    own = alignment.Aligner(A, B)
    ids, ends = own.spans_a(" 漢😀")
    assert ends.tolist() == list(accumulate(len(own.a_bytes[n]) for n in ids.tolist())) and len({*ends.tolist()}) == len(ends)
    ids, ends = own.spans_b(" ２漢")
    assert ends.tolist() == list(accumulate(len(own.b_bytes[n]) for n in ids.tolist())) and ends[-1] == len(" ２漢".encode())
