"""Counts against a dynamic programme without sharing."""

import re

import public_tokenizers as P

from riskweave.llm import tokens

PIECES = tokens.load_pieces(P.path("piece_bpe_32k.model"))
TEXTS = [None, "", " ", "the cat sat on the mat", "thethethe theory", "Grüße 漢字 😀", "a" * 3000, "new\nline\t tab", "the the the", "x" * 20 + " ▁ y"]


def count(word):
    low = min(PIECES.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in PIECES:
                options.append((best[start][0] + PIECES[piece], best[start][1] - 1))
            elif len(piece) == 1:
                width = len(piece.encode())
                options.append((best[start][0] + low * width, best[start][1] - width))
        best.append(max(options))
    return -best[-1][1]


def plain(text):
    words = re.findall(r"▁*[^▁\s]+|▁+|\s+", "▁" + text.replace(" ", "▁")) if text else []
    return len(words), sum(map(count, words))


def test_counts(docs):
    texts = [t for t in TEXTS if t is None or len(t) < 1000]
    got = {r.doc_id: tuple(r.n) for r in docs(texts).select("doc_id", tokens.token_counts("text", PIECES).alias("n")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_prefixes_are_computed_once():
    words = sorted(["international", "internationally", "internet", "inter"])
    trie = tokens.Trie(PIECES)
    assert trie.counts(words) == {w: count(w) for w in words}
    assert trie.steps == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_long_and_empty(docs):
    assert docs([TEXTS[6]]).select(tokens.token_counts("text", PIECES).alias("n")).first().n.n_tokens > 0
    assert docs([]).select(tokens.token_counts("text", PIECES)).count() == 0


def test_only_beginnings_of_pieces_are_looked_up():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    pieces = Counted({"a": -1.0, "b": -1.0, "ab": -1.5, "abcdefghijklmnop": -2.0})
    assert tokens.Trie(pieces).counts(["a" * 500, "ab" * 200]) == {"a" * 500: 500, "ab" * 200: 200}
    assert Counted.asked <= 1000  # fifteen slices a character would be over ten thousand
