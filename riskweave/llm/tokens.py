"""Token counts under a unigram model, by dynamic programming shared along a trie.

A unigram model cuts a pre-token into the pieces with the largest sum of log scores. The best score of a prefix depends
on the prefix alone, so all pre-tokens that start alike share it. The distinct new pre-tokens of a block of texts are
walked in sorted order, which is their trie from left to right: what lies above a branch is computed once, and only the
path to the current node is held. Ends of pre-tokens store their count, and a text's count is the sum over its
pre-tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import blocks

SPACE = "▁"  # fixed value: how the piece files write a space
PRETOKEN = rf"{SPACE}*[^{SPACE}\s]+|{SPACE}+|\s+"
MEMO_WORDS = 400_000  # remembered pre-tokens of a task; the memory is emptied beyond
LONG_WORD = 64  # longer pre-tokens are not remembered


def load_pieces(path: str) -> dict[str, float]:
    """Log scores of the ordinary pieces of a piece file, read on the driver.

    The file ranks its pieces; by Zipf's law the piece of rank r gets a share of 1 / (r (ln n + 0.5772)).
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(len(ids)) + 0.5772
    return {model.id_to_piece(i): -math.log(rank * total) for rank, i in enumerate(ids, 1)}


class Trie:
    """Best scores along the current path. A character that no piece covers costs its UTF-8 bytes, ten below the
    least score for each; of equal scores the one with fewer tokens counts.

    The pieces are a trie themselves: every place of the path holds the beginnings of pieces that reach it, so a character
    only looks at what can still become a piece."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.steps = 0  # nodes computed so far
        self.root: dict = {}
        for piece, score in pieces.items():
            node = self.root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = score

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Number of tokens of each of the sorted, distinct words."""
        score, count, path, out = [0.0], [0], "", {}
        reach: list[list] = [[]]  # by place: start and trie node of the beginnings of pieces that end there
        pieces, root, unknown, steps = self.pieces, self.root, self.unknown, self.steps
        for word in words:
            shared = 0
            top = min(len(path), len(word))
            if path[:top] == word[:top]:
                shared = top
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del score[shared + 1 :], count[shared + 1 :], reach[shared + 1 :]
            for end in range(shared, len(word)):
                char = word[end]
                if char in pieces:
                    best, least = score[end] + pieces[char], count[end] + 1
                else:
                    width = len(char.encode("utf-8"))
                    best, least = score[end] + unknown * width, count[end] + width
                alive = []
                for start, node in reach[end]:
                    node = node.get(char)
                    if node is not None:
                        alive.append((start, node))
                        piece = node.get("")
                        if piece is not None:
                            s = score[start] + piece
                            if s > best or s == best and count[start] < least - 1:
                                best, least = s, count[start] + 1
                node = root.get(char)
                if node is not None:
                    alive.append((end, node))
                score.append(best)
                count.append(least)
                reach.append(alive)
            steps += len(word) - shared
            path = word
            out[word] = count[len(word)]
        self.steps = steps
        return out


def token_counts(text: str | Column, pieces: dict[str, float]) -> Column:
    """Struct of n_pretokens and n_tokens (long) of whole texts; null and empty texts have none of either.

    Spaces are written as in the piece file, and a text starts with one. Words with the spaces before them, and runs
    of other white space, are counted by themselves. Equal texts have equal counts; a text may be of any length.
    """
    state = {}

    @F.arrow_udf("struct<n_pretokens:bigint,n_tokens:bigint>")
    def count(texts: pa.Array) -> pa.Array:
        if not state:
            state.update(trie=Trie(pieces), split=regex.compile(PRETOKEN).findall, memo={})
        trie, split, memo = state["trie"], state["split"], state["memo"]
        words, tokens = [], []
        for block in blocks(x.as_py() for x in texts):
            rows = [split(SPACE + t.replace(" ", SPACE)) if t else () for t in block]
            new = set().union(*rows) - memo.keys()
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = set().union(*rows)
            memo.update(trie.counts(sorted(new)))
            words += map(len, rows)
            tokens += [sum(map(memo.__getitem__, row)) for row in rows]
            for word in new:
                if len(word) > LONG_WORD:
                    del memo[word]
        return pa.StructArray.from_arrays([pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))],
                                          ["n_pretokens", "n_tokens"])

    return count(text)
