"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

Bytes are read as Latin-1 characters, so one Aho-Corasick automaton over the vocabulary finds the longest token at
every position of a pre-token. The encoder takes longest tokens from the left. A token may follow another only if the
merges would have left just these two; that answer depends on the pair alone and is remembered. When nothing fits, the
position is closed for good and the last token is taken back for its next shorter prefix. A position is closed at most
once, so the time is linear in the length, and the result is that of the merges themselves.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MEMO_PIECES = 200_000  # remembered pre-tokens of a task; the memory is emptied beyond
MEMO_PAIRS = 500_000  # remembered pairs of tokens of a task
LONG_PIECE = 64  # longer pre-tokens are not remembered


class Merges:
    """A vocabulary of ranks, with the two parts that the merges join last for every token.

    Raises ValueError if a byte has no token, or if a token's parts rank above it: merging by rank would then not
    end in the same tokens as merging in the order of the ranks.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        size = max(ranks.values()) + 1
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[int, int] = {}
        self.made: set[bytes] = {bytes([b]) for b in range(256)}
        self.size = size
        for token, rank in ranks.items():
            if len(token) > 1 and (parts := self._parts(token)):
                a, b = (ranks[p] for p in parts)
                if max(a, b) > rank and max(map(len, parts)) > 1:
                    raise ValueError(f"token {rank} is made of a later one")
                self.left[rank], self.right[rank] = a, b
                self.pairs[a * size + b] = rank
                self.made.add(token)
        # Tokens that no merges lead to match whole pre-tokens only.
        self.shorter = [-1] * size
        for token in self.made:
            self.shorter[ranks[token]] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.made), -1)

    def _parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last two parts when the token's own bytes are merged by rank, leftmost first."""
        ranks, parts, none = self.ranks, [token[i : i + 1] for i in range(len(token))], len(self.tokens)
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best == none:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """Reads a rank file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


class Encoder:
    """Encodes pre-tokens; one per task."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.length = [len(t) for t in merges.tokens]
        self.fit: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.single = [merges.ranks[bytes([b])] for b in range(256)]
        for token in merges.made:
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), merges.ranks[token])
        self.automaton.make_automaton()

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` when they stand side by side."""
        key = a * self.m.size + b
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) >= MEMO_PAIRS:
                self.fit.clear()
            known = self.fit[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Undoes the merges of both sides from the last one back, looking only at the tokens at the border.

        A merge across the border breaks the pair if it comes before the merge undone last: by a lower rank, or by
        an equal one further left.
        """
        size, left, right, pairs, before = self.m.size, self.m.left, self.m.right, self.m.pairs, self.m.size
        while True:
            across = pairs.get(a * size + b)
            if across is not None and across < before:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (a > b and not whole_a):
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        if (whole := self.m.ranks.get(piece)) is not None:
            return [whole]
        n, length, shorter, fit, size = len(piece), self.length, self.m.shorter, self.fit, self.m.size
        longest = [self.single[b] for b in piece]
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend: the last token of a start is its longest
        usable, out, at, last, token = bytearray(b"\x01") * (n + 1), [], 0, -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                if usable[at + length[token]]:
                    if last < 0:
                        break
                    good = fit.get(last * size + token)
                    if good or (good is None and self.fits(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last = token
                if at < n:
                    token = longest[at]
            else:
                usable[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out


# What the classes of a pattern hold among the first 256 code points.
CLASSES = {"\\p{L}": lambda c: unicodedata.category(c)[0] == "L", "\\p{N}": lambda c: unicodedata.category(c)[0] == "N",
           "\\s": lambda c: regex.match(r"\s", c) is not None}


def narrow(pattern: str) -> re.Pattern[str] | None:
    """The pattern for texts of code points below 256, for the built-in regex module, which is faster on such classes.
    None for a pattern with other classes."""
    out, inside, rest = [], False, pattern
    sets = {name: "".join(f"\\x{c:02x}" for c in range(256) if has(chr(c))) for name, has in CLASSES.items()}
    while rest:
        name = next((n for n in sets if rest.startswith(n)), None)
        if name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
        elif rest.startswith("\\S") and not inside:
            name = "\\S"
            out.append(f"[^{sets['\\s']}]")
        elif rest[0] == "\\":
            return None
        else:
            inside = (inside or rest[0] == "[") and rest[0] != "]"
            name = rest[0]
            out.append(name)
        rest = rest[len(name):]
    return re.compile("".join(out))


class Splitter:
    """Cuts texts into pre-tokens."""

    def __init__(self, pattern: str):
        self.wide, self.narrow = regex.compile(pattern).findall, narrow(pattern)

    def __call__(self, text: str) -> list[str]:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self.wide(text)


class _Memo(dict):
    """Ids of pre-tokens, as the bytes of 32-bit numbers."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encoder.encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class _Texts:
    """Encodes whole texts to the bytes of 32-bit ids; null stays null. What it builds for that stays with the task."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pattern, self.split, self.memo = merges, pattern, None, None

    def __call__(self, text: str | None) -> bytes | None:
        if self.split is None:
            self.split, self.memo = Splitter(self.pattern), _Memo(Encoder(self.merges))
        return None if text is None else b"".join(map(self.memo.__getitem__, self.split(text)))


def _lists(rows: list[bytes | None]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 if r else 0 for r in rows], out=offsets[1:])
    values = np.frombuffer(b"".join(r for r in rows if r), np.int32)
    mask = pa.array([r is None for r in rows]) if None in rows else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=mask)


def encode(text: str | Column, vocabulary: str, pattern: str) -> Column:
    """Token ids (array of int) of whole texts: every match of ``pattern`` is encoded by itself, no special tokens.

    ``vocabulary`` is the path of a rank file, read on the driver. Null gives null, an empty text no ids, equal texts
    equal ids; a text may be of any length.
    """
    encoder = _Texts(load_merges(vocabulary), pattern)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return _lists([encoder(x.as_py()) for x in texts])

    # The slice is the whole array. It stands between this function and those that take the ids: Spark would else run
    # both as one chain, and this one again for every such chain.
    return F.slice(ids_of(text), 1, 2**31 - 1)


def _rows(batch: pa.Array) -> Iterator[list[int] | None]:
    """The ids of each row."""
    for row in batch:
        yield None if row.values is None else row.values.to_numpy(zero_copy_only=False).tolist()


def decode(ids: str | Column, vocabulary: str) -> Column:
    """The bytes (binary) that token ids stand for. Null gives null; null or unknown ids among them raise ValueError."""
    tokens = load_merges(vocabulary).tokens

    @F.arrow_udf("binary")
    def bytes_of(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        if flat.null_count or (len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(tokens)):
            raise ValueError("ids outside the vocabulary")
        return pa.array([None if r is None else b"".join(map(tokens.__getitem__, r)) for r in _rows(batch)], pa.binary())

    return bytes_of(ids)


def encode_and_decode(text: str | Column, vocabulary: str, pattern: str) -> Column:
    """Struct of ids, decoded (binary) and digest (see ``ids_digest``), as ``encode``, ``decode`` and ``ids_digest`` give
    them, in one Python worker per task: half the memory of two functions that follow each other. Null gives nulls."""
    merges = load_merges(vocabulary)
    encoder, tokens = _Texts(merges, pattern), merges.tokens
    names = list(map(str, range(len(tokens))))

    @F.arrow_udf("struct<ids:array<int>,decoded:binary,digest:string>")
    def both(texts: pa.Array) -> pa.Array:
        coded, decoded, digests = [], [], []
        for x in texts:
            coded.append(encoder(x.as_py()))
            if coded[-1] is None:
                decoded.append(None)
                digests.append(None)
                continue
            ids = array("i", coded[-1]).tolist()
            decoded.append(b"".join(map(tokens.__getitem__, ids)))
            digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
        columns = [_lists(coded)]
        del coded
        return pa.StructArray.from_arrays([*columns, pa.array(decoded, pa.binary()), pa.array(digests, pa.string())], ["ids", "decoded", "digest"])

    return both(text)


def ids_digest(ids: str | Column) -> Column:
    """SHA-256, in hex, of the decimal ids joined by commas; null for null."""

    @F.arrow_udf("string")
    def digest(batch: pa.Array) -> pa.Array:
        top = pc.max(batch.flatten()).as_py()
        names = list(map(str, range((top or 0) + 1)))
        return pa.array([None if r is None else hashlib.sha256(",".join(map(names.__getitem__, r)).encode()).hexdigest()
                         for r in _rows(batch)], pa.string())

    return digest(ids)
