"""Dropped lines against brute force, and the minimal perfect hash on its own."""

import random

import numpy as np
import pytest

from riskweave.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, least_chars=20, least_docs=3):
    """rows: (key, text) pairs; null keys are smaller than all others."""
    key_of = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    small = lambda k: (k is not None, k or 0)
    holders = {}
    for key, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append(small(key))
    out = []
    for key, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if not (len(key_of(x)) >= least_chars and len(holders[key_of(x)]) >= least_docs and max(holders[key_of(x)]) != small(key))]
        out.append((key, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def texts(n, seed=1):
    rng = random.Random(seed)
    pool = [f"Line number {i} with Ä and Z of some length" for i in range(120)] + ["short", "", "ä" * 19, "ä" * 20, "Æ" * 20, "æ" * 20]
    dress = lambda x: rng.choice(["", " ", "\t", "\r", "\x0b"]) + rng.choice([x, x.lower(), x]) + rng.choice(["", " \t", "\x0c", "\xa0"])
    return ["\n".join(dress(rng.choice(pool)) for _ in range(rng.choice([1, 3, 12]))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"shard_hashes": 10}, {"sent_bytes": 0, "shard_hashes": 10}, {"sent_bytes": 0}])
def test_equals_plain(docs, how, rows):
    every = [None, "", "\n", "\n\n", *texts(150), *["the very same common line\n"] * 60, "the VERY same common line \nrest\nthe very same common line",
             "w " * 200_000 + "\nthe very same common line"]
    keys = random.Random(2).sample(range(10_000), len(every))
    clashing = {name: every for name in ("hash", "shard", "_id", "r", "gone")}
    got = lines.drop_repeated_lines(docs(every, keys, **clashing).repartition(4), "doc_id", "text", **how)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert rows(got) == plain(list(zip(keys, every))) and sum(r[2] for r in rows(got)) > 200


@pytest.mark.parametrize("how", [{}, {"sent_bytes": 0}])
def test_null_and_repeated_keys(docs, how, rows):
    a, b, c = "only rows without a key hold this", "rows with keys hold this one too", "and this one is held by two rows"
    data = [(None, a), (None, f"{a}\n{b}"), (None, a), (4, b), (9, f"{b}\n{b}"), (9, f"{b}\nx"), (9, f"{b}\n{b}"), (1, c), (2, f"{c}\n{c}")]
    got = rows(lines.drop_repeated_lines(docs([t for _, t in data], [k for k, _ in data]), "doc_id", "text", **how))
    assert got == plain(data) and (4, 1, 1, "") in got and got.count((9, 2, 0, f"{b}\n{b}")) == 2


@pytest.mark.parametrize("how", [{}, {"sent_bytes": 0}])
def test_empty_table(docs, how):
    assert lines.drop_repeated_lines(docs([]), "doc_id", "text", **how).count() == 0


def test_hot_shard_is_dealt_out(docs, rows, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", 20)
    every = [*["the very same common line"] * 200, *texts(40)]
    got = lines.drop_repeated_lines(docs(every), "doc_id", "text", sent_bytes=0)
    assert rows(got) == plain(list(enumerate(every)))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_numbering_is_minimal_and_perfect(n):
    place = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)
    numbering = lines.Numbering(lines.build_levels(place))
    assert sorted(numbering.number(place).tolist()) == list(range(n))
    bits = sum(64 * len(w) for w in numbering.levels)
    assert n < 1000 or bits < 6 * n


def test_fingerprints_tell_strangers():
    rng = np.random.default_rng(1)
    place, prints, other = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(3))
    counts, largest = rng.integers(3, 1000, 5000), rng.integers(0, 10**9, 5000)
    shard = lines.Shard(*lines.Shard.build(place, prints, counts, largest))
    got = shard.probe(place, prints)
    assert (got[0] == np.minimum(counts, 255)).all() and (got[1] == largest).all()
    assert not shard.probe(other, prints)[0].any() and not shard.probe(place, other)[0].any()
