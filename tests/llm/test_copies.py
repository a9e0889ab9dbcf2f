"""Exact and near copies against brute force, and components of given graphs."""

import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from riskweave.llm import exact, simhash
from riskweave.llm.components import connected_components

TEXTS = [None, "", " ", "a b", "a\t\x0b b", "a  b", " a b", "a b ", "A b", "a b", "word " * 30_000, "word\n" * 30_000, "same"] + ["same"] * 40 + ["x y"]


def plain_classes(texts, keys):
    groups = {}
    for k, t in zip(keys, texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(k)
    return {k: (min(g), len(g), k == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g}


@pytest.mark.parametrize("counters", [2, 1000])
def test_exact_copies(docs, counters):
    keys = random.Random(5).sample(range(1000), len(TEXTS))
    got = exact.copies(docs(TEXTS, keys), "doc_id", "text", counters).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == plain_classes(TEXTS, keys)


@pytest.mark.parametrize("counters", [2, 1000])
def test_exact_ties_and_null_keys(docs, counters):
    df = docs(["a"] * 20 + ["b", "b", "c", "c"], [7] * 10 + [None] * 10 + [None, None, 3, 3])
    got = exact.copies(df, "doc_id", "text", counters).collect()
    assert len(got) == 24 and sum(r.kept for r in got) == 3
    kept = sorted((r.text, r.doc_id) for r in exact.drop_copies(df, "doc_id", "text", counters).collect())
    assert kept == [("a", 7), ("b", None), ("c", 3)]
    assert exact.drop_copies(df, "doc_id", "text").columns == df.columns


def test_exact_empty(docs):
    assert exact.copies(docs([]), "doc_id", "text").count() == 0 and exact.drop_copies(docs([]), "doc_id", "text").count() == 0


def test_misra_gries_bounds(spark):
    values = ["hot"] * 300 + [f"v{i % 150}" for i in range(700)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = {r.v: r.n for r in exact.misra_gries(df, "v", 9).collect()}
    assert 300 - 1000 / 10 <= got["hot"] <= 300
    assert all(n <= values.count(v) for v, n in got.items())


# ---------------------------------------------------------------- near copies

def plain_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, reach):
    """prints: key -> fingerprint."""
    parent = {p: p for p in prints.values()}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= reach:
            parent[find(a)] = find(b)
    least = {}
    for k, p in prints.items():
        least[find(p)] = min(k, least.get(find(p), k))
    return {k: least[find(p)] for k, p in prints.items()}


def near_texts(n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "One two", "ÄÖ ß   x", "word " * 20_000]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 40, 300]))
        for _ in range(rng.choice([1, 1, 4])):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return texts


def test_near_copies(docs):
    texts = near_texts(60)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(docs(texts), "doc_id", "text").collect()}
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    assert {k: f for k, (f, _) in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: c for k, (_, c) in got.items()} == plain_components(prints, 3)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(texts), "doc_id", "text").collect()}
    assert kept == {c for _, c in got.values()} and len(kept) < len(texts)


@pytest.mark.parametrize("cell_rows, n", [(2048, 0), (40, 0), (2048, 10**9)])
def test_links_keep_components(spark, monkeypatch, cell_rows, n):
    """A dense cluster, chains of three-bit steps and unrelated fingerprints, with cells cut into parts and not."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(200)}
    centre, walk = rng.getrandbits(64), rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    for _ in range(40):
        walk ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.add(walk)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "bits long"), n or len(prints))
    rows = edges.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in rows)
    roots = {r.node % 2**64: r.root for r in connected_components(edges).collect()}
    want = plain_components({p: p for p in prints}, 3)
    classes = {}
    for p in prints:
        classes.setdefault(roots.get(p, p), set()).add(p)
    wanted = {}
    for p, c in want.items():
        wanted.setdefault(c, set()).add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_near_ties_nulls_empty(docs):
    df = docs(["a b c d"] * 4 + [None, ""], [5, 5, 9, None, None, None])
    rows = simhash.near_copies(df, "doc_id", "text").collect()
    assert sorted((r.component_id is None, r.component_id) for r in rows if r.fingerprint != "0" * 16) == [(False, 5)] * 4
    kept = simhash.drop_near_copies(df, "doc_id", "text")
    assert sorted(((r.text or ""), r.doc_id) for r in kept.collect()) == [("", None), ("a b c d", 5)] and kept.columns == df.columns
    assert simhash.near_copies(docs([]), "doc_id", "text").count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "rings", "none"])
def test_components(spark, shape):
    edges = {"path": [(i, i + 1) for i in range(70)], "star": [(50, i) for i in range(100)], "none": [],
             "rings": [(10 * g + i, 10 * g + (i + 1) % 10) for g in range(5) for i in range(10)] + [(3, 3)]}[shape]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {"path": {i: 0 for i in range(71)}, "star": {i: 0 for i in range(100)}, "none": {}, "rings": {i: i // 10 * 10 for i in range(50)}}[shape]
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    e = lambda c: simhash.embedding(F.col(c))
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(e("a").bitwiseXOR(e("b"))).alias("d")).collect()
    for r in rows:
        ones = [[(x >> s & 3).bit_count() for s in range(0, 64, 2)] for x in (r.a, r.b)]
        assert r.d == sum(abs(p - q) for p, q in zip(*ones)) <= (r.a ^ r.b).bit_count()


@pytest.mark.parametrize("drop", [exact.drop_copies, simhash.drop_near_copies])
@pytest.mark.parametrize("keys", [[3, 1, 2, 9], [3, 1, 1, 9]])
def test_clashing_names_survive(docs, drop, keys):
    texts = ["b c d e", "a b c d", "a b c d", "w " * 100_000]
    df = docs(texts, keys, **{name: texts for name in ("_digest", "_bits", "_key", "_row", "_copy", "kept", "fingerprint")})
    kept = drop(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r["_digest"], r["_copy"], r["kept"]) for r in kept.collect()) == [(k, *[t] * 4) for k, t in sorted(zip([3, 1, 9], [texts[0], texts[1], texts[3]]))]
