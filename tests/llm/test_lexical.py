"""Ranked lexical search against scores worked out one by one."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from riskweave.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    """docs: (key, text) pairs; items: key -> text."""
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    rows = set()
    for item, text in items.items():
        found = []
        for d, c, n in counted:
            score = 0
            for t in plain_terms(text):
                if t in c:
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // length)))
            if score and d is not None:
                found.append((-score, d))
        rows |= {(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])}
    return rows


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["ÄÖ", "naïve", "x7", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.choice([1, 5, 60, 400]))).upper() for _ in range(n)]


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")


@pytest.mark.parametrize("item_terms, block_postings", [(200_000, 2_000_000), (30, 500)])
def test_equals_plain_search(spark, docs, item_terms, block_postings):
    texts = [None, "", " ,;", "W0", "w0 w0 W0", "w1 " * 50_000, *random_texts(300)]
    texts += [texts[40]] * 30  # ties, decided by the key
    items = {i: t[:200] for i, t in enumerate(random_texts(25, 5))} | {90: "W0 w0", 91: "unheard of", 92: "", 93: None}
    got = lexical.search(docs(texts).repartition(5), "doc_id", "text", items_of(spark, items.items()), "item_id", "text", 20, item_terms, block_postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == plain_search(list(enumerate(texts)), items, 20) and {r[0] for r in rows} >= {0, 90}


def test_nulls_repeats_and_empty_tables(spark, docs):
    texts, keys = ["a b", "a b", "a c", "a", "b b"], [7, 7, None, 2, 1]
    items = items_of(spark, [(1, "a b"), (1, "c"), (None, "a")])
    got = sorted(tuple(r) for r in lexical.search(docs(texts, keys), "doc_id", "text", items, "item_id", "text").collect())
    want = plain_search(list(zip(keys, texts)), {1: "a b"}, 20)
    assert set(got) == want and len(got) == 4 and [r[2] for r in got].count(7) == 2
    for d, i in ((docs([]), items), (docs(texts), items_of(spark, [])), (docs([None, ""]), items)):
        assert lexical.search(d, "doc_id", "text", i, "item_id", "text").count() == 0


def test_accumulators_stop_but_results_stay():
    """A rare word settles who is best, so documents that hold only the common word never get an accumulator."""
    n = 1000
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(5, np.int64)])
    counts = np.ones(n + 5, np.int64)
    rows = [[0, 1] if d < 5 else [0] for d in range(n)]
    block = lexical.Block(np.arange(n), np.full(n, 3), np.array([len(r) for r in rows]), np.array([t for r in rows for t in r]), counts,
                          lexical.Statistics(n, 3 * n, np.array([10, 5000])))
    places, scores = block.best([(0, 1), (1, 1)], np.array([10, 5000]), 5, 0)
    assert places.tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1 and scores[0] == block.most[0] + block.most[1]
    assert len(terms) == len(counts)
    # What other blocks have reached already spares even the rare word's accumulators.
    assert len(block.best([(0, 1), (1, 1)], np.array([10, 5000]), 5, int(scores[0]) + 1)[0]) == 0
